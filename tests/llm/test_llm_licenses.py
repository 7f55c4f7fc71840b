import random
import re

import pytest
from pyspark.sql import functions as F

from emtally.llm import licenses as L


def plain_words(text):
    return [m[0].lower() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]


def plain_align(template, text):
    """The most that an alignment without a band scores, and its matches, by the whole table."""
    best = [[(0, 0)] * (len(text) + 1)] + [[None] * (len(text) + 1) for _ in template]
    for i, w in enumerate(template):
        best[i + 1][0] = (-(i + 1), 0)
        for j, x in enumerate(text):
            options = [(best[i][j + 1][0] - 1, best[i][j + 1][1]), (best[i + 1][j][0] - 1, best[i + 1][j][1])]
            if w == x:
                options.append((best[i][j][0] + 2, best[i][j][1] + 1))
            best[i + 1][j + 1] = max(options)
    return max(best[-1])


def test_alignment():
    rng = random.Random(1)
    for _ in range(300):
        t = [rng.randint(0, 6) for _ in range(rng.randint(3, 12))]
        x = [y for y in t if rng.random() > 0.15]
        for _ in range(rng.randint(0, 2)):
            x.insert(rng.randint(0, len(x)), rng.randint(0, 9))
        lead = [rng.randint(0, 9) for _ in range(rng.randint(0, 4))]
        text = lead + x + [rng.randint(0, 9) for _ in range(3)]
        got = L.align(t, text, len(lead), 30)
        # equal scores may have different numbers of matches; gaps only lower a score
        score, _ = plain_align(t, text)
        rest = iter(t)
        assert got == sorted(set(got)) and 2 * len(got) >= score and all(any(w == text[j] for w in rest) for j in got)


def test_winnowing_guarantee():
    rng = random.Random(2)
    for _ in range(200):
        t = [rng.choice("abcdefgh") + "x" for _ in range(rng.randint(5, 40))]
        n = L.GRAM + L.WINDOW - 1
        at = rng.randint(0, len(t) - n)
        index = L.Index({"t": " ".join(t)})
        assert index.hits(L.words(" ".join(["q", *t[at : at + n], "z"]).encode())[0])


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("matches", F.lit(1)).withColumn("template", F.lit("x"))


def test_scan(spark):
    rng = random.Random(3)
    fill = lambda n: " ".join(rng.choice("über die thing und der eins zwei".split()) for _ in range(n))
    texts, want = ["", None, " ", fill(4000)], {i: set() for i in range(4)}
    for name, t in L.TEMPLATES.items():
        w = t.split(" ")
        shouted = " \n* ".join(x.upper() for x in w)
        changed = [x if i % 13 != 9 or i > len(w) - 3 else "Foo" for i, x in enumerate(w)]
        for body in (t, shouted, " ".join(changed) if len(w) > 30 else t):
            before, after = fill(rng.randint(0, 60)), fill(20)
            text = f"{before}\n{body}\n{after}"
            want[len(texts)] = {(name, len(before) + 1 + (body[0] == '"'), body)}
            texts.append(text)
    got = {r.doc_id: r.matches for r in L.scan(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, expected in want.items():
        for name, start, body in expected:
            m = next(m for m in got[i] if m.template == name)
            assert m.start == start and plain_words(texts[i][m.start : m.end]) == plain_words(body) and m.coverage >= L.COVERAGE
        assert {m.template for m in got[i]} <= {n for n, _, _ in expected} | ({"apache-line"} if any(n == "apache" for n, _, _ in expected) else set())
    line = L.TEMPLATES["mit-line"]
    many = L.scan(docs(spark, [f"{line} x y " * 300 + "é " + line, line.replace("MIT", "mit")])).orderBy("doc_id").collect()
    assert len(many[0].matches) == 301 and len(many[1].matches) == 1
    assert L.scan(docs(spark, texts), {}).agg(F.max(F.size("matches"))).first()[0] == 0
    assert L.scan(docs(spark, texts).limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.Index({"a": "two words"})


def plain_best(template, text):
    """(matched words, first, last) of the best alignment of the template with any part of the text, by the whole table."""
    empty = (0, 0, 0, None, None)  # score, matches, -length of the span, first, last
    above = [empty] * (len(text) + 1)
    for i, w in enumerate(template):
        row = [(-(i + 1), 0, 0, None, None)]
        for j, x in enumerate(text):
            options = [(above[j + 1][0] - 1, *above[j + 1][1:]), (row[j][0] - 1, *row[j][1:])]
            if w == x:
                s, n, _, first, _ = above[j]
                first = j if first is None else first
                options.append((s + 2, n + 1, first - j, first, j))
            row.append(max(options, key=lambda o: o[:3]))
        above = row
    return max(above, key=lambda o: o[:3])


def test_scan_against_whole_alignments():
    """Every edited copy that an alignment without index, candidates and band finds, and nothing else."""
    rng = random.Random(12)
    templates = {n: t for n, t in L.TEMPLATES.items() if n in ("mit-line", "apache-line", "gpl-line", "cc-by-nc-line", "isc", "mpl", "gpl")}
    index = L.Index(templates)
    fill = lambda n: [rng.choice("über die thing und der eins zwei".split()) for _ in range(n)]
    n_found = 0
    for k in range(250):
        name = rng.choice(sorted(templates))
        words = templates[name].split(" ")
        for _ in range(rng.randint(0, max(1, len(words) // 7))):
            i, kind = rng.randrange(1, len(words) - 1), rng.random()
            if kind < 0.5:
                words[i] = "Foo"
            elif kind < 0.75 and len(words) > 4:
                del words[i]
            else:
                words.insert(i, "bar")
        text = " ".join([*fill(rng.randint(0, 30)), *words, *fill(10)])
        got = {t: share for _, _, t, share in index.matches(text.encode())}
        for t in templates:
            best = plain_best(plain_words(templates[t]), plain_words(text))
            size = len(plain_words(templates[t]))
            if best[1] >= L.COVERAGE * size:
                assert t in got and got[t] >= L.COVERAGE and abs(got[t] * size - best[1]) <= 1, (t, text)
                n_found += 1
            else:
                assert t not in got, (t, text)
    assert n_found > 150


@pytest.mark.parametrize("line,n", [("Released under a MIT License.", 1), ("Released beneath the MIT License", 1), ("Given under the MIT License", 1), ("released under the mit License", 1), ("Released by Mr. MIT License", 0)])
def test_short_templates_are_found_with_one_word_changed(line, n):
    assert len([m for m in L.Index(L.TEMPLATES).matches(f"und die {line} der thing".encode()) if m[2] == "mit-line"]) == n


def test_one_passage_has_one_license():
    from emtally.llm.license_texts import FULL, LINES

    index = L.Index(L.TEMPLATES)
    names = lambda text: [m[2] for m in index.matches(text.encode())]
    for name in ("gpl", "gpl-2", "lgpl", "agpl"):
        assert names("x y " + L.TEMPLATES[name]) == [name]
    assert names(LINES["cc-by-sa-line"]) == ["cc-by-sa-line"] and names(LINES["cc-by-line"]) == ["cc-by-line"]
    assert names(FULL["mit-text"]) == ["mit", "mit-disclaimer"] and names(FULL["bsd-3-text"]) == ["bsd-2", "bsd-3-clause-3", "bsd-disclaimer"]
    for name, text in FULL.items():
        assert [m[2] for m in L.Index({name: text}).matches(("Copyright 2020 A B\n\n" + text).encode())] == [name]


def test_the_best_of_overlapping_matches_stays():
    index = L.Index({"t": "one two three four five six seven eight nine ten"})
    # an edited beginning, then the whole: what the first candidate takes mustn't hide the better one
    text = "one two three four five six seven eight one two three four five six seven eight nine ten"
    assert [(text[a:b], share) for a, b, _, share in index.matches(text.encode())][-1] == ("one two three four five six seven eight nine ten", 1.0)
    repeated = "é one two three four five six seven eight nine ten " * 50
    found = index.matches(repeated.encode())
    assert len(found) == 50 and all(repeated[a:b].startswith("one") and repeated[a:b].endswith("ten") for a, b, _, _ in found)


def test_candidates_without_enough_words_are_not_aligned(monkeypatch):
    calls, align = [], L.align
    monkeypatch.setattr(L, "align", lambda *a: calls.append(1) or align(*a))
    index = L.Index(L.TEMPLATES)
    notice = L.TEMPLATES["gpl"].split(" ")
    # the beginning of a notice, again and again, and one whole among them
    many = " ".join(notice[:12] * 4000)
    assert not [m for m in index.matches(many.encode()) if m[2] == "gpl"] and len(calls) < 10
    assert [m[3] for m in index.matches(f"{many} {' '.join(notice)} {many}".encode()) if m[2] == "gpl"] == [1.0]


def test_what_is_left_out_could_not_match():
    """Against the same scan that aligns every candidate: texts of pieces of notices, in and out of order."""
    rng, index, every = random.Random(21), L.Index(L.TEMPLATES), L.Index(L.TEMPLATES)
    every.most = lambda template, h: 10**9
    n_found = 0
    for _ in range(150):
        words = []
        for name in rng.choices(sorted(L.TEMPLATES), k=3):
            w = L.TEMPLATES[name].split(" ")
            a = rng.randrange(len(w)) if rng.random() < 0.3 else 0
            piece = w[a : a + rng.randint(4, len(w))]
            words += piece if rng.random() < 0.8 else piece[::-1]
        got = index.matches(" ".join(words).encode())
        assert got == every.matches(" ".join(words).encode())
        n_found += len(got)
    assert n_found > 50
