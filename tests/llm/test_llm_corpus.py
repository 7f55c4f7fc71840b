"""Repeated lines, spelling variants and collocations against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from emtally.llm import lines, phrases, queries, variants

D = "/root/testdata/sf0.001"


def docs(spark, rows):
    """``rows`` (doc_id, text, lang), with columns that have the names of the operators' own."""
    df = spark.createDataFrame([(i, t, g) for i, t, g in rows], "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(7) for c in ("row", "keys", "batch", "h1", "h2", "holder", "gone", "word", "n", "prefix", "depth", "pair", "h0", "task", "id", "share", "pos")})


# lines --------------------------------------------------------------------------------------------------------


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))


def plain_lines(rows, min_chars=40, min_docs=5):
    held = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if i is None or len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == i]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return out


def same(got, want):
    low = lambda rows: sorted(tuple(rows), key=lambda r: tuple((x is not None, str(x)) for x in r))
    assert low(map(tuple, got)) == low(want)


LONG = "A line that is long enough to be Dropped, and Ünï"


@pytest.mark.parametrize("batches", [1, 3, 6, 9])
def test_lines(spark, batches):
    rng = random.Random(batches)
    common = [LONG, LONG.upper(), "  " + LONG + "\t\r", LONG + " ", "ÉÀ" * 20, "éà" * 20, "ÉÀ" * 20 + "\x0b", "x" * 39, " " + "x" * 39 + " ", "x" * 40, "X" * 40, "", " ", "short", " " * 45, "line %d and so on and so on and so on, yes"]
    rows = [(i, "\n".join(rng.choice(common) for _ in range(rng.randint(1, 9)))) for i in range(40)]
    rows += [(100 + i, "\n".join(["y" * 50 + str(i // 5)] * 3)) for i in range(14)]  # the last group has four documents
    rows += [(1, LONG), (None, LONG), (None, None), (200, None), (201, ""), (202, "\n\n"), (203, LONG), (203, "other\n" + LONG), rows[3], rows[3]]
    rows += [(-5, "z" * 41 + "\n" + LONG), (300, "w" * 300_000 + "\n" + LONG + "\nend"), (301, "\n".join([LONG, "end"] * 3000))]
    got = lines.dedup_lines(docs(spark, [(*r, "en") for r in rows]), batches=batches)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    same(got.collect(), plain_lines(rows))
    same(lines.dedup_lines(docs(spark, [(*r, "en") for r in rows]), 5, 1, batches).collect(), plain_lines(rows, 5, 1))


def test_lines_by_shuffles_and_none(spark, monkeypatch):
    rows = [(i, "\n".join([LONG, f"own {i}" * 9])) for i in range(9)]
    monkeypatch.setattr(lines, "BROADCAST", 0)
    same(lines.dedup_lines(docs(spark, [(*r, None) for r in rows])).collect(), plain_lines(rows))
    assert lines.dedup_lines(docs(spark, [])).collect() == []
    assert [tuple(r) for r in lines.dedup_lines(docs(spark, [(None, None, None), (None, LONG, None)])).orderBy("text").collect()] == [(None, "", 1, 0), (None, LONG, 1, 0)]


def test_line_runs(spark):
    """A hash is in one run, with the first batch's holder; a power of two of batches is one run; no join shuffles a run."""
    runs = lines.LineRuns()
    batches = [[(h, h + 1, 100 * (9 - b) + d) for d in range(2) for h in range(b, b + 4)] for b in range(4)]
    for b, rows in enumerate(batches):
        marked = runs.add(spark.createDataFrame(rows, "h1 long, h2 long, doc_id long"))
        assert {(r.h1, r.known) for r in marked.collect()} == {(h, b > 0 and h < b + 3) for h in range(b, b + 4)}
        assert len(runs.runs()) == bin(b + 1).count("1")
    (run,) = runs.runs()
    assert sorted((r.h1, r.n, r.holder) for r in run.collect()) == [(h, 2, 100 * (9 - max(0, h - 3)) + 1) for h in range(7)]
    own = marked.drop("known")
    plan = own.join(run.select("h1", "h2", F.lit(True).alias("held")), ["h1", "h2"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan or "Broadcast" in plan
    assert sorted(r.h1 for r in runs.frequent(6).collect()) == [2, 3, 4] and sorted(r.h1 for r in runs.frequent(8).collect()) == [3]


def test_lines_are_native(spark):
    plan = lines.dedup_lines(docs(spark, [(i, LONG, None) for i in range(6)]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_op11(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    want = [(i, n, gone, hashlib.sha256(text.encode()).hexdigest()) for i, text, n, gone in plain_lines(rows)]
    same(queries.queries()["op11_line_dedup"](spark, D).collect(), want)
    assert sum(w[2] for w in want)


# spelling -----------------------------------------------------------------------------------------------------


def edits(word, letters):
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}) - {word}


def plain_variants(rows, min_chars=6, min_count=5, ratio=5, deleted=None):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if deleted and h % deleted == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_chars:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= min_count}
    letters, forms, near_counts = {c for w in words for c in w}, {}, {}
    for w, n in words.items():
        near = [x for x in edits(w, letters) if x in words]
        near_counts[w] = len(near)
        best = min(near, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= ratio * n:
            forms[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, near_counts[w], words.get(forms.get(w))))
    return out


def test_trie_self_join():
    for seed in range(150):
        rng = random.Random(seed)
        words = sorted({"".join(rng.choice("ab" if seed % 2 else "abcé") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 40))})
        a, b = variants.Trie(words).pairs()
        want = sorted((x, y) for i, x in enumerate(words) for y in words[i + 1 :] if y in edits(x, set("abcé")))
        assert sorted((words[i], words[j]) for i, j in zip(a, b)) == want
    assert [len(x) for x in variants.Trie(["x" * 5000, "x" * 5000 + "y"]).pairs()] == [1, 1]


@pytest.mark.parametrize("prefix,most", [(2, 20_000), (1, 3), (2, 1), (4, 5)])
def test_variants(spark, prefix, most):
    rng = random.Random(most)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(30)] + ["aabbaa", "abbaa", "aaaaaa", "aaaaaaa", "baaaaa", "z" * 3000, "z" * 3001]
    text = []
    for i, w in enumerate(base):
        for v in {w, *rng.sample(sorted(edits(w, set("abéX"))), 3)}:
            text += [rng.choice([v, v.upper() if v.isascii() else v])] * rng.choice([1, 4, 5, 6, 25, 30, 31, 200])
    rng.shuffle(text)
    rows = [(i, rng.choice([" ", "-", "7"]).join(text[at : at + 50])) for i, at in enumerate(range(0, len(text), 50))]
    rows += [(None, "aabbaa aabbaa"), (0, None), (1, ""), (2, " \n"), rows[0], rows[0], (3, "×÷× ÀÀÀÀÀÀ " * 6 + "àààààà " * 30)]
    got = variants.spelling_variants(docs(spark, [(*r, None) for r in rows]), prefix=prefix, most=most).collect()
    same(got, plain_variants(rows))
    got = variants.spelling_variants(docs(spark, [(*r, None) for r in rows]), min_count=1, ratio=2, deleted=3, prefix=prefix, most=most).collect()
    same(got, plain_variants(rows, min_count=1, ratio=2, deleted=3))


def test_no_variants(spark):
    assert variants.spelling_variants(docs(spark, [])).collect() == []
    assert variants.spelling_variants(docs(spark, [(1, None, None), (2, "a b c", None)])).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op12(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = queries.queries()["op12_spelling_variants"](spark, d).collect()
    same(got, plain_variants(rows, deleted=199))
    assert any(r.form for r in got)


# phrases ------------------------------------------------------------------------------------------------------


def plain_collocations(rows, least=10, longest=3, top=2000, percent=50):
    f, n = {}, Counter()
    for lang, text in rows:
        c = f.setdefault(lang or "und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            c.update(tuple(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        frequent, inside = [p for p, a in c.items() if len(p) > 1 and a >= least], Counter()
        for p in frequent:
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], c[p])
        scored = []
        for p in frequent:
            if 100 * inside[p] >= percent * c[p]:
                continue
            score, _, l, r = min((10**6 * c[p] ** 2 // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -c[p], " ".join(p).encode(), l, r))
        for i, (score, a, p, l, r) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -score))
    return out


@pytest.mark.parametrize("longest,projection,task", [(3, 50_000, 100_000), (3, 2, 10), (4, 3, 7), (2, 1, 5), (5, 20, 1_000_000)])
def test_collocations(spark, longest, projection, task):
    rng = random.Random(longest)
    words = ["the", "The", "a", "b", "ÉT", "éT", "c d", "漢", "x" * 3000, "new", "york", "city", "\x00"]
    rows = []
    for i in range(80):
        t = [rng.choice(words) if rng.random() < 0.7 else "new York City" if rng.random() < 0.5 else rng.choice(["a a a", ".", "!?", "\n", "\r\n", "\t"]) for _ in range(rng.randint(0, 40))]
        rows.append((rng.choice(["en", "fr", None, "und", ""]), rng.choice([" ", "  ", "\t"]).join(t)))
    rows += [("en", None), (None, ""), ("xx", " . "), ("yy", "one two three"), rows[0], rows[0], ("en", "the the " * 2000)]
    df = docs(spark, [(i, t, g) for i, (g, t) in enumerate(rows)])
    got = phrases.collocations(df, 4, longest, 15, 50, projection, task)
    same(got.collect(), plain_collocations(rows, 4, longest, 15))


def test_collocations_in_shares(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED", 3)
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "BLOCK", 64)
    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice("abcdefgh") * 2 for _ in range(60)) + rng.choice([". ", " "]) + "q" * 200 + " aa") for _ in range(40)]
    got = phrases.collocations(docs(spark, [(i, t, g) for i, (g, t) in enumerate(rows)]), 3, 3, 2)
    same(got.collect(), plain_collocations(rows, 3, 3, 2))
    assert phrases.collocations(docs(spark, [])).collect() == []


def test_words_of_one_hash(spark, monkeypatch):
    """A seed under which words share a hash is passed over, also where they stand in one block."""
    real, tried = phrases.Words.blocks, []

    def blocks(self, text):
        for part, starts, sizes, h, piece, other in real(self, text):
            yield part, starts, sizes, h & 1 if bad(self) else h, piece, other

    bad = lambda self: tried.append(1) or self.values[0] == phrases.Words(1).values[0]
    words = [w for w in phrases.vocabulary(docs(spark, [(1, "a b c d e f a", "en")]), 1).collect()]
    assert sorted((w.word, w.n) for w in words) == [("a", 2), *((x, 1) for x in "bcdef")]
    monkeypatch.setattr(phrases.Words, "blocks", blocks)
    held = phrases.Words(1, checked=True)
    ((_, starts, _, h, _, other),) = held.blocks(b"a b c a")
    assert len(set(h.tolist())) == 2 and len(set(other.tolist())) == 3 and len(starts) == 4


def test_scores_are_exact(spark):
    a, l, r = 10**15 + 7, 10**16 - 3, 2 * 10**15 + 11
    counts = spark.createDataFrame([("en", [1], l), ("en", [2], r), ("en", [1, 2], a)], "lang string, phrase array<long>, a long")
    (row,) = phrases.scored(counts, counts.where(F.size("phrase") > 1)).collect()
    assert row.score == 10**6 * a * a // (l * r)


def test_op13(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    same(queries.queries()["op13_collocations"](spark, D).collect(), plain_collocations(rows))
