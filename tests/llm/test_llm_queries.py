"""Every registered query of the subpackage on the smallest tables, each contract column against a plain version."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from test_llm_licenses import plain_best, plain_words
from test_llm_tables import plain_groups, plain_sequence
from test_llm_text import check_packing, library, plain_base

from emtally.llm import chat, licenses, queries, tokens

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def table(spark):
    return lambda name: spark.read.parquet(f"{D}/{name}.parquet").collect()


def run(spark, name):
    return queries.queries()[name](spark, D).collect()


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1(spark, table):
    want = plain_groups([(r.doc_id, r.text) for r in table("documents")], 3, 85)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run(spark, "op1_minhash_neardup")) == sorted((i, n, c, i == c) for i, n, c in want)


def test_op2(spark, table):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = {-1: [(0, "user", said), (1, "assistant", said)]}
    for r in table("conversations"):
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    got = {r.conv_id: r for r in run(spark, "op2_chat_format")}
    assert set(got) == set(turns)
    t = chat.ChatTemplate()
    for c, rows in turns.items():
        rows, state, bad = sorted(rows), "start", None
        for i, (_, role, _) in enumerate(rows):
            if role not in t.follows.get(state, ()) and bad is None:
                bad = i
            state = role
        loss, r = "".join(x for _, role, x in rows if role == "assistant"), got[c]
        assert (r.n_turns, r.turns_sha256) == (len(rows), sha("".join(f"{role}\n{x}\n" for _, role, x in rows)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
        escaped = lambda x: x.replace("%", "%p").replace("<|", "<%b")
        assert r.formatted_chars == sum(len(f"<|im_start|>{escaped(role)}\n{escaped(x)}<|im_end|>\n") for _, role, x in rows)
        assert (r.valid, r.rejected_at) == (bad is None and state in t.accept, bad)


def test_op3(spark, table):
    got = {r.doc_id: r for r in run(spark, "op3_toxicity")}
    assert set(got) == {r.doc_id for r in table("documents")}
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op4(spark, table):
    got = {r.doc_id: r for r in run(spark, "op4_bpe")}
    for d in table("documents"):
        ids = library(d.text)
        decoded = tokens.library().decode(ids, skip_special_tokens=False)
        assert tuple(got.pop(d.doc_id)) == (d.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(decoded))
    assert not got


def test_op5(spark, table):
    got, features = {r.doc_id: r for r in run(spark, "op5_media")}, {}
    for d in table("documents"):
        data = (d.text or "").encode()
        padded, r = data.ljust(max(192, -(-len(data) // 192) * 192)), got.pop(d.doc_id)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), sha(padded), zlib.crc32(padded[-16:]))
        assert (r.n_items, r.sequence_sha256) == plain_sequence(d.text or "")
        assert features.setdefault(d.text or "", tuple(r)[1:]) == tuple(r)[1:] and re.fullmatch("[0-9a-f]{64}", r.media_sha256) and r.media_bytes > 0
    assert not got


def test_op6(spark, table):
    """Against whole alignments of each document with each template, without index, candidates and band."""
    templates = {n: plain_words(t) for n, t in licenses.TEMPLATES.items()}
    got = {r.doc_id: r for r in run(spark, "op6_licenses")}
    named = 0
    for d in table("documents"):
        r, text = got.pop(d.doc_id), d.text or ""
        found = [(m[0], int(m[1]), int(m[2]), float(m[3])) for m in (x.split(":") for x in r.matches.split(",") if x)]
        assert r.n_matches == len(found) and found == sorted(found, key=lambda m: (m[1], m[2], m[0]))
        words = plain_words(text)
        counts, best = Counter(words), {}
        for name, t in templates.items():
            # fewer common words than that can't be matched in any order
            if sum((Counter(t) & counts).values()) >= licenses.COVERAGE * len(t):
                n = plain_best(t, words)[1]
                if n >= licenses.COVERAGE * len(t):
                    best[name] = n
        assert {m[0] for m in found} <= set(best)
        for name, a, b, share in found:
            n = plain_best(templates[name], plain_words(text[a:b]))[1]
            assert share >= licenses.COVERAGE and abs(share * len(templates[name]) - n) <= 1 and n >= licenses.COVERAGE * len(templates[name])
        for name, n in best.items():
            # it is found, or another license with no fewer matched words is
            assert any(m[0] == name and abs(m[3] * len(templates[name]) - n) <= 1 for m in found) or any(round(m[3] * len(templates[m[0]])) >= n for m in found), (d.doc_id, name)
        for name in ("mit-line", "apache-line", "gpl-line", "cc-by-nc-line"):
            line = licenses.TEMPLATES[name].rstrip(".")
            assert {f"{name}:{m.start()}:{m.end()}:1.0" for m in re.finditer(re.escape(line), text)} <= set(r.matches.split(","))
            named += text.count(line)
    assert not got and named


def test_op7(spark, table):
    rows = table("documents")
    by = {r.doc_id: i for i, r in enumerate(rows)}
    got = run(spark, "op7_best_fit_packing")
    least = -(-sum(len(library(r.text)) + 1 for r in rows) // 2048)
    renamed = [type(r)(**(r.asDict() | {"doc_id": by[r.doc_id]})) for r in got]
    assert check_packing(renamed, [r.text for r in rows], 2048) <= least + 1


def test_op8(spark, table):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in table("embeddings") if r.embedding is not None]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got, hits, n = {}, 0, 0
    for r in run(spark, "op8_ann"):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    for q, found in got.items():
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        found.sort()
        assert [k for k, _, _ in found] == list(range(1, 11)) and all(s == d[ids == v][0] for _, v, s in found) and q not in [v for _, v, _ in found]
        d[ids == q] = np.inf
        hits, n = hits + len({v for _, v, _ in found} & set(ids[np.lexsort((ids, d))[:10]].tolist())), n + 10
    assert hits >= 0.9 * n


def test_op9(spark, table):
    got = {r.doc_id: r for r in run(spark, "op9_secrets")}
    for d in table("documents"):
        base, r = plain_base(d.text or ""), got.pop(d.doc_id)
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x == k for _, x, _ in base) for k in ("assign", "access", "hex")]
        said = [f"{k}:{s}:{e}" for s, k, e in base]
        spans = r.spans.split(",") if r.spans else []
        assert r.base_sha256 == sha(",".join(said)) and [s for s in spans if not s.startswith("crf:")] == said
        assert [int(s.split(":")[1]) for s in spans] == sorted(int(s.split(":")[1]) for s in spans)
    assert not got


def test_op10(spark, table):
    rows, last = table("pages"), {}
    for r in rows:
        last[r.html or ""] = max(last.get(r.html or "", r.page_id), r.page_id)
    got = {r.page_id: r for r in run(spark, "op10_warc")}
    for r in rows:
        data, to = (r.html or "").encode(), last[r.html or ""]
        want = (r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to == r.page_id else "revisit", None if to == r.page_id else to)
        assert tuple(got.pop(r.page_id))[:5] == want
    assert not got
