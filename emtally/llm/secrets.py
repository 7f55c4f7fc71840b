"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that finds more.

Tokens are runs of word characters or of other visible characters. Each is tagged as outside a secret, its
beginning or inside it, from its shape, the words beside it (hashed, with learned weights) and features of the whole
text, by Viterbi decoding.
Tokens around which no stretch of other tags could gain on "outside" are outside in every best path; only the runs
between them are decoded, which gives the same tags as decoding it all.
The field is trained by maximum likelihood on passages of a bounded sample of the texts, into which generated
secrets are put.
"""

import bisect
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emtally.llm.tables import small_batches

#: Rows whose passages the field is trained on (the smallest hashes of doc_id), passages of each, and words and
#: characters of a passage at most.
SAMPLE, PASSAGES, PASSAGE, PASSAGE_CHARS = 300, 2, 24, 960
#: Buckets of the words beside a token: of the word before, the one before that and the word behind.
WORDS, PLACES = 512, 3
#: Training passages in which a word must stand beside a token to have a weight.
SEEN = 12
SEED = 11
O, B, I = 0, 1, 2

# Fixed values of the contract: the kinds in their order and what they match.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_KEYWORDS = (b"passw", b"pwd", b"secret", b"token", b"key", b"auth", b"bearer", b"credential")
#: Bytes of texts scanned together.
_CHUNK = 1 << 18

_CLASS = np.full(256, 2, np.uint8)  # 0 space, 1 word, 2 other
_CLASS[[32, *range(9, 14)]] = 0
_CLASS[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
_DIGIT, _UPPER, _LOWER, _HEXA = (np.zeros(256, np.int32) for _ in range(4))
_DIGIT[48:58] = 1
_UPPER[65:91] = 1
_LOWER[97:123] = 1
_HEXA[[*range(48, 58), *range(97, 103)]] = 1
_KIND = _DIGIT + 2 * _UPPER + 3 * _LOWER
_POWERS = np.cumprod(np.full(16, 0x100000001B3, np.uint64), dtype=np.uint64)

FEATURES = (
    "bias", "other", "len<=3", "len<=7", "len<=15", "len<=23", "len<=39", "len>=40", "digits only", "no digit", "digit and letter", "digit and upper", "upper inside",
    "all hex with digit", "switches>=2", "switches>=5", "non-ascii", "keyword before 1", "keyword before 2-4", "keyword", "after = or :", "after quote", "before quote", "after / + - .", "mixed before",
    "mixed after", "mixed after keyword", "long after = or :", "text has keyword", "text has many digits", "mixed and text has keyword",
)


def base_spans(text: str, hex_too: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns' matches, in code points; ordered."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if hex_too:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST_HEX]
    return sorted(out)


def tokenize(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of the tokens."""
    c = _CLASS[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(c, prepend=0, append=0)) if len(c) else np.empty(0, np.int64)
    if not len(edges):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = edges[:-1]
    keep = c[starts] != 0
    return starts[keep], edges[1:][keep]


#: Between texts that are scanned together: five tokens that are like nothing before or after a text.
_BETWEEN = b" a a a a a "


def _hits(low: bytes) -> list[int]:
    out = []
    for word in _KEYWORDS:
        at = low.find(word)
        while at >= 0:
            out.append(at)
            at = low.find(word, at + 1)
    return out


def features(data: bytes, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray | None = None) -> np.ndarray:
    """One row of FEATURES per token, as 0 or 1. ``texts``: where in ``data`` each of several texts begins (one, if None)."""
    x = np.frombuffer(data, np.uint8)
    n, f = len(starts), np.zeros((len(FEATURES), len(starts)), np.float32)
    if not n:
        return f.T
    texts = np.zeros(1, np.int64) if texts is None else texts
    bounds = np.append(texts, len(x))
    of = np.searchsorted(texts, starts, side="right") - 1

    def sums_of(values):
        sums = np.zeros(len(x) + 1, np.int32)
        np.cumsum(values, out=sums[1:])
        return sums

    def total(table):
        sums = sums_of(table[x])
        return sums[ends] - sums[starts], np.diff(sums[bounds])

    chars = sums_of((x & 0xC0) != 0x80)
    length = chars[ends] - chars[starts]
    (digit, digits), (upper, _), (lower, _), (hexa, _) = map(total, (_DIGIT, _UPPER, _LOWER, _HEXA))
    first, last = x[starts], x[ends - 1]
    other = _CLASS[first] == 2
    k = _KIND[x]
    step = np.zeros(len(x) + 1, np.int32)
    np.cumsum(k[1:] != k[:-1], out=step[2:]) if len(x) > 1 else None
    switches = step[ends] - step[starts + 1]
    mixed = (digit > 0) & (digit < length) & ~other & (length >= 6)
    found = np.zeros(n, bool)
    hits = _hits(data.lower())
    if hits:
        found[np.searchsorted(starts, hits, side="right") - 1] = True

    def before(mask, by):
        out = np.zeros(n, bool)
        out[by:] = mask[:-by] if by < n else False
        return out

    prev_other = before(other, 1)
    quote = other & np.isin(first, [34, 39]) | other & np.isin(last, [34, 39])
    starts_with = np.append(first[1:], 0)
    next_quote = np.isin(starts_with, [34, 39]) & np.append(other[1:], False)
    prev_last = np.append(0, last[:-1])
    assigned = before(other & (np.isin(first, [58, 61]) | np.isin(last, [58, 61])), 1) | (prev_other & np.isin(prev_last, [34, 39]) & before(other & np.isin(first, [58, 61]), 2))
    near = before(found, 2) | before(found, 3) | before(found, 4)
    has_keyword, many = np.bincount(of[found], minlength=len(texts)).astype(bool)[of], (digits * 20 > np.diff(bounds))[of]
    mixed_before = before(mixed, 1) | before(mixed, 2)
    columns = (
        np.ones(n, bool), other, length <= 3, (length > 3) & (length <= 7), (length > 7) & (length <= 15), (length > 15) & (length <= 23), (length > 23) & (length <= 39), length >= 40,
        digit == length, (digit == 0) & ~other, mixed, mixed & (upper > 0), (upper > 1) & (lower > 0) & (switches >= 3), (hexa == length) & (digit > 0) & (length >= 8), switches >= 2, switches >= 5, first >= 128,
        before(found, 1), near, found, assigned, before(quote, 1), next_quote, prev_other & np.isin(prev_last, [43, 45, 46, 47]), mixed_before,
        np.append(mixed[1:], False), mixed & (near | before(found, 1)), assigned & (length >= 8), has_keyword, many, mixed & has_keyword,
    )
    for j, c in enumerate(columns):
        f[j] = c
    return f.T


def neighbours(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each token the buckets of the tokens at PLACES beside it; 0 is for none, and for tokens that are long or hold a digit."""
    n = len(starts)
    if not n:
        return np.zeros((0, PLACES), np.int32)
    x = np.frombuffer(data.lower(), np.uint8)
    length, at = ends - starts, np.arange(len(x) + 1)
    within = np.ones(len(x), np.uint64)
    # powers of an odd number by the place in the token
    place = at[: len(x)] - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(x))))
    within = _POWERS[np.minimum(place, len(_POWERS) - 1)]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * within, dtype=np.uint64)])
        h = (sums[ends] - sums[starts]) * np.uint64(0x9E3779B97F4A7C15)
    digits = np.concatenate([np.zeros(1, np.int32), np.cumsum(_DIGIT[x], dtype=np.int32)])
    own = np.where((length > 12) | (digits[ends] > digits[starts]), 0, 1 + (h >> np.uint64(40)).astype(np.int64) % (WORDS - 1)).astype(np.int32)
    out = np.zeros((n, PLACES), np.int32)
    out[1:, 0], out[2:, 1], out[:-1, 2] = own[:-1], own[:-2], own[1:]
    return out


@dataclass
class Field:
    """Emission weights (features x tags), weights of the words beside a token (places x buckets x tags) and transition
    scores (tag x next tag)."""

    emit: np.ndarray
    move: np.ndarray
    beside: np.ndarray | None = None

    def emission(self, data: bytes, starts: np.ndarray, ends: np.ndarray, texts: np.ndarray | None = None) -> np.ndarray:
        out = features(data, starts, ends, texts) @ self.emit
        if self.beside is not None:
            words = neighbours(data, starts, ends)
            for p in range(PLACES):
                out += self.beside[p][words[:, p]]
        return out

    def open(self, emission: np.ndarray) -> np.ndarray:
        """Positions that may be other than O in a best path. Tags other than O over a stretch gain at most the sum
        of ``gain`` over it and one more ``step``; a position is open if some stretch around it has that at 0 or above."""
        step = max(0.0, float(np.delete(self.move.ravel() - self.move[O, O], O).max()))
        gain = emission[:, 1:].max(axis=1).astype(np.float64) - emission[:, O] + step
        sums = np.concatenate([[0.0], np.cumsum(gain)])
        ahead = sums[1:] - np.minimum.accumulate(sums)[:-1]
        behind = np.maximum.accumulate(sums[::-1])[::-1][1:] - sums[:-1]
        return np.flatnonzero(ahead + behind - gain >= -step - 1e-3)

    def decode(self, emission: np.ndarray) -> np.ndarray:
        """The best tags; before and after the text is O."""
        tags = np.zeros(len(emission), np.int8)
        open_ = self.open(emission) if len(emission) else []
        if len(open_):
            for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
                tags[run] = viterbi(emission[run[0] : run[-1] + 1], self.move)
        return tags


def viterbi(emission: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best path from O to O. Ties go to the smaller tag."""
    best = emission[0] + move[O]
    back = np.zeros((len(emission), 3), np.int8)
    for t in range(1, len(emission)):
        paths = best[:, None] + move
        back[t] = paths.argmax(axis=0)
        best = paths.max(axis=0) + emission[t]
    out = np.empty(len(emission), np.int8)
    out[-1] = (best + move[:, O]).argmax()
    for t in range(len(emission) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def likelihood(emission: np.ndarray, move: np.ndarray, tags: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The negative log-likelihood of ``tags`` (sequences x length, where ``mask``; the longest first) and its gradients by the
    emissions and by ``move``, by the forward-backward algorithm; each sequence starts from O and ends in O."""
    m, width = mask.shape
    lengths, active = mask.sum(axis=1), mask.sum(axis=0)
    rows, last = np.arange(m), lengths - 1
    top = emission.max(axis=2)
    e, step = np.exp(emission - top[..., None]), np.exp(move)
    forward, backward, scale = np.zeros((m, width, 3)), np.zeros((m, width, 3)), np.ones((m, width))
    for t in range(width):
        k = active[t]
        now = (forward[:k, t - 1] @ step if t else step[O]) * e[:k, t]
        scale[:k, t] = now.sum(axis=1)
        forward[:k, t] = now / scale[:k, t, None]
    backward[rows, last] = step[:, O]
    for t in range(width - 2, -1, -1):
        k = active[t + 1]
        now = (backward[:k, t + 1] * e[:k, t + 1]) @ step.T
        backward[:k, t] = now / now.sum(axis=1, keepdims=True)
    end = (forward[rows, last] * step[:, O]).sum(axis=1)
    i, t = np.nonzero(mask)
    p = forward[i, t] * backward[i, t]
    p /= p.sum(axis=1, keepdims=True)
    g = np.zeros((m, width, 3))
    g[i, t] = p
    g[i, t, tags[i, t]] -= 1
    i, t = np.nonzero(mask[:, 1:])
    pair = forward[i, t, :, None] * step * (e[i, t + 1] * backward[i, t + 1])[:, None, :]
    expected = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    seen = np.zeros((3, 3))
    np.add.at(seen, (tags[i, t], tags[i, t + 1]), 1)
    np.add.at(seen[O], tags[:, 0], 1)
    np.add.at(seen, (tags[rows, last], O), 1)
    own = (g + np.eye(3)[tags] * mask[..., None])
    expected[O] += own[:, 0].sum(axis=0)
    expected[:, O] += own[rows, last].sum(axis=0)
    i, t = np.nonzero(mask)
    loss = np.log(scale).sum() + top[i, t].sum() + np.log(end).sum() - emission[i, t, tags[i, t]].sum() - (seen * move).sum()
    return float(loss), g, expected - seen


def fit(sequences: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = 75, l2: float = 1e-4, l2_words: float = 3e-3, bound: float = 2.0) -> Field:
    """Maximum likelihood over (features, words beside, tags) by Adam; transitions stay within ``bound``, and words that are
    beside tokens of under SEEN sequences have no weight."""
    emit, move, beside = np.zeros((len(FEATURES), 3)), np.zeros((3, 3)), np.zeros((PLACES, WORDS, 3))
    sequences = sorted((s for s in sequences if len(s[0])), key=lambda s: -len(s[0]))
    if not sequences:
        emit[0, O] = 100.0
        return Field(emit.astype(np.float32), move.astype(np.float32))
    m, width = len(sequences), len(sequences[0][0])
    x, w, tags = (np.concatenate([s[i] for s in sequences]) for i in range(3))
    lengths = np.array([len(s[0]) for s in sequences])
    row = np.repeat(np.arange(m), lengths)
    col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    y, mask = np.zeros((m, width), np.int64), np.zeros((m, width), bool)
    y[row, col], mask[row, col] = tags, True
    known = np.zeros((PLACES, WORDS, 1))
    for p in range(PLACES):
        known[p, :, 0] = np.bincount(np.concatenate([np.unique(words[:, p]) for _, words, _ in sequences]), minlength=WORDS) >= SEEN
    known[:, 0] = 0
    moments = [np.zeros_like(a) for a in (emit, emit, move, move, beside, beside)]
    for step in range(1, steps + 1):
        e, at = np.zeros((m, width, 3)), x @ emit
        for p in range(PLACES):
            at += beside[p][w[:, p]]
        e[row, col] = at
        _, g, g_move = likelihood(e, move, y, mask)
        flat = g[row, col]
        g_beside = np.stack([np.stack([np.bincount(w[:, p], flat[:, t], WORDS) for t in range(3)], axis=1) for p in range(PLACES)]) * known
        for k, (a, grad) in enumerate(((emit, x.T @ flat / m + l2 * emit), (move, g_move / m + l2 * move), (beside, g_beside / m + l2_words * beside))):
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * grad
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * grad * grad
            a -= 0.15 * (moments[2 * k] / (1 - 0.9**step)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**step)) + 1e-8)
        np.clip(move, -bound, bound, out=move)
    return Field(emit.astype(np.float32), move.astype(np.float32), beside.astype(np.float32))


def _secret(rng: random.Random) -> str:
    """A generated secret, in the text that would hold it; what is secret stands between \\x01 and \\x02."""
    run = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    value = rng.choice((
        lambda: run(low + up + dig, rng.randint(16, 40)), lambda: run(dig + "abcdef", rng.choice((24, 32, 40, 64))), lambda: "AKIA" + run(up + dig, 16),
        lambda: rng.choice(("ghp_", "sk_live_", "xoxb_", "glpat_")) + run(low + up + dig, rng.randint(20, 36)), lambda: run(low + up + dig + "+/", 40) + "==",
        lambda: "eyJ" + run(low + up + dig, 20) + "." + run(low + up + dig + "_-", 40) + "." + run(low + up + dig + "_-", 30), lambda: run(low, 6).title() + run(dig, 3) + rng.choice("!_-") + run(up + low, 4),
    ))()
    name = rng.choice(("password", "passwd", "secret", "token", "api_key", "apikey", "auth_token", "client_secret", "Authorization", "credential"))
    value = f"\x01{value}\x02"
    if rng.random() < 0.15:
        return value
    if name == "Authorization":
        return f"Authorization: Bearer {value}"
    return rng.choice((f'{name} = "{value}"', f"{name}: {value}", f"{name}={value}", f"'{name}': '{value}'", f"{name.upper()}={value}", f"the {name} is {value}"))


def _ordinary(rng: random.Random) -> str:
    """Generated text that looks like a secret and is none."""
    dig = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("aeioulnrstdm") for _ in range(rng.randint(3, 9)))
    return rng.choice((
        lambda: f"{word()}.{word()}{dig(2)}@{word()}.example.com", lambda: f"+{dig(2)} {dig(3)} {dig(7)}", lambda: f"https://{word()}.example.org/{word()}/{dig(5)}?page={dig(1)}", lambda: f"{dig(4)}-{dig(2)}-{dig(2)} {dig(2)}:{dig(2)}:{dig(2)}",
        lambda: f"{dig(16)}", lambda: f"token: {word()} and {word()}", lambda: f"version {dig(1)}.{dig(2)}.{dig(1)}", lambda: f"a secret {word()} key = {word()}", lambda: f"{word().title()}{word()}{dig(2)}",
        lambda: f"{dig(3)}.{dig(2)}.{dig(3)}.{dig(1)}", lambda: " ".join(dig(4) for _ in range(4)), lambda: "".join(rng.choice((word(), "ción", "ñ", "heit", "über")) for _ in range(5)), lambda: f"{word().title()} {word()}{word()}{word()}, the key {word()}",
    ))()


def examples(passages: list[str], seed: int = SEED) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(features, words beside, tags) of each passage: as it is, with the fixed patterns' values as secrets, and again with generated text in it."""
    rng, out = random.Random(seed), []
    for passage in passages:
        spans = [(s, e) for s, _, e in base_spans(passage)]
        out.append(_example(passage, [(max(s, e - len(re.search(r"[A-Za-z0-9+/_.=-]+$", passage[s:e])[0])), e) for s, e in spans]))
        words = passage.split(" ")
        at = rng.randint(0, len(words))
        added = _secret(rng) if rng.random() < 0.6 else _ordinary(rng)
        text = " ".join([*words[:at], added, *words[at:]])
        if spans:
            continue
        s, e = text.find("\x01"), text.find("\x02")
        out.append(_example(text.replace("\x01", "").replace("\x02", ""), [(s, e - 1)] if s >= 0 else []))
    return out


def _example(text: str, secrets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = text.encode()
    starts, ends = tokenize(data)
    tags = np.zeros(len(starts), np.int64)
    for s, e in secrets:
        s, e = len(text[:s].encode()), len(text[:e].encode())
        within = np.flatnonzero((starts < e) & (ends > s))
        tags[within] = I
        tags[within[:1]] = B
    return features(data, starts, ends), neighbours(data, starts, ends), tags


def train(documents: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> Field:
    """Trains on passages of the ``sample`` rows with the smallest hashes of doc_id: PASSAGES per row, of PASSAGE words
    at equal distances over the whole text, PASSAGE_CHARS of each; of rows with one doc_id the smallest passage. Null and
    blank texts give none; without passages nothing more is found."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = text.split(" ")
                step = max(PASSAGE, len(words) // PASSAGES)
                out += [(doc_id, at, p[:PASSAGE_CHARS]) for at in range(PASSAGES) if (p := " ".join(words[at * step : at * step + PASSAGE])).strip()]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.string()))], names=["doc_id", "at", "text"])

    small_batches(documents.sparkSession)
    ids = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(ids), "doc_id").select("doc_id", "text").mapInArrow(passages, "doc_id long, at int, text string")
    return fit(examples(sorted(r.text for r in found.groupBy("doc_id", "at").agg(F.min("text").alias("text")).collect()), seed))


RESULT = "doc_id long, spans array<struct<start:long,kind:string,end:long>>"


def find(documents: DataFrame, field: Field) -> DataFrame:
    """Per row: doc_id and its spans, ordered by start, then kind (the fixed kinds as listed, then "crf"); code
    points, end exclusive. The fixed patterns' matches are all there; the field's spans are added where they meet
    none of those. A null text is empty and has no span; repeated rows repeat; other columns are ignored."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in batches:
            out = [[{"start": s, "kind": k, "end": e} for s, k, e in found] for found in spans(_bytes(batch.column("text")), shared.value)]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "spans"])

    return documents.select("doc_id", "text").mapInArrow(run, RESULT)


def spans(texts: list[bytes], field: Field) -> list[list[tuple[int, str, int]]]:
    """The spans of each text (UTF-8), scanned together in chunks."""
    out, chunk, size = [], [], 0
    for text in texts:
        chunk.append(text)
        size += len(text)
        if size >= _CHUNK:
            out += _scan(chunk, field)
            chunk, size = [], 0
    return out + _scan(chunk, field)


def _scan(texts: list[bytes], field: Field) -> list[list[tuple[int, str, int]]]:
    if not texts:
        return []
    data = _BETWEEN.join(texts)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(np.append(0, sizes[:-1] + len(_BETWEEN)))
    starts, ends = tokenize(data)
    emission = field.emission(data, starts, ends, begins)
    of = np.searchsorted(begins, starts, side="right") - 1
    emission[starts >= (begins + sizes)[of]] = (1e4, 0, 0)
    tags = field.decode(emission)
    more: dict[int, list] = {}
    last = -2
    for i in np.flatnonzero(tags != O).tolist():
        # inside goes on from the token before; an inside after outside begins a secret
        found = more.setdefault(int(of[i]), [])
        begin = int(begins[of[i]])
        if tags[i] == I and last == i - 1 and found:
            found[-1][1] = int(ends[i]) - begin
        else:
            found.append([int(starts[i]) - begin, int(ends[i]) - begin])
        last = i
    # texts in which a fixed pattern can match at all
    x = np.frombuffer(data, np.uint8)
    no_hex = np.flatnonzero(_HEXA[x] == 0)
    gaps = np.diff(no_hex, prepend=-1, append=len(x))
    with_hex = set((np.searchsorted(begins, np.append(no_hex, len(x))[gaps > LEAST_HEX] - 1, side="right") - 1).tolist())
    maybe = with_hex | set((np.searchsorted(begins, _hits(data.lower()), side="right") - 1).tolist())
    at = data.find(b"AKIA")
    while at >= 0:
        maybe.add(int(np.searchsorted(begins, at, side="right")) - 1)
        at = data.find(b"AKIA", at + 1)
    out = []
    for i, text in enumerate(texts):
        if i not in maybe and i not in more:
            out.append([])
            continue
        text, base = _Offsets(text), []
        if i in maybe:
            base = base_spans(text.decoded(), i in with_hex)
        every, ahead = list(base), _Ahead(base)
        for s, e in more.get(i, ()):
            s, e = text.chars(s), text.chars(e)
            if not ahead.meets(s, e):
                every.append((s, len(KINDS), e))
        out.append([(s, (*KINDS, "crf")[k], e) for s, k, e in sorted(every)])
    return out


class _Offsets:
    """Code points of rising byte offsets of a text, each found from the one before."""

    def __init__(self, data: bytes):
        self.data, self.at, self.count = data, 0, 0

    def decoded(self) -> str:
        return self.data.decode()

    def chars(self, offset: int) -> int:
        # bytes that go on with a character don't count
        part = np.frombuffer(self.data, np.uint8, offset - self.at, self.at)
        self.count += int(((part & 0xC0) != 0x80).sum())
        self.at = offset
        return self.count


class _Ahead:
    """Spans by their start, asked for by rising spans that don't overlap: whether any meets the one asked for."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts = [s for s, _, _ in spans]
        # the furthest end of the spans so far
        self.ends = np.maximum.accumulate([z for _, _, z in spans]).tolist() if spans else []

    def meets(self, start: int, end: int) -> bool:
        i = bisect.bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def _bytes(column) -> list[bytes]:
    return [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in column]


def redact(documents: DataFrame, field: Field, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every span replaced by ``mark`` (touching and overlapping spans by one) and n_chars, where there is
    that column, set anew where the text changed. All rows and columns stay."""
    small_batches(documents.sparkSession)
    shared, schema = documents.sparkSession.sparkContext.broadcast(field), documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes = [], []
            found = spans(_bytes(batch.column("text")), shared.value)
            known = batch.column("n_chars").to_pylist() if "n_chars" in batch.schema.names else [None] * batch.num_rows
            for text, size, secrets in zip(batch.column("text"), known, found):
                text, out, at = text.as_py(), [], 0
                for s, _, e in secrets:
                    if s > at or not out:
                        out += [text[at:s], mark]
                    at = max(at, e)
                if out:
                    text = "".join(out) + text[at:]
                    size = len(text)
                texts.append(text)
                sizes.append(size)
            columns = [pa.array(texts, pa.string()) if n == "text" else pa.array(sizes, batch.schema.field(n).type) if n == "n_chars" else batch.column(n) for n in batch.schema.names]
            yield pa.record_batch(columns, names=batch.schema.names)

    return documents.mapInArrow(run, schema)
