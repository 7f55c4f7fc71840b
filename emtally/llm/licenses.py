"""License scans: winnowed fingerprints of templates pick candidates, banded alignment confirms them.

A text's words (lower-cased) are hashed, and so are its runs of GRAM words. Of each WINDOW runs of a template
one fingerprint is kept (winnowing), in an inverted index from fingerprint to template and position: a passage that
shares GRAM + WINDOW - 1 words in a row with a template shares a fingerprint. Of templates under WHOLE words all runs
are kept, and of those under SHORTEST words runs of two: then a passage in which COVERAGE of the template's words stand,
the others replaced, always shares one. Of longer templates such a passage may be missed if its changes are spread so
evenly that no five words in a row are left (one word in five or six). All runs of a document are looked up, over its
whole text. Hits of a template that lie near one diagonal are one candidate, which is aligned with the whole template
within a band around that diagonal; what share of the template's words match is the coverage. The band is an eighth of
the template, 12 words at least and a third of the template at most: words put in or left out beyond it split a match.
A candidate is aligned only if enough of the template's words stand in its part of the text in any order, as no alignment
matches more than those.
"""

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emtally.llm.license_texts import TEMPLATES
from emtally.llm.neardup import _mix, _powers_to, _tables
from emtally.llm.tables import small_batches

GRAM, WINDOW = 3, 3
#: Templates with fewer words have all their runs in the index, and with fewer than SHORTEST words runs of two words, too.
WHOLE, SHORTEST = 25, 6
#: Words by which an alignment may stray to either side of its diagonal; more for long templates, less for short ones.
BAND = 12
#: Share of a template's words that must match.
COVERAGE = 0.8
#: Share of the longer of two matches from which on they are over one passage.
SAME = 0.8
#: Fingerprints that an index may have: it is sent to all tasks.
MAX_FINGERPRINTS = 1_000_000

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (bytes) of each word: a run of ASCII letters (A-Z as a-z), digits and other characters' bytes."""
    x = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(_WORD[x])
    if not len(at):
        return np.empty(0, np.uint64), at, at
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    lengths = np.diff(np.append(first, len(at)))
    within = np.arange(len(at)) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        h = _mix(np.add.reduceat(_tables()[0][x[at]] * _powers_to(int(lengths.max()))[within], first) + lengths.astype(np.uint64))
    return h, at[first], at[first] + lengths


def band_of(size: int) -> int:
    """Under the distance of two copies of a template that follow each other."""
    return min(max(BAND, size // 8), size // 3)


def grams(h: np.ndarray, words: int = GRAM) -> np.ndarray:
    n = max(0, len(h) - words + 1)
    out = h[:n]
    with np.errstate(over="ignore"):
        for i in range(1, words):
            out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i : n + i])
    return out


def winnow(g: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: of each WINDOW runs the smallest, the last of equal ones; of fewer runs the smallest."""
    if len(g) <= WINDOW:
        return np.flatnonzero(g == g.min())[-1:] if len(g) else np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(g, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(views)) + WINDOW - 1 - views.argmin(axis=1))


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names, self.tokens, self.counts = sorted(templates), [], []
        postings, pairs = defaultdict(list), defaultdict(list)
        for i, name in enumerate(self.names):
            h = words(templates[name].encode())[0]
            if len(h) < GRAM:
                raise ValueError(f"the template {name} has under {GRAM} words")
            self.tokens.append(h.tolist())
            self.counts.append(np.unique(h, return_counts=True))
            g = grams(h)
            for p in range(len(g)) if len(h) < WHOLE else winnow(g).tolist():
                postings[int(g[p])].append((i, p))
            if len(h) < SHORTEST:
                for p, x in enumerate(grams(h, 2).tolist()):
                    pairs[x].append((i, p))
        if len(postings) + len(pairs) > MAX_FINGERPRINTS:
            raise ValueError("too many fingerprints for one index: scan by parts of the templates")
        #: words of a run -> its hash -> (template, position)
        self.postings = {GRAM: dict(postings), 2: dict(pairs)}
        self.known = {n: np.array(sorted(p), np.uint64) for n, p in self.postings.items()}

    def hits(self, h: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """template -> (position in the document, position in the template), in the document's order."""
        out = defaultdict(list)
        for n, known in self.known.items():
            g = grams(h, n)
            if len(g) and len(known):
                for d in np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g).tolist():
                    for template, p in self.postings[n][int(g[d])]:
                        out[template].append((d, p))
        return {template: sorted(found) for template, found in out.items()}

    def most(self, template: int, h: np.ndarray) -> int:
        """The words of ``h`` that any alignment with the template could match: those that both have, as often as both have them."""
        known, counts = self.counts[template]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return int(np.minimum(np.bincount(at[known[at] == h], minlength=len(known)), counts).sum())

    def matches(self, text: bytes, coverage: float = COVERAGE) -> list[tuple[int, int, str, float]]:
        """(start, end, template, coverage) in code points, by start, then end and name. Of overlapping matches of one
        template the best stays: the highest coverage, then the shortest, then the first; of matches of several templates
        over one passage that with the most words, then the highest coverage (``best_of_passages``)."""
        h, starts, ends = words(text)
        found = []
        for template, hits in self.hits(h).items():
            t, passed, taken = self.tokens[template], set(), []
            band = band_of(len(t))
            for group in candidates(hits, len(t), band):
                diagonal = int(np.median([d - p for d, p in group]))
                lo = max(0, diagonal - band)
                part = h[lo : max(0, diagonal + len(t) + band)]
                if self.most(template, part) < coverage * len(t):
                    continue
                matched = align(t, part.tolist(), diagonal - lo, band)
                if matched and len(matched) >= coverage * len(t):
                    passed.add((-len(matched), matched[-1] - matched[0], lo + matched[0]))
            for n, size, a in sorted(passed):
                i = bisect.bisect_left(taken, (a, 0))
                if (i == len(taken) or taken[i][0] > a + size) and (not i or taken[i - 1][1] < a):
                    taken.insert(i, (a, a + size))
                    found.append((a, a + size, self.names[template], -n / len(t), -n))
        found = [(int(starts[a]), int(ends[b]), name, share) for a, b, name, share, _ in best_of_passages(found)]
        if found and not text.isascii():
            # bytes that go on with a character don't count
            chars = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            found = [(int(chars[a]), int(chars[b]), name, share) for a, b, name, share in found]
        return sorted(found)


def best_of_passages(found: list[tuple]) -> list[tuple]:
    """Of matches (first word, last word, template, coverage, matched words) those without a better one over the same passage,
    SAME of the longer of both."""
    found, worse = sorted(found), set()
    rank = lambda m: (-m[4], -m[3], m[2])
    for i, m in enumerate(found):
        for j in range(i + 1, len(found)):
            o = found[j]
            if o[0] > m[1]:
                break
            if min(m[1], o[1]) - o[0] + 1 >= SAME * (max(m[1] - m[0], o[1] - o[0]) + 1):
                worse.add(j if rank(m) <= rank(o) else i)
    return [m for i, m in enumerate(found) if i not in worse]


def candidates(hits: list[tuple[int, int]], size: int, band: int) -> list[list[tuple[int, int]]]:
    """Hits of one template whose diagonals are within ``band`` of the group's first and that begin within the template's length of it."""
    groups: list[list[tuple[int, int]]] = []
    open_: list[list[tuple[int, int]]] = []
    for d, p in hits:
        open_ = [g for g in open_ if d - g[0][0] <= size + band]
        home = next((g for g in open_ if abs((d - p) - (g[0][0] - g[0][1])) <= band), None)
        if home is None:
            home = []
            groups.append(home)
            open_.append(home)
        home.append((d, p))
    return groups


def align(template: list[int], text: list[int], diagonal: int, band: int = BAND) -> list[int]:
    """Positions in ``text`` of the words matched by the best alignment with ``template``, whose word i may stand at
    positions within ``band`` of i + diagonal. A match counts 2, a word left out on either side -1; words before and
    after cost nothing in the text."""
    width, minus = 2 * band + 1, -(10**9)
    score, moves = [0] * (width + 1), []
    for i, word in enumerate(template):
        new, move = [minus] * (width + 1), [0] * width
        for k in range(width):
            j = i + diagonal - band + k
            # cell (i, j): word i and the text up to j. (i-1, j-1) is column k of the row above, (i-1, j) column k+1
            if j < -1 or j >= len(text):
                continue
            best, how = (score[k + 1] if k + 1 < width else minus) - 1, 1
            if j >= 0:
                if text[j] == word and score[k] + 2 >= best:
                    best, how = score[k] + 2, 3
                if k and new[k - 1] - 1 > best:
                    best, how = new[k - 1] - 1, 2
            new[k], move[k] = best, how
        score = new
        moves.append(move)
    k = max(range(width), key=lambda c: (score[c], -c))
    if score[k] <= minus // 2:
        return []
    out, i = [], len(template) - 1
    while i >= 0:
        how = moves[i][k]
        if how == 3:
            out.append(i + diagonal - band + k)
            i -= 1
        elif how == 1:
            i -= 1
            k += 1
        elif how == 2:
            k -= 1
        else:
            break
        if k < 0 or k >= width:
            break
    return out[::-1]


RESULT = "doc_id long, matches array<struct<start:long,end:long,template:string,coverage:double>>"


def scan(documents: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """Per row: doc_id and the matches of its whole text, ordered by start, end and template; code points, end
    exclusive. Matches of one template don't overlap; those of different templates may, unless they are over one passage: then
    the best is given. Null and empty texts have
    none; repeated rows repeat; other columns are ignored; no templates, no matches."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(Index(templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("template", pa.string()), ("coverage", pa.float64())]))
        for batch in batches:
            out = []
            for text in batch.column("text"):
                found = shared.value.matches(text.as_buffer().to_pybytes() if text.is_valid else b"", coverage)
                out.append([dict(zip(("start", "end", "template", "coverage"), m)) for m in found])
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, kind)], names=["doc_id", "matches"])

    return documents.select("doc_id", "text").mapInArrow(run, RESULT)


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_matches and matches as text: template:start:end:coverage, comma-joined."""
    said = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["start"], m["end"], F.round(m["coverage"], 4)))
    return scanned.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(said, ",").alias("matches"))
