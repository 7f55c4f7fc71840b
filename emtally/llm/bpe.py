"""BPE encoding by tree concatenation, and decoding.

A text's encoding is kept as its words (the pre-tokens of the vocabulary's pattern) and the ids of each word.
A long text is encoded by halves. Where two encodings meet, words near the join are split again in a window
that grows until it ends where a word of the right side begins: from there on the pattern, which looks at
nothing before a word's start, goes on as it did on the right side, and words that end a few characters
before the join can't see past it. A long word is encoded by halves of its bytes in the same way: tokens
around the join are encoded again in windows that grow until the window begins with a token of the left side
and ends with one of the right side. Then each two neighbours of the result are neighbours in a true
encoding, which makes the whole a true encoding.

Documents over ``BLOCK`` characters are dealt out in blocks, so that several tasks encode one text.
"""

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emtally.llm import tokens
from emtally.llm.tables import small_batches, written

#: Characters of a text, and bytes of a word, that are encoded without being halved.
LEAF, WORD_LEAF = 4096, 128
#: A word's end doesn't depend on characters further than this behind it.
LOOK = 3
#: Documents with more characters are encoded in blocks of this size by several tasks.
BLOCK = 1 << 16
#: Words kept with their ids by a worker; the store is emptied when full.
MEMO = 200_000
# Characters that libraries of different Unicode versions class alike.
_COMMON = r"[\x00-ɐ‐-‧‰-⁞₠-₿™]*"


@dataclass
class Encoded:
    """A text with the ends of its words (characters), their ids one after another, and the ends of each word's ids."""

    text: str
    ends: np.ndarray
    ids: np.ndarray
    cuts: np.ndarray

    def word(self, i: int) -> str:
        return self.text[self.start(i) : self.ends[i]]

    def start(self, i: int) -> int:
        return int(self.ends[i - 1]) if i else 0

    def ids_of(self, i: int) -> np.ndarray:
        return self.ids[int(self.cuts[i - 1]) if i else 0 : int(self.cuts[i])]


class Encoder:
    def __init__(self, vocabulary: str = tokens.VOCABULARY):
        import public_tokenizers
        import regex

        self.encoding, self.library = tokens.fast(vocabulary), tokens.library(vocabulary)
        self.pattern, self.common = regex.compile(public_tokenizers.PATTERN), regex.compile(_COMMON)
        self.memo: dict[str, list[int]] = {}
        #: bytes encoded again at joins
        self.joined = 0

    # words ------------------------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        if self.common.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        """The words of ``text``: those of its halves, joined."""
        if len(text) <= LEAF:
            return self.split(text)
        half = len(text) // 2
        return self.join_words(self.words(text[:half]), self.words(text[half:]))

    def join_words(self, left: list[str], right: list[str]) -> list[str]:
        if not left or not right:
            return left or right
        keep, back = len(left), 0
        while keep and (back < LOOK or keep == len(left)):
            keep -= 1
            back += len(left[keep])
        tail, taken = "".join(left[keep:]), 4
        while True:
            head = right[:taken]
            window, starts, at = tail + "".join(head), {}, len(tail)
            for i, word in enumerate(head):
                starts[at] = i
                at += len(word)
            again, ends, whole = [], 0, taken >= len(right)
            for word in self.split(window):
                if ends in starts and (whole or ends <= len(window) - LOOK):
                    return left[:keep] + again + right[starts[ends] :]
                ends += len(word)
                again.append(word)
            if whole:
                return left[:keep] + again
            taken *= 4

    # ids of a word ----------------------------------------------------------------------------------------

    def word(self, word: str) -> list[int]:
        found = self.memo.get(word)
        if found is None:
            if len(word) <= 32:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                found = self.memo[word] = self.encoding._encode_single_piece(word.encode())
            else:
                found = self.piece(word.encode())
        return found

    def piece(self, data: bytes) -> list[int]:
        """The ids of one word's bytes: those of its halves, joined."""
        if len(data) <= WORD_LEAF:
            return self.encoding._encode_single_piece(data)
        half = len(data) // 2
        return self.join_ids(self.piece(data[:half]), self.piece(data[half:]))

    def bytes_of(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def join_ids(self, left: list[int], right: list[int]) -> list[int]:
        a, again, b = self.seam(left, right)
        return left[: len(left) - a] + again + right[b:]

    def seam(self, left, right) -> tuple[int, list[int], int]:
        """How many of the last ids of ``left`` and of the first of ``right`` (lists or arrays) the join changes at most, and the ids in their place."""
        a, b = min(2, len(left)), min(2, len(right))
        while True:
            window = self.bytes_of([*map(int, left[len(left) - a :]), *map(int, right[:b])])
            self.joined += len(window)
            again = self.encoding._encode_single_piece(window)
            left_agrees, right_agrees = again[0] == left[-a] or a == len(left), again[-1] == right[b - 1] or b == len(right)
            if left_agrees and right_agrees and len(again) > 1 or (a, b) == (len(left), len(right)):
                return a, again, b
            if not left_agrees or len(again) == 1:
                a = min(2 * a, len(left))
            if not right_agrees or len(again) == 1:
                b = min(2 * b, len(right))

    # blocks -----------------------------------------------------------------------------------------------

    def encoded(self, text: str) -> Encoded:
        words = self.words(text)
        ids = [self.word(w) for w in words]
        flat = np.fromiter((x for i in ids for x in i), "<u4")
        return Encoded(text, np.cumsum([len(w) for w in words], dtype=np.int64), flat, np.cumsum([len(i) for i in ids], dtype=np.int64))

    def join(self, left: Encoded, right: Encoded) -> Encoded:
        """The encoding of both texts in a row: words near the join are split again as in ``join_words``; a long word that
        the join makes of one word on either side is encoded again around the join only."""
        if not left.text or not right.text:
            return left if left.text else right
        keep, n = len(left.ends), len(right.ends)
        while keep and (keep == len(left.ends) or len(left.text) - left.ends[keep] + len(left.word(keep)) < LOOK):
            keep -= 1
        tail, taken = left.text[left.start(keep) :], 4
        while True:
            whole = taken >= n
            window = tail + right.text[: None if whole else right.ends[taken - 1]]
            starts = {len(tail) + right.start(i): i for i in range(min(taken, n))}
            again, at, rest = [], 0, n
            for word in self.split(window):
                if at in starts and (whole or at <= len(window) - LOOK):
                    rest = starts[at]
                    break
                again.append((at, word))
                at += len(word)
            else:
                if not whole:
                    taken *= 4
                    continue
            break
        last = len(left.ends) - 1
        ids = []
        for at, word in again:
            if len(word) > 32 and at == len(tail) - len(left.word(last)) and at + len(word) == len(tail) + right.ends[0]:
                x, y = left.ids_of(last), right.ids_of(0)
                a, between, b = self.seam(x, y)
                ids.append(np.concatenate([x[: len(x) - a], np.array(between, "<u4"), y[b:]]))
            elif len(word) > 32 and at == len(tail) - len(left.word(last)) and word == left.word(last):
                ids.append(left.ids_of(last))
            else:
                ids.append(np.array(self.word(word), "<u4"))
        before, after = left.start(keep), right.start(rest) if rest < n else len(right.text)
        id_before, id_after = int(left.cuts[keep - 1]) if keep else 0, int(right.cuts[rest - 1]) if rest else 0
        ends = np.concatenate([left.ends[:keep], before + np.cumsum([len(w) for _, w in again], dtype=np.int64), right.ends[rest:] + len(left.text)])
        flat = np.concatenate([left.ids[:id_before], *ids, right.ids[id_after:]])
        new = id_before + np.cumsum([len(i) for i in ids], dtype=np.int64)
        moved = (new[-1] if len(new) else id_before) - id_after
        assert before + sum(len(w) for _, w in again) == len(left.text) + after
        return Encoded(left.text + right.text, ends, flat, np.concatenate([left.cuts[:keep], new, right.cuts[rest:] + moved]))

    # texts ------------------------------------------------------------------------------------------------

    def ids_of(self, words: list[str]) -> list[int]:
        out: list[int] = []
        memo, word = self.memo, self.word
        for w in words:
            out += memo.get(w) or word(w)
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text. The special token's string is its id; the texts around it are encoded alone."""
        out: list[int] = []
        for i, part in enumerate(text.split(tokens.SPECIAL)):
            if i:
                out.append(tokens.SPECIAL_ID)
            if part:
                out += self.ids_of(self.words(part))
        return np.array(out, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@functools.cache
def encoder(vocabulary: str = tokens.VOCABULARY) -> Encoder:
    return Encoder(vocabulary)


RESULT = "doc_id long, n_tokens long, ids binary, decoded_sha256 string"
_BLOCKS = "doc long, doc_id long, part int, block int, text string"


def _row(doc_id, ids: np.ndarray, vocabulary: str) -> tuple:
    return doc_id, len(ids), ids.tobytes(), hashlib.sha256(encoder(vocabulary).decode(ids).encode()).hexdigest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.string()))], names=["doc_id", "n_tokens", "ids", "decoded_sha256"])


def encode_documents(documents: DataFrame, vocabulary: str = tokens.VOCABULARY, block: int = BLOCK) -> DataFrame:
    """RESULT per document: the ids (little-endian, unsigned 32-bit) and the digest of what they decode to.
    A null text is empty and has no ids; repeated rows and extra columns do no harm; texts over ``block``
    characters are encoded in blocks by several tasks, whose encodings are then joined, the blocks of one document in
    one group (a document is the unit of the result). At a join that makes one long word of two, their ids are joined,
    too: what is encoded again is a window around the join, which in a run that repeats one character may grow to the
    right side of the join."""

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows.append(_row(doc_id, enc.encode(text.as_py() or ""), vocabulary))
                size += len(rows[-1][2])
                if size > 8 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts are what stands between special tokens; each is cut in blocks."""
        for batch in batches:
            for doc, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [(doc, doc_id, i, j, part[at : at + block]) for i, part in enumerate(text.split(tokens.SPECIAL)) for j, at in enumerate(range(0, max(1, len(part)), block))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["doc", "doc_id", "part", "block", "text"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of each block, by their ends, and their ids."""
        enc = encoder(vocabulary)
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                found = enc.encoded(text)
                one = batch.slice(i, 1)
                yield pa.record_batch([*one.columns, *(pa.array([x.tobytes()], pa.binary()) for x in (found.ends, found.cuts, found.ids))], names=[*one.schema.names, "ends", "cuts", "ids"])

    def whole(table: pa.Table) -> pa.Table:
        """Joins a document's blocks as a tree; only what is near a join is encoded again."""
        enc, out, levels = encoder(vocabulary), [], {}
        for i in pc.sort_indices(table, [("part", "ascending"), ("block", "ascending")]).to_pylist():
            row = {c: table.column(c)[i] for c in ("part", "text", "ends", "cuts", "ids")}
            numbers = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("ends", np.int64), ("ids", "<u4"), ("cuts", np.int64)))
            levels.setdefault(row["part"].as_py(), []).append(Encoded(row["text"].as_py(), *numbers))
        for i in sorted(levels):
            level = levels.pop(i)
            while len(level) > 1:
                level = [enc.join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            out += [np.array([tokens.SPECIAL_ID] * (i > 0), "<u4"), level[0].ids]
        return pa.Table.from_batches([_batch([_row(table.column("doc_id")[0].as_py(), np.concatenate(out), vocabulary)])])

    small_batches(documents.sparkSession)
    docs = documents.select("doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0))
    cut_blocks = docs.where(size > block).select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text").mapInArrow(cut, _BLOCKS)
    long = written(cut_blocks, "blocks")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    encoded = long.repartition(n, "doc", "part", "block").mapInArrow(words, _BLOCKS + ", ends binary, cuts binary, ids binary")
    return docs.where(size <= block).mapInArrow(short, RESULT).unionByName(encoded.groupBy("doc").applyInArrow(whole, RESULT))
