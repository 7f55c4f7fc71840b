"""Spelling variants: words of a corpus at distance one of each other, by a self-join of the vocabulary's trie.

The trie is partitioned by prefix. In a partition's task the trie is walked level by level: each node carries its active
nodes, those whose strings differ from its own by one edit, which come from its parent's active nodes by the same letter,
and its parent, siblings and children. A node and an active node that both end a word are a pair.

A partition of more than ``WORDS`` words is partitioned again by the first letter in which its words differ, so no task's trie has more. Where
two words' paths part before their partitions do, one node is active in the other's partition at distance one, and the rest
of both paths must be equal: such nodes meet by an equality join on the place of the edit and the word without its letter there.
A list of that join has no more words than the alphabet has letters, and two of them always are a pair.
"""

import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emtally.llm.tables import small_batches, written

#: Letters of the prefixes that partition the trie at first, and words of a partition at most.
PREFIX, WORDS = 2, 20_000
#: Distinct words that a task counts before it gives them out.
HELD = 200_000
#: Ends a word's path, so that a word that is the prefix of another has a path of its own.
END = "$"

_RUN = re.compile("[a-zÀ-ÿ]+")
_NO_LETTER = 1 << 21


def word_counts(documents: DataFrame, min_chars: int = 6, deleted: int | None = None) -> DataFrame:
    """(word, n): the runs of ``[A-Za-zÀ-ÿ]`` in whole texts, A-Z lower-cased, of ``min_chars`` code points or more, with
    their occurrences. Null texts have none. With ``deleted``, a run loses a code point first where that number divides
    the crc32 of ``<doc_id>:<run>`` (a null doc_id reads as None); of the run's code points it's that at the crc32 modulo their number."""
    small_batches(documents.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            return pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                # lower() of bytes changes A-Z only
                for run, n in Counter(_RUN.findall(text.as_buffer().to_pybytes().lower().decode(errors="replace"))).items():
                    if len(run) < min_chars:
                        continue
                    if deleted:
                        h = zlib.crc32(f"{doc_id}:{run}".encode())
                        if h % deleted == 0:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < min_chars:
                                continue
                    held[run] += n
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    return documents.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """The trie of sorted, distinct words. Nodes are numbered level by level, in the order of their strings; node 0 is the root."""

    def __init__(self, words: list[str]):
        sizes = np.array([len(w) for w in words], np.int64)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        offsets = np.append(0, np.cumsum(sizes))[:-1]
        parents, letters, ends, self.levels = [np.array([-1])], [np.array([0])], [np.array([-1])], [0, 1]
        rows, node, level, total = np.flatnonzero(sizes > 0), np.zeros(len(words), np.int64), 0, 1
        if len(words) and sizes[0] == 0:
            ends[0][0] = 0
        while len(rows):
            letter = flat[offsets[rows] + level]
            parent = node[rows]
            new = np.ones(len(rows), bool)
            new[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
            node[rows] = total + np.cumsum(new) - 1
            parents.append(parent[new])
            letters.append(letter[new])
            total += int(new.sum())
            level += 1
            end = np.full(int(new.sum()), -1)
            done = rows[sizes[rows] == level]
            end[node[done] - self.levels[-1]] = done
            ends.append(end)
            self.levels.append(total)
            rows = rows[sizes[rows] > level]
        self.parent, self.letter, self.end = (np.concatenate(x).astype(np.int64) for x in (parents, letters, ends))
        # children of a node stand together, and the keys of all nodes but the root are sorted
        self.keys = self.parent[1:] * _NO_LETTER + self.letter[1:]
        self.first = np.searchsorted(self.parent[1:], np.arange(total)) + 1
        self.children = np.bincount(self.parent[1:], minlength=total)

    def _spread(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``nodes``, child) of all their children."""
        n = self.children[nodes]
        of = np.repeat(np.arange(len(nodes)), n)
        within = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        return of, self.first[nodes][of] + within

    def _by_letter(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, or -1."""
        want = nodes * _NO_LETTER + letters
        at = np.minimum(np.searchsorted(self.keys, want), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == want, at + 1, -1) if len(self.keys) else np.full(len(nodes), -1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Words (by number, the smaller first) at distance one: propagates the active nodes from level to level."""
        total, found = len(self.parent), [(np.empty(0, np.int64), np.empty(0, np.int64))]
        node, active = np.zeros(self.children[0], np.int64), np.arange(1, 1 + self.children[0])
        for low, high in zip(self.levels[:-1], self.levels[1:]):
            if low:
                here = np.arange(low, high)
                # active nodes of the parent, one letter on
                of, child = self._spread(node)
                on = self._by_letter(active[of], self.letter[child])
                of_parent, sibling = self._spread(self.parent[here])
                of_here, below = self._spread(here)
                node = np.concatenate([child[on >= 0], here, here[of_parent], here[of_here]])
                active = np.concatenate([on[on >= 0], self.parent[here], sibling, below])
                code = np.unique((node * total + active)[node != active])
                node, active = code // total, code % total
            a, b = self.end[node], self.end[active]
            both = (a >= 0) & (a < b)
            found.append((a[both], b[both]))
        a, b = (np.concatenate(x) for x in zip(*found))
        code = np.unique(a * max(1, len(self.end)) + b)
        return code // max(1, len(self.end)), code % max(1, len(self.end))


def _self_join(table: pa.Table) -> pa.Table:
    """The pairs of a partition's words."""
    words = sorted(table.column("word").to_pylist())
    a, b = Trie(words).pairs()
    names = pa.array(words, pa.string())
    return pa.table([names.take(pa.array(a)), names.take(pa.array(b))], names=["a", "b"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (prefix, least, last), the first and the last word of a partition, how many letters all its words share."""
    for batch in batches:
        n = [len(os.path.commonprefix(x)) for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.record_batch([batch.column(0), pa.array(n, pa.int32())], names=["prefix", "shared"])


def near_pairs(vocabulary: DataFrame, prefix: int = PREFIX, most: int = WORDS) -> DataFrame:
    """Pairs (a, b), a before b, of distinct words of ``vocabulary`` (word) at distance one: one code point put in, left out or replaced."""
    # places: where paths may have parted above the partition
    todo, parts = vocabulary.select("word", F.lit(prefix).alias("depth"), F.sequence(F.lit(0), F.lit(prefix - 1)).alias("places")), None
    while True:
        todo = todo.withColumn("prefix", F.substring(F.concat("word", F.lit(END)), F.lit(1), F.col("depth")))
        groups = todo.groupBy("prefix").agg(F.count("*").alias("size"), F.min("word").alias("least"), F.max("word").alias("last")).where(F.col("size") > most)
        heavy = written(groups.select("prefix", "least", "last").mapInArrow(_common, "prefix string, shared int"), "heavy-prefixes")
        last = heavy.isEmpty()
        light = (todo if last else todo.join(heavy, "prefix", "left_anti")).select("word", "prefix", "places")
        parts = light if parts is None else parts.unionByName(light)
        if last:
            break
        # on to the letter in which the partition's words differ first
        deeper = todo.join(heavy, "prefix").select("word", (F.col("shared") + 1).alias("depth"), F.array_union("places", F.array("shared")).alias("places"))
        todo = written(deeper, "heavy-words")
    parts = written(parts, "trie-partitions")
    inside = parts.groupBy("prefix").applyInArrow(_self_join, "a string, b string")
    # paths that part above the partitions: the place of the edit, and what is left of a word without its letter there
    places = parts.select("word", F.explode("places").alias("at"))
    without = places.where(F.col("at") < F.char_length("word")).select("word", "at", F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring("word", F.col("at") + 2, F.char_length("word"))).alias("rest"))
    one, other = without.select("at", "rest", F.col("word").alias("x")), without.select("at", "rest", F.col("word").alias("y"))
    replaced = one.join(other, ["at", "rest"]).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"))
    whole = places.select("at", F.col("word").alias("rest"))
    put_in = one.join(whole, ["at", "rest"]).select(F.least("x", "rest").alias("a"), F.greatest("x", "rest").alias("b"))
    return inside.unionByName(replaced).unionByName(put_in).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): the last form that can be reached. Each round doubles the steps taken; forms have
    no circle, as each occurs more often than its word."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def spelling_variants(documents: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, deleted: int | None = None, prefix: int = PREFIX, most: int = WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``documents`` (doc_id, text), as ``word_counts`` has them, with
    ``min_count`` occurrences or more. n_near is the number of words at distance one. form is that of them with the largest n
    (of equal ones the first in the order of code points), if it occurs at least ``ratio`` times as often as the word, else
    null, and so is form_n. root is the last form that can be followed to; a word without form is its own.

    Null, empty and blank texts have no words; repeated rows count again, also under one doc_id; a word of any length is
    taken whole; an empty table gives no rows. Other columns are ignored."""
    vocabulary = written(word_counts(documents, min_chars, deleted).where(F.col("n") >= min_count), "vocabulary")
    pairs = written(near_pairs(vocabulary, prefix, most), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    counted = both.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    joined = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("form"), (-F.col("best.col1")).alias("form_n"))
    is_form = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    chosen = written(joined.select("word", "n", "n_near", *(F.when(is_form, F.col(c)).alias(c) for c in ("form", "form_n"))), "forms")
    ends = roots(chosen.where("form IS NOT NULL").select("word", "form"))
    return chosen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
