"""Importance resampling towards a target corpus by hashed word runs.

Each partition builds a trie of the words of its texts: a node stands for a run of words, holds how
often the run occurs and the CRC state of its bytes, from which a child's state follows by its word
alone. Only bucket totals leave a partition. With both corpora's totals merged, partitions walk
their texts' trie paths again, with each bucket's gain attached to the nodes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_broadcast, written

#: Nodes of a trie in a Python worker; a full trie gives its totals and begins anew.
NODES = 400_000
#: Bytes of text that are walked at once; a longer text is walked alone.
CHUNK = 1 << 21
#: Lower-cases A-Z and turns what isn't a letter, digit or byte beyond ASCII into a space.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class ResampleSpec:
    """``run``: most words of a feature; ``buckets``: of their hashes; ``percent`` of the documents with ``least_words`` or more are drawn."""

    run: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


class Roots(dict):
    """word -> node of the first level; unknown words get the next node."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        node = self[word] = len(self)
        self.new.append(word)
        return node


class WordTrie:
    """Nodes of a level are numbered as they come; ``crc`` and ``count`` are by level and node. An edge is its parent's number and its word's."""

    def __init__(self, run: int):
        self.run = run
        self.roots, self.words = Roots(), []
        self.crc = [np.empty(0, np.uint32) for _ in range(run)]
        self.count = [np.empty(0, np.int64) for _ in range(run)]
        self.edges = [np.empty(0, np.int64) for _ in range(run)]
        self.child = [np.empty(0, np.int64) for _ in range(run)]

    def __len__(self) -> int:
        return sum(map(len, self.crc))

    def _grow(self, level: int, states: list[int]) -> None:
        self.crc[level] = np.concatenate((self.crc[level], np.array(states, np.uint32)))
        self.count[level] = np.concatenate((self.count[level], np.zeros(len(states), np.int64)))

    def walk(self, words: list[bytes], ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each level the nodes of all runs and the number of the document (``ends``: of each in ``words``) they stand in."""
        owner = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        first = np.fromiter(map(self.roots.__getitem__, words), np.int64, len(words))
        if self.roots.new:
            self._grow(0, list(map(zlib.crc32, self.roots.new)))
            self.words += self.roots.new
            self.roots.new = []
        nodes = first
        yield nodes, owner
        for level in range(1, self.run):
            inside = owner[:-1] == owner[1:] if len(owner) else np.empty(0, bool)
            inside, owner = inside[: len(nodes) - 1], owner[1:]
            nodes = self._children(level, nodes[:-1], first[level:], inside[: max(len(nodes) - 1, 0)])
            yield nodes[nodes >= 0], owner[nodes >= 0]

    def _children(self, level: int, parents: np.ndarray, words: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = np.full(len(parents), -1, np.int64)
        at = np.flatnonzero(inside & (parents >= 0))
        edges, back = np.unique(parents[at] << 32 | words[at], return_inverse=True)
        place = np.searchsorted(self.edges[level], edges)
        known = np.zeros(len(edges), bool)
        known[place < len(self.edges[level])] = self.edges[level][place[place < len(self.edges[level])]] == edges[place < len(self.edges[level])]
        new = edges[~known]
        if len(new):
            states = self.crc[level - 1][new >> 32].tolist()
            fresh = [zlib.crc32(b" " + self.words[w], c) for w, c in zip((new & 0xFFFFFFFF).tolist(), states, strict=True)]
            self.child[level] = np.insert(self.child[level], place[~known], len(self.crc[level]) + np.arange(len(new)))
            self.edges[level] = np.insert(self.edges[level], place[~known], new)
            self._grow(level, fresh)
        out[at] = self.child[level][np.searchsorted(self.edges[level], edges)][back]
        return out

    def add(self, words: list[bytes], ends: np.ndarray) -> None:
        for level, (nodes, _) in enumerate(self.walk(words, ends)):
            self.count[level] += np.bincount(nodes, minlength=len(self.count[level]))

    def totals(self, buckets: int) -> np.ndarray:
        out = np.zeros(buckets, np.int64)
        for crc, count in zip(self.crc, self.count, strict=True):
            np.add.at(out, crc % np.uint32(buckets), count)
        return out


def chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], np.ndarray]]:
    """Slices of batches with the words of their texts and where each text's words end."""
    for batch in batches:
        begin, words, ends, held = 0, [], [], 0
        for k, text in enumerate(batch.column(column).cast(pa.binary())):
            part = (text.as_py() or b"").translate(TO_WORDS)
            words += part.split()
            ends.append(len(words))
            held += len(part)
            if held >= CHUNK or k + 1 == batch.num_rows:
                yield batch.slice(begin, k + 1 - begin), words, np.array(ends, np.int64)
                begin, words, ends, held = k + 1, [], [], 0


def bucket_totals(texts: DataFrame, spec: ResampleSpec, text_col: str = "text") -> DataFrame:
    """(bucket, n) of all features of ``texts``: at most ``buckets`` rows leave each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = WordTrie(spec.run), np.zeros(spec.buckets, np.int64)
        for _, words, ends in chunks(batches, 0):
            trie.add(words, ends)
            if len(trie) > NODES:
                out += trie.totals(spec.buckets)
                trie = WordTrie(spec.run)
        out += trie.totals(spec.buckets)
        used = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(out[used])], ["bucket", "n"])

    return texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, spec: ResampleSpec) -> np.ndarray:
    """The gain of each bucket: a thousand times the log of its share of the target over its share of the source, each count plus one, rounded down."""

    def dense(totals: DataFrame) -> list[int]:
        out = [0] * spec.buckets
        for r in totals.collect():  # at most a row a bucket
            out[r.bucket] = r.n
        return out

    s, t = dense(source), dense(target)
    all_s, all_t = sum(s) + spec.buckets, sum(t) + spec.buckets
    return np.array([math.floor(1000 * math.log((b + 1) * all_s / ((a + 1) * all_t))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, spec: ResampleSpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of gains along each text's trie paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, attached = WordTrie(spec.run), [np.empty(0, np.int64)] * spec.run
        for rows, words, ends in chunks(batches, 1):
            if len(trie) > NODES:
                trie, attached = WordTrie(spec.run), [np.empty(0, np.int64)] * spec.run
            n_features, weight = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
            for level, (nodes, owner) in enumerate(trie.walk(words, ends)):
                crc = trie.crc[level][len(attached[level]) :]
                attached[level] = np.concatenate((attached[level], gain[crc % np.uint32(spec.buckets)]))
                n_features += np.bincount(owner, minlength=len(ends))
                sums = np.concatenate(([0], np.cumsum(attached[level][nodes])))
                cuts = np.searchsorted(owner, np.arange(len(ends) + 1))
                weight += sums[cuts[1:]] - sums[cuts[:-1]]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(ends, prepend=0)), pa.array(n_features), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of a document, a thousandfold and rounded down, from the first 32 bits of a hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, spec: ResampleSpec = ResampleSpec(), id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` from 1 for those drawn, null for the others.

    Null and empty texts have no features and weight 0. Ties go to the smaller id, a null id comes last; it is hashed as an empty text. Rows that
    repeat an id are documents of their own, in any order among equal ones. Texts of any length are walked whole. An empty table gives no rows, an
    empty target counts of 0. Other columns of either table are not looked at.
    """
    gain = gains(bucket_totals(docs, spec, text_col), bucket_totals(target, spec, target_text), spec)
    weighed = weigh(docs, gain, spec, id_col, text_col)
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), spec.seed)).withColumn("row", F.monotonically_increasing_id()), "scored")
    enough = F.col("n_words") >= spec.least_words
    drawn = scored.where(enough).count() * spec.percent // 100
    # ranks are places in ranges of the order: each range counts its own rows, and a row for each range gives what stands before it
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    place = F.monotonically_increasing_id()
    sorted_ = scored.where(enough).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(sorted_.select("doc_id", "n_features", "weight", "score", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")), "ranges")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = written(sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before")), "range-starts")
    rank = F.col("before") + F.col("place") + 1
    ranked = placed.join(bounded_broadcast(before), "part").withColumn("rank", F.when(rank <= drawn, rank))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns).unionByName(rest.select(*columns))
