"""Benchmark decontamination over a distributed positional inverted index.

The index is document-partitioned: each row is a *segment*, some thousand whole documents with
their term postings (term -> ascending positions in the segment). Positions of two documents are
kept apart by a gap, so no phrase crosses a border. A search brings the test windows to every
segment in blocks of bounded size; in a segment each window starts from the postings of its
rarest term and is narrowed by the offset-adjusted postings of the next rarer ones. No postings
are shuffled, so a frequent term or passage makes no large group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import re
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import WordHashes, written

#: Words after A-Z were lower-cased: any run of digits, letters and code points beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


@dataclass(frozen=True)
class IndexSpec:
    """``window``: words of a test window. ``segment_words``: a segment is closed at so many. ``gap``: free positions after a document. ``slop``: how far from its rarest word a window's other words may stand in a proximity match. ``block_chars``: characters of test items searched at once."""

    window: int = 10
    segment_words: int = 1 << 20
    gap: int = 64
    slop: int = 20
    block_chars: int = 1 << 21


SEGMENT = "segment long, doc_ids binary, starts binary, sizes binary, terms binary, counts binary, deltas binary"


def words_of(text: bytes | None, memo: WordHashes) -> np.ndarray:
    return memo.of(WORD.findall(text.lower())) if text else np.empty(0, np.uint64)


def build_index(docs: DataFrame, spec: IndexSpec = IndexSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The segments of ``docs``. A null text has no words; a null id is indexed and comes back as null."""

    def pack(number: int, ids: list[int | None], parts: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(p) for p in parts], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + spec.gap)[:-1])).astype(np.int64)
        tokens = np.concatenate(parts)
        at = np.arange(len(tokens), dtype=np.int64) + np.repeat(np.arange(len(parts)) * spec.gap, sizes)
        order = np.argsort(tokens, kind="stable")
        terms, counts = np.unique(tokens, return_counts=True)
        postings = at[order].astype(np.int32)
        deltas = np.diff(postings, prepend=np.int32(0))
        id_bytes = pa.array(ids, pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).tobytes()
        row = [number, id_bytes, starts.tobytes(), sizes.tobytes(), terms.tobytes(), counts.astype(np.int32).tobytes(), deltas.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x]) if i == 0 else pa.array([x], pa.binary()) for i, x in enumerate(row)], ["segment", "doc_ids", "starts", "sizes", "terms", "counts", "deltas"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, made = WordHashes(), 0
        first = TaskContext.get().partitionId() << 32
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        total = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                parts.append(words_of(text.as_py(), memo))
                total += len(parts[-1]) + 8
                if total >= spec.segment_words:
                    yield pack(first + made, ids, parts)
                    made, ids, parts, total = made + 1, [], [], 0
        if ids:
            yield pack(first + made, ids, parts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, SEGMENT)


class Windows:
    """The test windows of some items, as arrays: term hashes (padded by the last), length and item."""

    def __init__(self, items: list[tuple[int, str | None]], spec: IndexSpec):
        memo, terms, lengths, owners = WordHashes(), [], [], []
        self.ids = list(dict.fromkeys(i for i, _ in items))
        places = {i: k for k, i in enumerate(self.ids)}
        for i, text in items:
            tokens = words_of(text.encode() if text else None, memo)
            n = min(spec.window, len(tokens))
            for s in range(len(tokens) - n + 1 if n else 0):
                window = tokens[s : s + n]
                terms.append(np.concatenate((window, np.repeat(window[-1:], spec.window - n))))
                lengths.append(n)
                owners.append(places[i])
        self.terms = np.array(terms, np.uint64).reshape(-1, spec.window)
        self.lengths, self.owners = np.array(lengths, np.int64), np.array(owners, np.int64)
        self.vocabulary, codes = np.unique(self.terms, return_inverse=True)
        self.codes = codes.reshape(self.terms.shape)


def _lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


class Segment:
    """One row of the index, unpacked."""

    def __init__(self, row: dict):
        self.number = row["segment"]
        self.doc_ids, self.starts, self.sizes = (np.frombuffer(row[c], np.int64) for c in ("doc_ids", "starts", "sizes"))
        self.terms, counts = np.frombuffer(row["terms"], np.uint64), np.frombuffer(row["counts"], np.int32)
        self.counts = counts.astype(np.int64)
        self.firsts = np.concatenate(([0], np.cumsum(self.counts)))
        self.postings = np.cumsum(np.frombuffer(row["deltas"], np.int32), dtype=np.int32).astype(np.int64)
        self.keys = (np.repeat(np.arange(len(self.terms)), self.counts) << 32) | self.postings

    def phrases(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every exact occurrence."""
        if not len(w.terms) or not len(self.terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ranks = _lookup(self.terms, w.vocabulary)[w.codes]
        live = np.flatnonzero((ranks >= 0).all(1))
        if not len(live):
            return live, live
        ranks, lengths = ranks[live], w.lengths[live]
        rarity = np.where(np.arange(ranks.shape[1]) < lengths[:, None], self.counts[ranks], np.iinfo(np.int64).max)
        order = np.argsort(rarity, axis=1, kind="stable")
        need = self.counts[ranks[np.arange(len(live)), order[:, 0]]]
        found_w, found_p, at = [], [], 0
        ends = np.cumsum(need)
        while at < len(live):  # in runs of about 2 million candidates
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000)))
            rows = np.arange(at, end)
            who = np.repeat(rows, need[rows])
            pivot = order[who, 0]
            within = np.arange(len(who)) - np.repeat(np.cumsum(need[rows]) - need[rows], need[rows])
            start = self.postings[self.firsts[ranks[who, pivot]] + within] - pivot
            for k in range(1, ranks.shape[1]):
                term = order[who, k]
                due = k < lengths[who]
                probe = (ranks[who, term] << 32) | np.maximum(start + term, 0)
                ok = ~due | ((start >= 0) & (_lookup(self.keys, probe) >= 0))
                who, start = who[ok], start[ok]
                if not len(who):
                    break
            keep = start >= 0
            found_w.append(live[who[keep]])
            found_p.append(start[keep])
            at = end
        return np.concatenate(found_w), np.concatenate(found_p)

    def near(self, w: Windows, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) where a window's rarest term stands and all its other terms are within ``slop`` positions, in any order."""
        if not len(w.terms) or not len(self.terms):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ranks = _lookup(self.terms, w.vocabulary)[w.codes]
        live = np.flatnonzero((ranks >= 0).all(1))
        if not len(live):
            return live, live
        ranks = ranks[live]
        ranks = np.take_along_axis(ranks, np.argsort(self.counts[ranks], axis=1, kind="stable"), 1)
        need = self.counts[ranks[:, 0]]
        found_w, found_p, at = [], [], 0
        ends = np.cumsum(need)
        while at < len(live):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000)))
            who = np.repeat(np.arange(at, end), need[at:end])
            within = np.arange(len(who)) - np.repeat(np.cumsum(need[at:end]) - need[at:end], need[at:end])
            place = self.postings[self.firsts[ranks[who, 0]] + within]
            for k in range(1, ranks.shape[1]):
                rank = ranks[who, k] << 32
                first = np.searchsorted(self.keys, rank | np.maximum(place - slop, 0))
                ok = (ranks[who, k] == ranks[who, 0]) | (self.keys[np.minimum(first, len(self.keys) - 1)] <= (rank | (place + slop))) & (first < len(self.keys))
                who, place = who[ok], place[ok]
                if not len(who):
                    break
            found_w.append(live[who])
            found_p.append(place)
            at = end
        return np.concatenate(found_w), np.concatenate(found_p)

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, positions, side="right") - 1


HITS = "segment long, place int, doc_id long, n_words long, items array<long>, firsts array<long>, lasts array<long>, near array<long>"


def _owners(n: int, doc: np.ndarray, owner: np.ndarray, ids: list) -> list[list]:
    """For each of ``n`` documents the distinct items that occur in it."""
    out = [[] for _ in range(n)]
    for d, k in np.unique(np.stack((doc, owner), 1), axis=0).tolist():
        out[d].append(ids[k])
    return out


def search_block(index: DataFrame, windows: Windows, slop: int) -> DataFrame:
    """For every document: the items with an occurring window, the merged hit intervals (word offsets, ends exclusive), and the items with a window whose words all stand within ``slop`` positions of its rarest one."""
    w = windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                n = len(s.doc_ids)
                win, pos = s.phrases(w)
                doc = s.doc_of(pos)
                items, firsts, lasts = _owners(n, doc, w.owners[win], w.ids), [[] for _ in range(n)], [[] for _ in range(n)]
                if len(win):
                    a, b = pos - s.starts[doc], pos - s.starts[doc] + w.lengths[win]
                    order = np.lexsort((b, a, doc))
                    doc, a, b = doc[order], a[order], b[order]
                    reach = np.maximum.accumulate(b + doc * (1 << 40))  # documents are far apart, so no interval reaches the next one
                    fresh = np.concatenate(([True], a[1:] + doc[1:] * (1 << 40) > reach[:-1]))
                    head = np.flatnonzero(fresh)
                    tail = np.append(head[1:], len(a)) - 1
                    for d, x, y in zip(doc[head].tolist(), a[head].tolist(), (reach[tail] - doc[head] * (1 << 40)).tolist(), strict=True):
                        firsts[d].append(x)
                        lasts[d].append(y)
                win, pos = s.near(w, slop)
                near = _owners(n, s.doc_of(pos), w.owners[win], w.ids)
                ids = pa.array(s.doc_ids, mask=s.doc_ids == np.iinfo(np.int64).min)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, s.number)), pa.array(np.arange(n, dtype=np.int32)), ids, pa.array(s.sizes), *(pa.array(x, longs) for x in (items, firsts, lasts, near))], [c.split()[0] for c in HITS.split(", ")])

    return index.mapInArrow(run, HITS)


def _blocks(items: DataFrame, spec: IndexSpec, id_col: str, text_col: str) -> Iterator[list]:
    """The distinct test items, in blocks of about ``block_chars`` characters (or one longer item)."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    rows = written(rows, "items")
    parts = -(-rows.agg(F.coalesce(F.sum(F.length("t") + 1), F.lit(0))).first()[0] // spec.block_chars)
    for k in range(parts):
        mine = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield [(r.i, r.t) for r in mine.collect()]


def search(index: DataFrame, items: DataFrame, spec: IndexSpec = IndexSpec(), id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(segment, place, doc_id, n_words, items, firsts, lasts, near) for every document of a written index: exact phrase matches of the items' windows and proximity
    matches. Items are searched in blocks, whose hits are written before the next block is brought; a document's hits from all blocks are merged."""
    if spec.slop > spec.gap:
        raise ValueError("slop must not be larger than gap, or matches would reach into the next document")
    hits, waiting = [], None
    for rows in _blocks(items, spec, id_col, text_col):
        if waiting is not None:
            hits.append(written(waiting.where("size(items) > 0 or size(near) > 0"), "hits"))
        waiting = search_block(index, Windows(rows, spec), spec.slop)
    if not hits:
        return waiting if waiting is not None else search_block(index, Windows([], spec), spec.slop)
    every = reduce(DataFrame.union, hits, waiting)  # the last block gives a row for every document
    key = ["segment", "place", "doc_id", "n_words"]
    gathered = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near")]
    merged = every.groupBy(*key).agg(*gathered, F.array_sort(F.flatten(F.collect_list(F.arrays_zip("firsts", "lasts")))).alias("spans"))
    step = lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["lasts"] >= x["firsts"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["firsts"].alias("firsts"), F.greatest(F.element_at(acc, -1)["lasts"], x["lasts"]).alias("lasts"))))).otherwise(F.concat(acc, F.array(x)))
    spans = F.aggregate("spans", F.slice("spans", 1, 0), step)
    return merged.select(*key, "items", spans.alias("s"), "near").select(*key, "items", F.col("s.firsts").alias("firsts"), F.col("s.lasts").alias("lasts"), "near")


def decontaminate(docs: DataFrame, items: DataFrame, spec: IndexSpec = IndexSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated, firsts, lasts, near) for every document.

    A document word is hit when it lies in an occurrence of a window of any item; an item of fewer
    words than a window is one window. ``near`` are the items with a window whose words all stand near its rarest one (proximity matches, which
    don't contaminate). Null, empty and word-free texts have no words and no hits; null items and items without words occur nowhere. Texts of
    any length are indexed whole. Repeated rows are judged alike, each by itself; item rows of one id are one item. Other columns are not looked at.
    """
    index = written(build_index(docs, spec, id_col, text_col), "index")
    found = search(index, items, spec)
    hit = F.aggregate(F.zip_with("firsts", "lasts", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "items", (F.size("items") > 0).alias("contaminated"), "firsts", "lasts", "near")
