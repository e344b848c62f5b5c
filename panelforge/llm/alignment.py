"""Alignment of two tokenizers' ids over the same texts.

Documents are aligned in blocks: each block keeps its documents' links as places in its dictionary of distinct
id pairs, so that only dictionaries are shuffled. Pairs are dealt by stripes of the B id (id modulo the number of stripes).
A block is written as many small rows (a document or a piece of a long one, a stripe's part of the dictionary), as Spark
reads Parquet by numbers of rows, whatever their size.
A stripe's task adds its pairs' counts into one dense matrix of B id by A id; a second pass, with counts and pairs
dealt alike, reads each pair's count and whether it is its row's highest, and sends both back to the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import written
from panelforge.llm.tokens import ByteLevel, Pieces, forget, made


@dataclass(frozen=True)
class AlignSpec:
    """``a``: file of a byte-level BPE, which encodes a space and the text; ``b``: file of a piece BPE, which adds the space itself. A stripe's matrix holds 8 bytes for each of its B ids and each A id."""

    a: str
    b: str
    stripes: int = 256
    block_links: int = 1 << 19
    row_links: int = 1 << 12


class Sides:
    """Both tokenizers of a Python worker, the bytes of their ids, and the texts of ids in groups."""

    def __init__(self, a: str, b: str):
        self.a, self.b = made(ByteLevel, a, True), made(Pieces, b)
        self.a_bytes, self.b_bytes = self.a.bytes_of(), self.b.bytes_of()
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        # an id and what follows it: the A side ends in |, the B side in ; and others in a comma
        self.shown = [f"{i}{c}".encode() for n, marks in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for c in marks]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of each text on both sides; none where either side's bytes aren't those of a space and the text."""
        none = np.empty(0, np.uint32), np.empty(0, np.uint32)
        spaced = [" " + t if t else "" for t in texts]
        out = []
        for s, a, b in zip(spaced, self.a.encode(spaced), self.b.encode([t or "" for t in texts]), strict=True):
            want = s.encode()
            same = all(b"".join(map(table.__getitem__, ids.tolist())) == want for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
            out.append((a, b) if s and same else none)
        return out

    def align(self, sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(A id and B id of each link, links of each document, groups of each document, its groups' sha256)."""
        flat_a, flat_b = (np.concatenate([s[k] for s in sides]).astype(np.int64) for k in (0, 1))
        n_a, n_b = (np.array([len(s[k]) for s in sides]) for k in (0, 1))
        end_a, end_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        total = int(end_a[-1]) if len(end_a) else 0
        in_a, in_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        in_a[end_a] = in_b[end_b] = True
        ends = np.flatnonzero(in_a | in_b)  # between two of them lies one link
        at_a, at_b = in_a[ends], in_b[ends]
        both = at_a & at_b
        link_a, link_b = flat_a[np.cumsum(at_a) - at_a], flat_b[np.cumsum(at_b) - at_b]
        group = np.cumsum(both) - both
        group_a, group_b = group[at_a], group[at_b]
        codes = np.empty(len(flat_a) + len(flat_b), np.int64)
        codes[np.arange(len(flat_a)) + np.searchsorted(group_b, group_a, "left")] = flat_a * 2 + both[at_a]
        codes[np.arange(len(flat_b)) + np.searchsorted(group_a, group_b, "right")] = (len(self.a_bytes) + flat_b) * 2 + both[at_b]
        doc_end = np.concatenate(([0], end_a))[np.cumsum(n_a)]
        links = np.diff(np.searchsorted(ends, doc_end, "right"), prepend=0)
        groups = np.diff(np.concatenate(([0], np.cumsum(both)))[np.cumsum(links)], prepend=0)
        shown, hashes, at = codes.tolist(), [], 0
        for n in (n_a + n_b).tolist():
            hashes.append(hashlib.sha256(b"".join(map(self.shown.__getitem__, shown[at : at + n]))[:-1]).hexdigest() if n else "")
            at += n
        return link_a, link_b, links, groups, hashes


BLOCKS = "block long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, link_at binary, codes binary, counts binary"
#: Texts that are aligned at a time: so many, and no more once they hold so many bytes.
PART_TEXTS, PART_BYTES = 128, 1 << 20


def _planes(x: np.ndarray) -> bytes:
    """32-bit numbers by their bytes of each place, as the upper ones are mostly zeros and compress well."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The texts of a batch, a part at a time."""
    begin = size = 0
    for k, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        size += n or 0
        if k + 1 - begin == PART_TEXTS or size >= PART_BYTES or k + 1 == batch.num_rows:
            yield batch.slice(begin, k + 1 - begin)
            begin, size = k + 1, 0


def _rows(block: int, columns: dict[str, list]) -> pa.RecordBatch:
    """Rows of a block with some of the columns."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    n = len(columns["place"])
    names, types = zip(*map(str.split, BLOCKS.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [block if name == "block" else None] * n), kinds[kind]) for name, kind in zip(names, types, strict=True)], names)


def write_blocks(docs: DataFrame, spec: AlignSpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of the rows of blocks.

    A row with ``codes`` has what the block's dictionary holds of the stripe ``place``: places in the stripe's matrix, ascending, and counts. A row with ``link_at`` has the
    places in the dictionary of at most ``row_links`` of a document's links; its ``place`` goes on from the number of stripes, and a document's last row has its digests.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number = made(Sides, spec.a, spec.b), TaskContext.get().partitionId() << 32
        wide = len(sides.a_bytes)
        rows = -(-len(sides.b_bytes) // spec.stripes)
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            a, b, links, groups, hashes, names, n_a, n_b = ([x for h in held for x in h[k]] if k in (4, 5) else np.concatenate([h[k] for h in held]) for k in range(8))
            keys = (b % spec.stripes * rows + b // spec.stripes) * wide + a
            distinct, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
            size = rows * wide
            cuts = np.searchsorted(distinct, np.arange(spec.stripes + 1) * size)
            used = np.flatnonzero(np.diff(cuts)).tolist()
            packed = {k: [x[cuts[s] : cuts[s + 1]].astype(t).tobytes() for s in used] for k, x, t in (("codes", distinct % size, "<i4"), ("counts", counts, "<i8"))}
            if used:
                yield _rows(number, {"place": used, **packed})
            digests = dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), (names, n_a.tolist(), n_b.tolist(), groups.tolist(), links.tolist(), hashes), strict=True))
            pieces = [(k, np.array_split(x, range(spec.row_links, len(x), spec.row_links))) for k, x in enumerate(np.split(at, np.cumsum(links)[:-1]))]
            owner = [None if x is not own[-1] else k for k, own in pieces for x in own]
            of_last = {name: [None if k is None else x[k] for k in owner] for name, x in digests.items()}
            yield _rows(number, {"place": list(range(spec.stripes, spec.stripes + len(owner))), "link_at": [_planes(x) for _, own in pieces for x in own], **of_last})

        for batch in batches:
            for part in _parts(batch):
                got = sides.encode(part.column(1).to_pylist())
                held.append((*sides.align(got), part.column(0).to_pylist(), np.array([len(g[0]) for g in got]), np.array([len(g[1]) for g in got])))
                n += len(held[-1][0])
                if n >= spec.block_links:
                    yield from flush()
                    number, held, n = number + 1, [], 0
        if held:
            yield from flush()
        held = []
        forget()  # idle workers would keep their tokenizers while later stages run

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, BLOCKS), "aligned")


def _size(spec: AlignSpec) -> tuple[int, int]:
    """Rows and columns of a stripe's matrix."""
    a, b = ByteLevel(spec.a, True).tokenizer.get_vocab_size(), len(Pieces(spec.b).pieces)
    return -(-b // spec.stripes), a


def _few(batch: pa.RecordBatch, columns: int) -> Iterator[list]:
    """The rows of a batch, of which only some are unpacked at a time."""
    for at in range(0, batch.num_rows, 128):
        part = batch.slice(at, 128)
        yield list(zip(*(part.column(c).to_pylist() for c in range(columns)), strict=True))


class Matrix:
    """The dense counts of the stripe at hand; for the next stripe the cells that were used are emptied."""

    def __init__(self, rows: int, wide: int):
        forget()
        self.wide = wide
        self.cells = np.zeros(rows * wide, np.int64)
        self.stripe: int | None = None

    def add(self, codes: bytes, counts: bytes) -> None:
        np.add.at(self.cells, np.frombuffer(codes, "<i4"), np.frombuffer(counts, "<i8"))

    def used(self) -> np.ndarray:
        return np.flatnonzero(self.cells)

    def best(self) -> np.ndarray:
        return self.cells.reshape(-1, self.wide).max(axis=1)


def pair_counts(pairs: DataFrame, size: tuple[int, int]) -> DataFrame:
    """A written table (stripe, codes, counts) of all id pairs' counts, in rows of at most a million pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matrix(*size)

        def totals() -> Iterator[pa.RecordBatch]:
            used = m.used()
            for at in range(0, len(used), 1_000_000):
                part = used[at : at + 1_000_000]
                yield pa.RecordBatch.from_arrays([pa.array([m.stripe], pa.int32()), pa.array([part.astype("<i4").tobytes()], pa.binary()), pa.array([m.cells[part].tobytes()], pa.binary())], ["stripe", "codes", "counts"])
            m.cells[used] = 0

        for batch in batches:
            for stripe, codes, counts in (row for rows in _few(batch, 3) for row in rows):
                if stripe != m.stripe:
                    yield from totals()
                    m.stripe = stripe
                m.add(codes, counts)
        yield from totals()

    dealt = pairs.select("stripe", "codes", "counts").repartition("stripe").sortWithinPartitions("stripe")
    return written(dealt.mapInArrow(run, "stripe int, codes binary, counts binary"), "pair-counts")


def _scored_pairs(pairs: DataFrame, counts: DataFrame, size: tuple[int, int]) -> DataFrame:
    """(block, stripe, total, best) of the dictionaries' parts; a stripe's counts come before its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, best = Matrix(*size), None
        for rows in (rows for batch in batches for rows in _few(batch, 4)):
            out = []
            for stripe, block, codes, n in rows:
                if stripe != m.stripe:
                    m.cells[m.used()] = 0
                    m.stripe, best = stripe, None
                if block is None:
                    m.add(codes, n)
                    continue
                best = m.best() if best is None else best
                at = np.frombuffer(codes, "<i4")
                total = m.cells[at]
                out.append((block, stripe, total.tobytes(), (total == best[at // m.wide]).tobytes()))
            if out:
                columns = zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["block", "stripe", "total", "best"])

    no_block = counts.select("stripe", F.lit(None).cast("long").alias("block"), "codes", "counts")
    both = no_block.unionByName(pairs.withColumn("counts", F.lit(None).cast("binary")))
    return both.repartition("stripe").sortWithinPartitions("stripe", F.col("block").asc_nulls_first()).mapInArrow(run, "block long, stripe int, total binary, best binary")


def align(docs: DataFrame, spec: AlignSpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    Texts that are null, empty, or not given back by either side's ids (white space or characters that a side changes) have no tokens: zeros and ''.
    Texts of any length are encoded whole. Pairs that share a B id's highest count are all its best. Rows that repeat count as often as they
    stand, under null ids too. An empty table gives no rows. Other columns are not looked at.
    """
    blocks = write_blocks(docs, spec, id_col, text_col)
    pairs = blocks.where("codes is not null").select(F.col("place").alias("stripe"), "block", "codes", "counts")
    size = _size(spec)
    scored = _scored_pairs(pairs, pair_counts(pairs, size), size)
    kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        at_hand, scores = None, [[], []]  # of a block: its bests and totals, first by stripe, then joined
        sums = [0, 0]  # of a document, up to its last row
        for batch in batches:
            lasts, made_sums = [], []
            for k, (block, total, best, link_at, n_links) in enumerate(zip(*(batch.column(c) for c in ("block", "total", "best", "link_at", "n_links")), strict=True)):
                if (block := block.as_py()) != at_hand:
                    at_hand, scores = block, [[], []]
                if total.is_valid:
                    scores[0].append(best.as_py())
                    scores[1].append(total.as_py())
                    continue
                if isinstance(scores[0], list):
                    scores = [np.frombuffer(b"".join(x), kind) for x, kind in zip(scores, ("u1", "<i8"), strict=True)]
                at = _of_planes(link_at.as_py())
                sums = [s + int(x[at].sum()) for s, x in zip(sums, scores, strict=True)]
                if n_links.is_valid:
                    lasts.append(k)
                    made_sums.append(sums)
                    sums = [0, 0]
            if lasts:
                own = [batch.column(name).take(pa.array(lasts)) for name in kept]
                yield pa.RecordBatch.from_arrays([*own[:-1], *(pa.array(x, pa.int64()) for x in zip(*made_sums, strict=True)), own[-1]], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    # a block's scores come in the order of its dictionary, then its documents
    each = blocks.where("link_at is not null").select("block", "place", *kept, "link_at")
    both = scored.withColumnRenamed("stripe", "place").unionByName(each, allowMissingColumns=True)
    dealt = both.repartition("block").sortWithinPartitions("block", "place")
    return dealt.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
