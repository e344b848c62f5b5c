"""Approximate nearest neighbours by collision counting.

Each projection keeps a block's vectors as an array sorted by one dot product. A query opens a window
around its own projection in every array; virtual rehashing widens the windows by a factor,
round after round, and a vector collects a collision for each window it lies in. Vectors whose
collisions exceed a threshold - chosen from the histogram of counts so that at least a share of the block passes -
are verified by their exact inner products. Projections are orthogonal, so their windows don't repeat each other.
Inner products become distances by the usual extra coordinate, which lifts the vectors of a band of similar lengths to the largest one.
A window missed is a least difference in one direction, so a count of collisions bounds the inner product from above: the threshold
is lowered until no vector left out can be among the nearest. Results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import written


@dataclass(frozen=True)
class CollisionSpec:
    """``share``: least part of a block that is verified, ``least`` in numbers. ``widths``: half-widths of the windows of all rounds, in standard deviations of a projection. ``query_block``: queries brought to every block at once. ``band``: a block's vectors are grouped so that lengths differ by this factor at most, or ``band_rows`` are reached."""

    k: int = 20
    projections: int = 128
    widths: tuple[float, ...] = (0.5, 0.9, 1.3, 1.8, 2.5)
    share: float = 0.04
    least: int = 400
    block: int = 16384
    query_block: int = 4096
    band: float = 0.9
    band_rows: int = 1024
    seed: int = 7


INDEX = "block long, ids binary, vectors binary, places binary, projected binary, spread binary, top double"


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part: not null, not zero, every component finite. A null id takes no part."""
    v = F.col(vec_col).cast("array<double>")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0").where(ok)


def _basis(dim: int, spec: CollisionSpec) -> np.ndarray:
    """Orthonormal directions of the lifted space, all of them or a random part."""
    rng = np.random.default_rng(spec.seed)
    return np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0][:, : min(dim + 1, spec.projections)]


def build_index(vectors: DataFrame, dim: int, spec: CollisionSpec) -> DataFrame:
    """Blocks of ``vectors`` (id, v) by bands of length, the longest first: ids, vectors, for each projection the places of the sorted array and its values, and the largest length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis, held, count, made = _basis(dim, spec), [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def pack() -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids, x = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
            length = np.sqrt((x * x).sum(1))
            down = np.argsort(-length, kind="stable")
            ids, x, length = ids[down], x[down], length[down]
            at = 0
            while at < len(ids):
                end = min(len(ids), max(at + spec.band_rows, int(np.searchsorted(-length, -spec.band * length[at], side="right"))))
                yield one(ids[at:end], x[at:end], float(length[at]) * (1 + 1e-12))
                at, made = end, made + 1

        def one(ids: np.ndarray, x: np.ndarray, top: float) -> pa.RecordBatch:
            lifted = np.column_stack((x, np.sqrt(np.maximum(top**2 - (x * x).sum(1), 0))))
            h = (lifted @ basis).T.astype(np.float32)
            order = np.argsort(h, axis=1, kind="stable")
            place = np.empty(order.shape, np.int32)
            np.put_along_axis(place, order, np.arange(h.shape[1], dtype=np.int32)[None, :], 1)
            cells = [ids.tobytes(), x.tobytes(), place.tobytes(), np.take_along_axis(h, order, 1).tobytes(), h.std(1).astype(np.float64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([first + made]), *(pa.array([c], pa.binary()) for c in cells), pa.array([top])], [c.split()[0] for c in INDEX.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, spec.block):
                part = batch.slice(at, spec.block)
                if part.num_rows:
                    held.append((part.column(0).to_numpy(), part.column(1).flatten().to_numpy().reshape(-1, dim)))
                    count += part.num_rows
                if count >= spec.block:
                    yield from pack()
                    held, count = [], 0
        if held:
            yield from pack()

    return vectors.mapInArrow(run, INDEX)


class Block:
    def __init__(self, row: dict, dim: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        n = len(self.ids)
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(n, dim)
        self.places = np.frombuffer(row["places"], np.int32).reshape(-1, n).astype(np.intp)
        self.sorted = np.frombuffer(row["projected"], np.float32).reshape(-1, n)
        self.spread = np.frombuffer(row["spread"], np.float64)
        self.top = row["top"]

    def ceilings(self, spec: CollisionSpec) -> np.ndarray:
        """For each count of collisions, the largest inner product that a vector with this count can have with a query of length 1.

        A vector outside a window of half-width w differs by more than w in that direction; the sum of the least steps from
        window to window, as many as were missed, is a lower bound of its squared distance.
        """
        wide = np.maximum(np.array([0.0, *sorted(spec.widths)])[None, :] * self.spread[:, None] - 1e-6 * self.top, 0)
        least = np.concatenate(([0.0], np.cumsum(np.sort(np.diff(wide**2, axis=1).ravel()))))[::-1]
        return (self.top - least / (2 * self.top)) + 1e-9 * self.top

    def collisions(self, centres: np.ndarray, spec: CollisionSpec) -> np.ndarray:
        """For some queries at once, how often each vector lies in a window around their centres, over all projections and rounds: a row for each query.

        Windows around one centre are nested runs of a sorted array, so their number is filled in from the widest to the
        narrowest and read at each vector's place. Sums of bytes go to wider ones before they can overflow.
        """
        n, q, half = len(self.ids), len(centres), np.sort(spec.widths)
        total, part = np.zeros((q, n), np.uint16), np.zeros((q, n), np.uint8)
        inside, read = np.empty(n, np.uint8), np.empty(n, np.uint8)
        held = 255 // len(half)
        for i, (values, place, sd) in enumerate(zip(self.sorted, self.places, self.spread, strict=True)):
            c = centres[:, i, None]
            first = np.searchsorted(values, (c - half * sd).astype(np.float32)).tolist()
            last = np.searchsorted(values, (c + half * sd).astype(np.float32), side="right").tolist()
            for j in range(q):
                inside[:] = 0
                for k in range(len(half) - 1, -1, -1):
                    inside[first[j][k] : last[j][k]] = len(half) - k
                part[j] += np.take(inside, place, out=read, mode="clip")
            if i % held == held - 1 or i == len(self.places) - 1:
                total += part
                part[:] = 0
        return total

    def nearest(self, queries: np.ndarray, lengths: np.ndarray, directions: np.ndarray, best: Best, spec: CollisionSpec) -> None:
        """Bring to ``best`` all vectors of the block that are among the nearest of a query; ``directions``: queries of length 1 in the projections' basis."""
        ceilings = self.ceilings(spec)
        live = np.flatnonzero(lengths * self.top * (1 + 1e-9) >= best.limits)
        for at in range(0, len(live), 64):
            some = live[at : at + 64]
            counts, thresholds, rest = self.collisions(directions[some] * self.top, spec), [], []
            for j, (i, count) in enumerate(zip(some.tolist(), counts, strict=True)):
                threshold, due = 0, max(spec.least, int(spec.share * len(count)))
                if due < len(count):
                    passing = np.cumsum(np.bincount(count)[::-1])
                    threshold = len(passing) - 1 - int(np.searchsorted(passing, due))
                self.verify(i, np.flatnonzero(count >= threshold), queries, best)
                thresholds.append(threshold)
                if int(np.searchsorted(ceilings, best.limits[i] / lengths[i])) < threshold:
                    rest.append(j)
            if rest:
                # the product of all rows is faster than picking rows, and its rounding is allowed for
                products = queries[some[rest]] @ self.vectors.T
                for j, product in zip(rest, products, strict=True):
                    i = int(some[j])
                    found = np.flatnonzero(product >= best.limits[i] - 1e-9 * self.top * lengths[i])
                    lower = counts[j][found]
                    reached = int(np.searchsorted(ceilings, best.limits[i] / lengths[i]))
                    self.verify(i, found[(lower < thresholds[j]) & (lower >= reached)], queries, best)

    def verify(self, i: int, found: np.ndarray, queries: np.ndarray, best: Best) -> None:
        found = found[self.ids[found] != best.own[i]]
        if len(found):
            best.add(i, self.ids[found], (self.vectors[found] * queries[i]).sum(1))


class Best:
    """The ``k`` best vectors of each query so far, ties by the smaller id; ``limits``: the scores below which nothing enters."""

    def __init__(self, own: np.ndarray, k: int):
        self.own, self.k = own, k
        self.ids, self.scores = [np.empty(0, np.int64)] * len(own), [np.empty(0)] * len(own)
        self.limits = np.full(len(own), -np.inf)

    def add(self, i: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate((self.ids[i], ids)), np.concatenate((self.scores[i], scores))
        if len(scores) > 4 * self.k:  # ties at the edge stay
            at = np.flatnonzero(scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k])
            ids, scores = ids[at], scores[at]
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[i], self.scores[i] = ids[order], scores[order]
        if len(order) == self.k:
            self.limits[i] = self.scores[i][-1]


def _search(index: DataFrame, ids: np.ndarray, queries: np.ndarray, spec: CollisionSpec) -> DataFrame:
    dim = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.linalg.norm(queries, axis=1)
        directions = np.column_stack((queries / lengths[:, None], np.zeros(len(queries)))) @ _basis(dim, spec)
        best = Best(ids, spec.k)
        for batch in batches:
            for row in batch.to_pylist():
                Block(row, dim).nearest(queries, lengths, directions, best, spec)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, [len(x) for x in best.ids])), pa.array(np.concatenate(best.ids)), pa.array(np.concatenate(best.scores))], ["query_id", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, is_query: str, spec: CollisionSpec = CollisionSpec(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that meets the SQL condition ``is_query`` on id, its ``k`` nearest other rows.

    All rows are indexed and searched; queries go to all blocks in blocks of bounded size, one after the other. Nearness is the inner product in
    double precision, ties go to the smaller id. Vectors that aren't usable, and those of another length than the one of the smallest usable
    id, take no part; with fewer candidates than ``k`` all are returned, with none nothing. Repeated rows are candidates each by itself,
    but no row with the query's id is. Columns other than the id and the vector are not looked at.
    """
    rows = usable(vectors, id_col, vec_col)
    first = rows.agg(F.min_by(F.size("v"), "id").alias("dim")).first()
    if first is None or first["dim"] is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = first["dim"]
    rows = written(rows.where(F.size("v") == dim), "vectors")
    index = written(build_index(rows, dim, spec), "collision-index")
    asked = rows.where(is_query)
    parts = max(1, -(-asked.count() // spec.query_block))
    found = []
    for k in range(parts):
        mine = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        got = mine.toArrow().sort_by("id")
        if got.num_rows:
            ids = got.column("id").to_numpy()
            matrix = np.array(got.column("v").combine_chunks().flatten().to_numpy()).reshape(-1, dim)
            found.append(written(_search(index, ids, matrix, spec), "nearest"))  # so that one block of queries at a time is on the driver
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= spec.k)
    return ranked.select("query_id", "rank", "vec_id", "score")
