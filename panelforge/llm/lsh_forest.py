"""MinHash near-duplicate detection with an LSH forest.

Every distinct shingle set gets a MinHash signature. A *tree* of the forest is the table of
all signatures, sorted by one fixed selection of signature columns. Rows that agree on the
first ``min_depth`` columns form a region. In a small region all rows are candidates of each
other; in a larger one the depth adapts: rows are sorted by further columns, so the nearest
rows are those with the longest common prefix, and these become candidates. Candidates are
confirmed on the full shingle sets, and the confirmed links are closed to components.
Larger regions that still hold several components get an exact pass: a prefix-filter join of
their rows' rarest shingles gives every pair that can be similar enough and isn't in one component yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import WordHashes, bounded_broadcast, join_one, mix64, signed, written
from panelforge.llm.components import connected_components


@dataclass(frozen=True)
class ForestSpec:
    """``percent``: link when 100 * intersection >= percent * union. ``region``: largest region whose rows are all compared. ``neighbours``: next rows compared in larger ones before the exact pass."""

    words: int = 5
    percent: int = 80
    columns: int = 96
    trees: int = 20
    min_depth: int = 4
    region: int = 8
    neighbours: int = 2
    seed: int = 20

    def orders(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return np.array([rng.permutation(self.columns)[: self.min_depth + 4] for _ in range(self.trees)])

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed + 1)
        odd = rng.integers(0, 2**31, self.columns, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        return odd, rng.integers(0, 2**32, self.columns, dtype=np.uint32)

    def least_linked(self) -> int:
        """Smaller sets can be linked to equal sets only: n / (n + 1) is below the threshold."""
        n = 1
        while 100 * n < self.percent * (n + 1):
            n += 1
        return n


def shingle_set(text: bytes | None, words: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z lower-cased; fewer words give one shingle, none give none."""
    tokens = memo.of(text.lower().split()) if text else np.empty(0, np.uint64)
    if not len(tokens):
        return tokens
    k = min(words, len(tokens))
    m = len(tokens) - k + 1
    value = np.full(m, k, np.uint64)
    for i in range(k):
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + tokens[i : i + m])
    value.sort()
    return value[np.concatenate(([True], value[1:] != value[:-1]))]


def _signature(shingles: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(odd), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (low[at : at + 2048, None] * odd + add).min(0), out=least)
    return least


def signatures(docs: DataFrame, spec: ForestSpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_key, sig) of every row; a text without words has n_shingles 0 and no key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (odd, add) = WordHashes(), spec.coefficients()
        for batch in batches:
            size, key, sig = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), spec.words, memo)
                size.append(len(s))
                key.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                sig.append(_signature(s, odd, add).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def forest_rows(reps: DataFrame, spec: ForestSpec) -> DataFrame:
    """(region, tail, id, n) for each representative and tree: the hash of its prefix of ``min_depth`` columns, and the next four columns as a sort key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = spec.orders()
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(n, spec.columns).astype(np.uint64)
            ids, sizes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for tree, order in enumerate(orders):
                region = np.full(n, tree + 1, np.uint64)
                for c in order[: spec.min_depth]:
                    region = mix64(region * np.uint64(0x9E3779B97F4A7C15) + sig[:, c])
                tail = np.zeros(n, np.uint64)
                for c in order[spec.min_depth :]:
                    tail = (tail << np.uint64(16)) | (sig[:, c] >> np.uint64(16))
                yield pa.RecordBatch.from_arrays([pa.array(signed(region)), pa.array(signed(tail)), pa.array(ids), pa.array(sizes)], ["region", "tail", "id", "n"])

    return reps.select("id", "n", "sig").mapInArrow(run, "region long, tail long, id long, n long")


NEAR = "kind int, region long, a long, b long, part int, place int"
PAIR, CROWDED, EDGE = 0, 1, 2


def near_rows(rows: DataFrame, spec: ForestSpec) -> DataFrame:
    """What the sorted forest gives, in one table: candidate pairs (kind PAIR: a, b), rows of regions too large to compare whole (CROWDED: region, a),
    and the two first and last rows of each range (EDGE: region, a, part, place).

    The forest is sorted by region and tail in ranges, so that a region of many rows is spread over tasks. A region that
    reaches over the edge of a range counts as too large.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        region, ids, n = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 2, 3))

        def rows_of(kind: int, region, a, b=None, place=None) -> pa.RecordBatch:
            m = len(a)
            cells = (np.full(m, kind, np.int32), region, a, a if b is None else b, np.full(m, part, np.int32), np.zeros(m, np.int32) if place is None else place)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cells], [c.split()[0] for c in NEAR.split(", ")])

        total = len(ids)
        heads = np.flatnonzero(np.concatenate(([True], region[1:] != region[:-1])))
        sizes = np.diff(np.append(heads, total))
        crowded = sizes > spec.region
        crowded[[0, -1]] = True
        of_row = np.repeat(crowded, sizes)
        for step in range(1, spec.region):
            ok = region[step:] == region[:-step]
            if step > spec.neighbours:
                ok &= np.repeat(sizes <= spec.region, sizes)[step:]
            ok &= (100 * np.minimum(n[step:], n[:-step]) >= spec.percent * np.maximum(n[step:], n[:-step])) & (ids[step:] != ids[:-step])
            at = np.flatnonzero(ok)
            if len(at):
                yield rows_of(PAIR, region[at], np.minimum(ids[at], ids[at + step]), np.maximum(ids[at], ids[at + step]))
        at = np.flatnonzero(of_row)
        yield rows_of(CROWDED, region[at], ids[at])
        at = np.unique(np.concatenate((np.arange(min(2, total)), np.arange(max(0, total - 2), total))))
        yield rows_of(EDGE, region[at], ids[at], place=at.astype(np.int32))

    ordered = rows.repartitionByRange("region", "tail", "id").sortWithinPartitions("region", "tail", "id")
    return ordered.mapInArrow(run, NEAR)


def candidate_pairs(near: DataFrame) -> DataFrame:
    """(a, b), a < b, once each: the pairs of ``near`` (written), and those of the last rows of a range and the first ones of the next (two each, so few that one task orders them)."""
    by = W.orderBy("part", "place")
    edges = near.where(F.col("kind") == EDGE).withColumn("after", F.array(*(F.lead(F.struct("region", "a"), i).over(by) for i in (1, 2, 3))))
    over = edges.select("region", "a", F.explode("after").alias("x")).where("x.region = region and x.a != a").select(F.least("a", "x.a").alias("a"), F.greatest("a", "x.a").alias("b"))
    return near.where(F.col("kind") == PAIR).select("a", "b").union(over).distinct()


def shingle_sets(ids: DataFrame, docs: DataFrame, spec: ForestSpec, id_col: str, text_col: str) -> DataFrame:
    """(id, shingles) of the documents of ``ids`` (a written table), written."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            made = [shingle_set(x.as_py(), spec.words, memo).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["id", "shingles"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return written(texts.join(bounded_broadcast(ids), "id").mapInArrow(sets, "id long, shingles binary"), "candidate-sets")


def similar_pairs(pairs: DataFrame, full: DataFrame, spec: ForestSpec) -> DataFrame:
    """Those of ``pairs`` whose sets in ``full`` are similar enough."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= spec.percent * (len(both) - common))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = full.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    two = full.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    return pairs.join(one, "b").join(two, "a").select("a", "b", "sa", "sb").mapInArrow(similar, "a long, b long")


def confirm(pairs: DataFrame, docs: DataFrame, spec: ForestSpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those of ``pairs`` (a written table) whose full shingle sets are similar enough."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "candidate-ids")
    return similar_pairs(pairs, shingle_sets(ids, docs, spec, id_col, text_col), spec)


#: Hash buckets of shingle counts. Counts only choose the order of shingles, which is right in any order and fast with rare ones first.
COUNT_BITS = 20


def rarest_shingles(full: DataFrame, spec: ForestSpec) -> DataFrame:
    """(token, id, n, most): the first shingles of each set of ``full`` (id, shingles), rare ones first, and the largest other set that can be linked if this is the first common one.

    With k shingles before it a set of n has n - k in common at most, and a link with a set of m needs percent * (n + m) / (100 + percent).
    Shingles by which no size can be linked are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) >> np.uint64(64 - COUNT_BITS)
            bucket, n = np.unique(seen.astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n.astype(np.int64))], ["bucket", "n"])

    counted = full.select("shingles").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    held = np.zeros(1 << COUNT_BITS, np.int64)
    held[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    counts = full.sparkSession.sparkContext.broadcast(held)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(x.as_py(), np.uint64)
                n = len(x)
                x = x[np.lexsort((x, counts.value[x >> np.uint64(64 - COUNT_BITS)]))]
                most = (100 + spec.percent) * (n - np.arange(n)) // spec.percent - n
                k = int((100 * most >= spec.percent * n).sum())
                yield pa.RecordBatch.from_arrays([pa.array(signed(x[:k])), pa.array(np.full(k, i, np.int64)), pa.array(np.full(k, n, np.int64)), pa.array(most[:k])], ["token", "id", "n", "most"])

    return full.select("id", "shingles").mapInArrow(first, "token long, id long, n long, most long")


def crowded_pairs(crowd: DataFrame, full: DataFrame, spec: ForestSpec, salted_from: int = 2000) -> DataFrame:
    """(a, b), once each: all pairs of different components in ``crowd`` (id, component) that can be linked, by exact bounds on ``full`` (id, shingles).

    The smaller set meets the larger one at their first common shingle. Shingles of one component only are left out, and a
    shingle of many sets is dealt over several tasks.
    """
    rows = written(rarest_shingles(full, spec).join(bounded_broadcast(crowd), "id"), "rare-shingles")
    of_token = rows.groupBy("token").agg(F.count("*").alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.col("most") >= F.col("n")).alias("met"))
    shared = written(of_token.where("met and low < high").select("token", F.ceil(F.col("rows") / salted_from).cast("int").alias("salts")), "shared-shingles")
    rows = rows.join(bounded_broadcast(shared), "token")
    small = rows.where("most >= n").select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("x"), F.col("n").alias("nx"), F.col("most").alias("mx"), F.col("component").alias("cx"))
    large = rows.select("token", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("y"), F.col("n").alias("ny"), F.col("most").alias("my"), F.col("component").alias("cy"))
    met = small.join(large, ["token", "salt"]).where(f"cx != cy and (nx < ny or nx = ny and x < y) and ny <= mx and nx <= my and 100 * nx >= {spec.percent} * ny")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def join_crowded(near: DataFrame, parts: DataFrame, docs: DataFrame, spec: ForestSpec, id_col: str, text_col: str) -> DataFrame:
    """``parts`` (id, component) after the exact pass over the crowded regions of ``near`` that hold several components."""
    rows = join_one(near.where(F.col("kind") == CROWDED).select("region", F.col("a").alias("id")), parts, "id", left=True).select("region", "id", F.coalesce("component", "id").alias("component"))
    rows = written(rows, "crowded")
    mixed = written(rows.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("region"), "crowded-regions")
    crowd = written(join_one(rows, mixed, "region").select("id", "component").distinct(), "crowd")
    if not crowd.limit(1).count():
        return parts
    full = shingle_sets(written(crowd.select("id"), "crowd-ids"), docs, spec, id_col, text_col)
    pairs = written(crowded_pairs(crowd, full, spec), "crowded-pairs")
    links = written(similar_pairs(pairs, full, spec), "crowded-links")
    of = bounded_broadcast(crowd)
    ends = links.join(of.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    joined = written(connected_components(ends, "ca", "cb").select(F.col("id").alias("component"), F.col("component").alias("least")), "joined-components")
    every = written(parts.union(crowd.select("id", "component")).distinct(), "parts")
    return join_one(every, joined, "component", left=True).select("id", F.coalesce("least", "component").alias("component"))


def near_duplicates(docs: DataFrame, spec: ForestSpec = ForestSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Equal sets are one representative (their smallest id) before the forest, so groups of copies
    cost no pairs. Rows of regions too large to compare whole are joined exactly. A null or empty text has no shingles and stays alone; a text of any length
    is read whole (its set is held by one task). Ties of similarity at the threshold are links. A null id takes no part: component_id null, kept false. Repeated rows are rows with equal texts; an empty table gives none.
    Columns other than the id and the text are not looked at.
    """
    sigs = written(signatures(docs, spec, id_col, text_col), "signatures")
    sets = sigs.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("m"), F.count("*").alias("copies"))
    reps = written(sets.select("set_key", "copies", F.col("m.doc_id").alias("id"), F.col("m.n_shingles").alias("n"), F.col("m.sig").alias("sig")), "representatives")
    near = written(near_rows(forest_rows(reps.where(F.col("n") >= spec.least_linked()), spec), spec), "near")
    pairs = written(candidate_pairs(near), "candidates")
    links = confirm(pairs, docs, spec, id_col, text_col)
    parts = written(connected_components(links), "components")
    parts = join_crowded(near, parts, docs, spec, id_col, text_col).select(F.col("id").alias("rep"), "component")
    found = join_one(reps.select("set_key", "copies", F.col("id").alias("rep")), written(parts, "roots"), "rep", left=True).withColumn("root", F.coalesce("component", "rep"))
    moved = written(found.where("copies > 1 or root != rep").select("set_key", "root"), "set-roots")  # every other document is its own root
    out = join_one(sigs.select("doc_id", "n_shingles", "set_key"), moved, "set_key", left=True)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
