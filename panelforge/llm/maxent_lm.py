"""A hashed maximum-entropy language model with a class-factored softmax.

log P(word | history) = log P(class | history) + log P(word | class, class before). The class distribution is a softmax over hashed
features: the word before, the one before that (a skip feature) and the pair of both. Within a class, words have a softmax of
their smoothed counts and a feature for each pair of a word and the class of the word before it. Frequent words, at most ``head`` of them, have classes of about equal mass; all other
words belong to one of four classes by their hash: words seen once teach these classes where unknown ones stand.

Training is distributed. For classes, tasks sum gradients over all their training tokens, Spark adds them up by feature, and the driver
applies one update a round; the number of features grows with the square root of the corpus. The first round starts from class frequencies, where the gradient
is a table of counts; further ones use the model's own expectations. Within classes, features and their weights are a table that
grows with the corpus, and every update is a query over it. Word counts cover the whole corpus and stay distributed: only the bounded head
is sent to the tasks, the tail is joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import WordHashes, mix64, written

NO_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class LmSpec:
    """``held``: remainder of crc32(id as text) mod 7 that is not trained on. ``rounds``: gradient rounds after the first, of classes; ``inner_rounds``: those of words within classes, whose features are of words seen ``inner_least`` times or more.
    ``unigrams`` and ``pairs``: hashed features of a word and of a pair of words (at least; they are set from the number of tokens)."""

    held: int = 2
    head: int = 1 << 17
    head_classes: int = 15
    unigrams: int = 1 << 13
    pairs: int = 1 << 14
    rounds: int = 2
    inner_rounds: int = 3
    inner_least: int = 1
    inner_shrink: float = 30.0
    inner_ridge: float = 3.0
    shrink: float = 20.0
    start_share: float = 0.5
    rate: float = 0.5
    block_words: int = 1 << 20

    def sized(self, tokens: int) -> LmSpec:
        """With hashed features in proportion to the square root of the number of training tokens."""
        bits = max(0, int(tokens).bit_length() // 2)
        return replace(self, unigrams=max(self.unigrams, 1 << bits), pairs=max(self.pairs, 2 << bits))

    @property
    def classes(self) -> int:
        return 1 + self.head_classes + 4

    @property
    def features(self) -> int:
        return 1 + 2 * self.unigrams + self.pairs


BLOCK = "block long, doc_ids binary, trains binary, sizes binary, words binary, codes binary"


def encode(docs: DataFrame, spec: LmSpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of whole documents: their ids, whether they train, numbers of words, the block's distinct words (hashes) and each token's place among them. Documents with a null id don't train."""

    def pack(number: int, ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
        words, codes = np.unique(np.concatenate(parts), return_inverse=True)
        trains = np.array([i is not None and zlib.crc32(str(i).encode()) % 7 != spec.held for i in ids])
        cells = [np.array([NO_ID if i is None else i for i in ids], np.int64), trains, np.array([len(p) for p in parts], np.int64), words, codes.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], [c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, made, total = WordHashes(), 0, 0
        first = TaskContext.get().partitionId() << 32
        ids: list = []
        parts: list[np.ndarray] = []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(i)
                parts.append(memo.of(text.lower().split()) if text else np.empty(0, np.uint64))
                total += len(parts[-1]) + 8
                if total >= spec.block_words:
                    yield pack(first + made, ids, parts)
                    made, total, ids, parts = made + 1, 0, [], []
        if ids:
            yield pack(first + made, ids, parts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, BLOCK)


class Block:
    def __init__(self, row: dict):
        self.number = row["block"]
        self.ids, self.sizes = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.trains = np.frombuffer(row["trains"], np.bool_)
        self.words, self.codes = np.frombuffer(row["words"], np.uint64), np.frombuffer(row["codes"], np.int32)

    def train_counts(self) -> np.ndarray:
        return np.bincount(self.codes[np.repeat(self.trains, self.sizes)], minlength=len(self.words))

    def with_ends(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of all tokens with an end (code -1) after each document, the tokens' documents, and the documents' first places."""
        lengths = self.sizes + 1
        owner = np.repeat(np.arange(len(lengths)), lengths)
        last = np.cumsum(lengths) - 1
        out = np.full(len(owner), -1, np.int64)
        inner = np.ones(len(owner), bool)
        inner[last] = False
        out[inner] = self.codes
        return out, owner, last - self.sizes


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block({c: batch.column(c)[i].as_py() for c in batch.schema.names})


def word_counts(blocks: DataFrame) -> DataFrame:
    """(word, c): occurrences in training documents, c > 0; pre-aggregated by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            c = b.train_counts()
            yield pa.RecordBatch.from_arrays([pa.array(b.words[c > 0].view(np.int64)), pa.array(c[c > 0])], ["word", "c"])

    return blocks.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """What tasks need: the head (sorted hashes, counts, classes), masses of the classes, weights, the corpus totals, and for words within
    classes the head's weights by class before (``inner``) and the logs of the sums that divide (``norms``, by class and class before)."""

    words: np.ndarray
    counts: np.ndarray
    kinds: np.ndarray
    mass: np.ndarray
    weights: np.ndarray
    n_tokens: int
    n_types: int
    n_ends: int
    spec: LmSpec
    inner: np.ndarray | None = None
    norms: np.ndarray | None = None

    @property
    def bounds(self) -> int:
        return 1 + self.spec.head_classes

    def look_up(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word of a block, and its count; -1 in the tail."""
        at = np.minimum(np.searchsorted(self.words, b.words), max(0, len(self.words) - 1))
        known = self.words[at] == b.words if len(self.words) else np.zeros(len(b.words), bool)
        kinds = np.where(known, self.kinds[at] if len(self.words) else 0, 1 + self.spec.head_classes + (b.words >> np.uint64(62)).astype(np.int64))
        return kinds, np.where(known, self.counts[at] if len(self.words) else 0, -1)

    def contexts(self, b: Block, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The three hashed features of each token's history."""
        spec = self.spec
        h = np.where(tokens >= 0, b.words[np.maximum(tokens, 0)] if len(b.words) else np.uint64(0), np.uint64(1))
        one, two = np.roll(h, 1), np.roll(h, 2)
        one[starts], two[starts] = 2, 2
        second = starts + 1
        two[second[second < len(h)]] = 2
        one, two = mix64(one), mix64(two + np.uint64(0x9E3779B97F4A7C15))
        f1 = 1 + (one % np.uint64(spec.unigrams)).astype(np.int64)
        f2 = 1 + spec.unigrams + (two % np.uint64(spec.unigrams)).astype(np.int64)
        f3 = 1 + 2 * spec.unigrams + (mix64(one ^ (two * np.uint64(3))) % np.uint64(spec.pairs)).astype(np.int64)
        return np.stack((f1, f2, f3))

    def classes_of(self, tokens: np.ndarray, kinds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's class and the class before it; an end stands before a document."""
        y = np.where(tokens >= 0, kinds[np.maximum(tokens, 0)] if len(kinds) else 0, 0)
        before = np.roll(y, 1)
        before[starts] = 0
        return y, before

    def log_classes(self, f: np.ndarray) -> np.ndarray:
        z = self.weights[0] + self.weights[f[0]] + self.weights[f[1]] + self.weights[f[2]]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _gradient(blocks: DataFrame, model: Model, first: bool) -> np.ndarray:
    """Sums over training tokens, by feature and class: observed counts (``first``) or the model's expectations. Tasks add up their own tokens before Spark adds up tasks."""
    spec = model.spec
    size, kinds_n = spec.features, spec.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * kinds_n)
        for b in _rows(batches):
            tokens, owner, starts = b.with_ends()
            kinds, _ = model.look_up(b)
            use = b.trains[owner]
            f = model.contexts(b, tokens, starts)[:, use]
            y = np.where(tokens >= 0, kinds[np.maximum(tokens, 0)] if len(kinds) else 0, 0)[use]
            if first:
                total[:kinds_n] += np.bincount(y, minlength=kinds_n)
                for row in f:
                    total += np.bincount(row * kinds_n + y, minlength=len(total))
            else:
                grid = total.reshape(size, kinds_n)
                for at in range(0, f.shape[1], 1 << 17):
                    part = f[:, at : at + (1 << 17)]
                    p = np.exp(model.log_classes(part))
                    for c in range(kinds_n):
                        column = np.ascontiguousarray(p[:, c])
                        grid[0, c] += column.sum(dtype=np.float64)
                        for row in part:
                            grid[:, c] += np.bincount(row, weights=column, minlength=size)
        grid = total.reshape(size, kinds_n)
        some = np.flatnonzero(grid.any(1))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(np.ascontiguousarray(grid[some, c]).astype(np.float32)) for c in range(kinds_n))], ["f", *(f"g{c}" for c in range(kinds_n))])

    names = [f"g{c}" for c in range(kinds_n)]
    rows = blocks.mapInArrow(run, "f long, " + ", ".join(f"{n} float" for n in names)).groupBy("f").agg(*(F.sum(n).alias(n) for n in names))
    out = np.zeros((size, kinds_n))
    got = rows.toArrow()
    if got.num_rows:
        out[got.column("f").to_numpy()] = np.stack([got.column(n).to_numpy() for n in names], 1)
    return out


def pair_counts(blocks: DataFrame, model: Model) -> DataFrame:
    """(word, kind, before, n): how often each word stands after a word of each class, in training documents; pre-aggregated by block. Ends are left out, as their class has one member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            tokens, owner, starts = b.with_ends()
            kinds, _ = model.look_up(b)
            _, before = model.classes_of(tokens, kinds, starts)
            use = b.trains[owner] & (tokens >= 0)
            size = model.spec.classes
            key, n = np.unique(tokens[use] * size + before[use], return_counts=True)
            word = key // size
            yield pa.RecordBatch.from_arrays([pa.array(b.words[word].view(np.int64)), pa.array(kinds[word].astype(np.int32)), pa.array((key % size).astype(np.int32)), pa.array(n)], ["word", "kind", "before", "n"])

    return blocks.mapInArrow(run, "word long, kind int, before int, n long").groupBy("word", "kind", "before").agg(F.sum("n").alias("n"))


def train_inner(pairs: DataFrame, counts: DataFrame, model: Model) -> DataFrame:
    """(word, kind, before, weight): weights of the features of words within classes; sets ``model.norms``.

    ``pairs``: a written table of ``pair_counts``. A word's share of its class is (c + 1) exp(weight), divided by the sum over the class; an unknown
    word has one of its class. Weights start from smoothed counts; each round adds the gradient, observed less expected counts less the penalty's, over its curvature.
    """
    spec, size = model.spec, model.spec.classes
    several = counts.where(F.col("c") >= spec.inner_least)
    rows = written(pairs.join(several, "word").select("word", "kind", "before", "n", (F.col("c") + 1.0).alias("base")), "word-features")
    met = np.zeros((size, size))
    for r in pairs.groupBy("kind", "before").agg(F.sum("n").alias("n")).collect():
        met[r["kind"], r["before"]] = r["n"]
    of = lambda grid: F.lit(grid.ravel().tolist())[F.col("kind") * size + F.col("before")]
    mass = np.repeat(model.mass[:, None], size, 1)
    share = F.col("base") / of(mass)
    made = rows.withColumn("total", of(met)).withColumn("weight", F.log((F.col("n") + spec.inner_shrink * share) / ((F.col("total") + spec.inner_shrink) * share)))
    for k in range(spec.inner_rounds + 1):  # weights follow from the counts and the rounds' sums, so rounds write nothing
        z = mass.copy()
        for r in made.groupBy("kind", "before").agg(F.sum(F.col("base") * (F.exp("weight") - 1)).alias("z")).collect():
            z[r["kind"], r["before"]] += r["z"]
        model.norms = np.log(np.maximum(z, 1))
        if k < spec.inner_rounds:
            p = F.col("base") * F.exp("weight") / of(z)
            step = spec.rate * (F.col("n") - F.col("total") * p - spec.inner_ridge * F.col("weight")) / (F.col("total") * p * (1 - p) + spec.inner_ridge)
            made = made.withColumn("weight", F.col("weight") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), step)))
    return written(made.select("word", "kind", "before", "weight"), "word-weights")


def train(blocks: DataFrame, counts: DataFrame, spec: LmSpec = LmSpec()) -> tuple[Model, DataFrame]:
    """The model with its head, and the table of all other training words (word, c, weights by class before)."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array([int(b.trains.sum())])], ["n"])

    n_ends = blocks.select("block", "doc_ids", "trains", "sizes", F.lit(b"").alias("words"), F.lit(b"").alias("codes")).mapInArrow(ends, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    least, so_far = 1 << 62, 0
    for c, n in ((r["c"], r["n"]) for r in counts.where("c > 1").groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator()):
        if so_far + n > spec.head:
            break
        least, so_far = c, so_far + n
    head = counts.where(F.col("c") >= least).toArrow()
    words, c = head.column("word").to_numpy().view(np.uint64), head.column("c").to_numpy()
    order = np.lexsort((words, -c))
    share = (np.cumsum(c[order]) - c[order]) / max(1, c.sum())
    kinds = np.empty(len(c), np.int64)
    kinds[order] = 1 + np.minimum((share * spec.head_classes).astype(np.int64), spec.head_classes - 1)
    tail = {r["k"]: r["m"] for r in counts.where(F.col("c") < least).groupBy(F.shiftrightunsigned("word", 62).alias("k")).agg(F.sum(F.col("c") + 1).alias("m")).collect()}
    spec = spec.sized(totals["n"])
    mass = np.zeros(spec.classes)
    mass[0] = n_ends + 1
    mass[1 : 1 + spec.head_classes] = np.bincount(kinds - 1, weights=c + 1.0, minlength=spec.head_classes)
    mass[1 + spec.head_classes :] = [tail.get(k, 0) + 1 for k in range(4)]
    by_word = np.argsort(words)
    n, v = totals["n"] + n_ends, totals["v"] + (n_ends > 0)
    model = Model(words[by_word], c[by_word], kinds[by_word], np.maximum(mass, 1), np.zeros((spec.features, spec.classes), np.float32), n, v, n_ends, spec)
    seen = _gradient(blocks, model, True)
    used = mass > 0
    prior = (seen[0] + 1e-3 * used + 1e-12) / (seen[0].sum() + 1e-3 * used.sum() + 1e-12 * len(used))
    per_feature = seen.sum(1, keepdims=True)
    weights = spec.start_share * np.log((seen + spec.shrink * prior) / ((per_feature + spec.shrink) * prior))
    weights[0] = np.log(prior)
    for _ in range(spec.rounds):
        model.weights = weights.astype(np.float32)
        expected = _gradient(blocks, model, False)
        bend = per_feature * prior * (1 - prior)
        weights = weights + spec.rate * (seen - expected) / (bend + spec.shrink)
    model.weights = np.where(used, weights, -60.0).astype(np.float32) if not used.all() else weights.astype(np.float32)
    inner = train_inner(written(pair_counts(blocks, model), "pair-counts"), counts, model)
    grid = np.zeros((len(model.words), spec.classes), np.float32)
    got = inner.where(F.col("kind") < model.bounds).select("word", "before", "weight").toArrow()  # of the head, so at most its words times the classes
    if got.num_rows:
        grid[np.searchsorted(model.words, got.column("word").to_numpy().view(np.uint64)), got.column("before").to_numpy()] = got.column("weight").to_numpy()
    model.inner = grid
    rare = inner.where(F.col("kind") >= model.bounds).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("before", "weight"))).alias("weights"))
    return model, counts.where(F.col("c") < least).join(rare, "word", "left")


def score(blocks: DataFrame, model: Model, tail: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    base_score adds up log10((c + 1) / (N + V + 1)) over its tokens and end, score the model's log10 probabilities. An empty
    or null text is its end alone; equal rows are scored alike, each by itself; an empty table gives none.
    """
    spec = model.spec

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            tokens, owner, starts = b.with_ends()
            kinds, c = model.look_up(b)
            inner = tokens >= 0
            at = np.maximum(tokens, 0)
            y, before = model.classes_of(tokens, kinds, starts)
            if len(model.words) and len(c):
                row = np.minimum(np.searchsorted(model.words, b.words), len(model.words) - 1)[at]
                own = np.where(inner & (c[at] >= 0), model.inner[row, before], 0)
            else:
                own = np.zeros(len(y))
            count = np.where(inner, c[at] if len(c) else 0, model.n_ends)
            f = model.contexts(b, tokens, starts)
            lp = np.empty(len(y))
            for k in range(0, len(y), 1 << 17):
                part = slice(k, k + (1 << 17))
                lp[part] = model.log_classes(f[:, part])[np.arange(len(y[part])), y[part]]
            logs = np.log10(np.maximum(count, 0) + 1.0)
            sums = [np.add.reduceat(x, starts) for x in (logs, (lp + own - np.where(inner, model.norms[y, before], np.log(model.mass[0]))) / np.log(10), (count > 0).astype(np.int64))]
            n = len(b.ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b.number)), pa.array(np.arange(n, dtype=np.int32)), pa.array(b.ids, mask=b.ids == NO_ID), pa.array(~b.trains), pa.array(b.sizes + 1), *map(pa.array, sums)], ["block", "place", "doc_id", "held_out", "n_tokens", "logs", "model", "known"])

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _rows(batches):
            kinds, c = model.look_up(b)
            tokens, owner, starts = b.with_ends()
            _, before = model.classes_of(tokens, kinds, starts)
            rare = np.flatnonzero((tokens >= 0) & (c[np.maximum(tokens, 0)] < 0)) if len(c) else np.empty(0, np.int64)
            size = model.spec.classes
            key, times = np.unique((owner[rare] * len(b.words) + tokens[rare]) * size + before[rare], return_counts=True)
            pair, before = key // size, (key % size).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), b.number)), pa.array((pair // max(1, len(b.words))).astype(np.int32)), pa.array(b.words[pair % max(1, len(b.words))].view(np.int64)), pa.array(before), pa.array(times)], ["block", "place", "word", "before", "times"])

    docs = blocks.mapInArrow(heads, "block long, place int, doc_id long, held_out boolean, n_tokens long, logs double, model double, known long")
    rare = blocks.mapInArrow(tails, "block long, place int, word long, before int, times long").join(tail, "word")
    weight = F.coalesce(F.try_element_at("weights", F.col("before")), F.lit(0.0)) / np.log(10)
    rare = rare.groupBy("block", "place").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum(F.col("times") * weight).alias("inner"), F.sum("times").alias("seen"))
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    base = logs - F.col("n_tokens") * F.log10(F.lit(float(model.n_tokens + model.n_types + 1)))
    return docs.join(rare, ["block", "place"], "left").select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(model.n_tokens).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("model") + logs + F.coalesce("inner", F.lit(0.0))).alias("score"))


def train_and_score(docs: DataFrame, spec: LmSpec = LmSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of all ``docs`` by a model of those whose id trains (see ``LmSpec.held``).

    Null and empty texts are an end alone; a null id doesn't train and is scored as held out; texts of any length are read whole. Repeated rows train as often as
    they stand. Words of equal counts at the head's edge are in it or out of it together. Columns other than the id and the text are not looked at; an empty table gives none.
    """
    blocks = written(encode(docs, spec, id_col, text_col), "token-blocks")
    counts = written(word_counts(blocks), "word-counts")
    model, tail = train(blocks, counts, spec)
    return score(blocks, model, written(tail, "tail"))
