"""Quality scores by co-training.

Two logistic classifiers see different views of a document: its text (a hashed byte-pair profile, repeats, lines and
word forms) and its page metadata (language, source, length, eighths of octaves of the length). In each round every view labels
the unlabelled documents it is sure of, and in any case those of each class it is most confident of, and the other view learns from them: tasks add up gradients over the whole pool, Spark adds up tasks, and
the driver, which holds the labelled rows (a bounded number), makes a step. Labels that make a view worse on labelled documents kept
apart, by more than the error of that measure, are taken back. The views are then calibrated on those documents, and their calibrated log-odds are combined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_broadcast, without_ids, written

PAIR_BUCKETS, FORMS, LANGS, SOURCES, LENGTHS = 256, 9, 8, 16, 128
WIDTHS = (1 + PAIR_BUCKETS + FORMS, 4 + LANGS + SOURCES + LENGTHS)
#: Log-odds are counted in so many steps a unit, from -30 to 30.
STEPS = 64


@dataclass(frozen=True)
class CoTrainSpec:
    """``labelled`` bounds the labelled rows that are fitted on (by a hash of the id); the unlabelled pool is every document without a label. ``confidence``:
    from which a view's label is always handed over. ``quota``: the share of the pool that a view hands over in any case, the most confident of each class in the labels' ratio.
    ``pseudo``: weight of all handed labels against all given ones, at most. ``steps``: passes over the pool in a round, after one that finds the quotas' bounds."""

    labelled: int = 8000
    rounds: int = 2
    steps: int = 2
    confidence: float = 0.97
    quota: float = 0.1
    pseudo: float = 0.5
    threshold: float = 0.3


def _bucket(value: str | None, n: int) -> int:
    return zlib.crc32((value or "").encode()) % n


def features(texts: list[bytes | None], langs: list[str | None], sources: list[str | None], lengths: list[int | None]) -> tuple[np.ndarray, np.ndarray]:
    """The two views of some documents: bytes of the text view's pairs followed by its forms (float32), and float32 rows of the metadata view. Null texts count as empty, null lengths as 0."""
    n = len(texts)
    texts = [t or b"" for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32)
    pairs = np.zeros(n * PAIR_BUCKETS)
    if len(flat) > 1:
        code = ((flat[:-1] * np.uint32(257) + flat[1:]) * np.uint32(2654435761)) >> np.uint32(24)
        owner = np.repeat(np.arange(n, dtype=np.int64), sizes)
        same = owner[:-1] == owner[1:]
        pairs = np.bincount((owner[:-1] * PAIR_BUCKETS + code)[same], minlength=n * PAIR_BUCKETS)
    pairs = np.rint(np.sqrt(pairs.reshape(n, PAIR_BUCKETS) / np.maximum(sizes, 1)[:, None]) * 255).astype(np.uint8)
    words = [t.split() for t in texts]
    again = np.array([sum(map(eq, w, w[1:])) / max(1, len(w) - 1) for w in words])
    lines = [t.split(b"\n") for t in texts]
    n_lines, n_words = np.array([len(x) for x in lines]), np.array([len(w) for w in words])
    distinct = np.array([len(set(x)) / max(1, len(x)) for x in lines])
    variety = np.array([len(set(w)) / max(1, len(w)) for w in words])
    longest = np.array([max(map(len, w), default=0) for w in words])
    short = np.array([sum(len(x) < 2 for x in w) / max(1, len(w)) for w in words])
    forms = (again, np.log1p(n_words) / 10, np.log1p(sizes / n_lines) / 10, distinct, variety, variety * np.log1p(n_words) / 10, np.log1p(longest) / 5, short, sizes / np.maximum(n_words, 1) / 10)
    size = np.log1p(np.array([max(0, x or 0) for x in lengths], float)) / 10
    place = np.zeros((n, LANGS + SOURCES + LENGTHS))
    octave = np.floor(8 * np.log2(np.array([max(0, x or 0) for x in lengths], float) + 1)).astype(int)
    place[np.arange(n), LANGS + SOURCES + np.minimum(octave, LENGTHS - 1)] = 1
    place[np.arange(n), [_bucket(x, LANGS) for x in langs]] = 0.3
    place[np.arange(n), [LANGS + _bucket(x, SOURCES) for x in sources]] = 0.3
    text = np.concatenate((pairs, np.column_stack(forms).astype(np.float32).view(np.uint8).reshape(n, -1)), 1)
    return text, np.column_stack((np.ones(n), size, size**2, size < 0.3, place)).astype(np.float32)


def text_matrix(packed: np.ndarray) -> np.ndarray:
    """Rows of the text view, with the intercept first."""
    forms = np.ascontiguousarray(packed[:, PAIR_BUCKETS:]).view(np.float32)
    return np.concatenate((np.ones((len(packed), 1), np.float32), packed[:, :PAIR_BUCKETS].astype(np.float32) / 255, forms), 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _penalty(width: int, ridge: float) -> np.ndarray:
    """The first column, the intercept, is hardly penalised."""
    out = np.full(width, ridge)
    out[0] = 1e-3
    return out


def _slope_and_bend(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = sigmoid(x @ w)
    return x.T @ (p - y), (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    w, penalty = np.zeros(x.shape[1]), _penalty(x.shape[1], ridge)
    for _ in range(steps):
        slope, bend = _slope_and_bend(x, y, w)
        step = np.linalg.solve(bend + np.diag(penalty), slope + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def learned(x: np.ndarray, y: np.ndarray, w: np.ndarray, n: int, slope: np.ndarray, spec: CoTrainSpec) -> np.ndarray:
    """A Newton step on the labelled rows and on ``n`` handed labels, whose gradients sum up to ``slope``."""
    share = spec.pseudo * min(1.0, len(x) / max(1, n))
    own, bend = _slope_and_bend(x, y, w)
    penalty = _penalty(len(w), 1.0)
    return w - np.linalg.solve(bend * (1 + share * n / len(x)) + np.diag(penalty), own + share * slope + penalty * w)


def calibrated(x: list[np.ndarray], y: np.ndarray, weights: list[np.ndarray]) -> list[np.ndarray]:
    """For each view the offset and slope that make its log-odds fit the labels."""
    return [fit_logistic(np.column_stack((np.ones(len(y)), np.clip(v @ w, -30, 30))), y, 1e-2) for v, w in zip(x, weights, strict=True)]


def worse(x: np.ndarray, y: np.ndarray, new: np.ndarray, old: np.ndarray) -> bool:
    """Whether the log loss of ``new`` weights is above that of ``old`` ones by more than the standard error of the difference."""
    one, other = (np.logaddexp(0, z) - y * z for z in (np.clip(x @ w, -30, 30) for w in (new, old)))
    return bool((one - other).mean() > (one - other).std() / np.sqrt(len(y)))


@dataclass
class CoTrained:
    """Weights of both views, their calibrations (offset, slope), the weights that combine them, how many labels each view was handed in each round, and whether it kept what it learned."""

    views: list[np.ndarray]
    calibration: list[np.ndarray]
    combine: np.ndarray
    handed: list[tuple[int, int]]
    kept: list[tuple[bool, bool]]

    def scores(self, both: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined and both views' probabilities for the rows of ``features``."""
        odds = [np.clip(x @ w, -30, 30) * c[1] + c[0] for x, w, c in zip((text_matrix(both[0]), both[1]), self.views, self.calibration, strict=True)]
        total = self.combine[0] + self.combine[1] * odds[0] + self.combine[2] * odds[1]
        return tuple(sigmoid(z) for z in (total, *odds))  # type: ignore[return-value]


def _rows(docs: DataFrame) -> DataFrame:
    length = F.length(F.col("text").cast("string")).cast("long")
    length = F.coalesce(F.col("n_chars").cast("long"), length) if "n_chars" in docs.columns else length
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), length.alias("length"))


def views(docs: DataFrame) -> DataFrame:
    """(doc_id, t, m) for every document: the packed rows of both views, a few hundred bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                t, m = features(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in t]), pa.array([r.tobytes() for r in m])], ["doc_id", "t", "m"])

    return _rows(docs).mapInArrow(run, "doc_id long, t binary, m binary")


def _unpacked(t: list[bytes], m: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(t), np.uint8).reshape(len(t), -1), np.frombuffer(b"".join(m), np.float32).reshape(len(m), -1)


def limits_of(confidence: float) -> list[tuple[float, float]]:
    """Log-odds up to which and from which either view hands over."""
    z = float(np.log(confidence / (1 - confidence)))
    return [(-z, z)] * 2


def handed_over(x: list[np.ndarray], teachers: list[np.ndarray], limits: list[tuple[float, float]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each view as a pupil: which rows the other view is confident of, by that view's limits, and the labels it gives them. Where both limits hold, the label is by the nearer end."""
    out = []
    for pupil in (0, 1):
        z, (low, high) = x[1 - pupil] @ teachers[1 - pupil], limits[1 - pupil]
        pick = np.flatnonzero((z <= low) | (z >= high))
        out.append((pick, (z[pick] >= high).astype(float)))
    return out


def pool_limits(pool: DataFrame, teachers: list[np.ndarray], calibration: list[np.ndarray], rate: float, spec: CoTrainSpec) -> list[tuple[float, float]]:
    """For each view the log-odds up to which and from which it hands over, counted over the whole pool in fixed steps: all rows that it is sure of by its ``calibration`` (offset, slope), and in any case its quota of each class by the labels' ``rate`` of 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 60 * STEPS + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                t, m = _unpacked(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for k, x in enumerate((text_matrix(t), m)):
                    counts[k] += np.bincount(_step(x @ teachers[k]), minlength=counts.shape[1])
        view, at = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[view, at])], ["view", "at", "n"])

    counts = np.zeros((2, 60 * STEPS + 1), np.int64)
    for r in pool.select("t", "m").mapInArrow(run, "view int, at int, n long").groupBy("view", "at").agg(F.sum("n").alias("n")).collect():  # at most a row a step
        counts[r["view"], r["at"]] = r["n"]
    sure = limits_of(spec.confidence)[0][1]
    out = []
    for n, (offset, slope) in zip(counts, calibration, strict=True):
        upto, total = np.cumsum(n), n.sum()
        low = np.searchsorted(upto, max(1, spec.quota * (1 - rate) * total))  # the first step that fills the quota
        high = max(low + 1, np.searchsorted(upto, total - max(1, spec.quota * rate * total), side="right"))
        low, high = (low + 1) / STEPS - 30, high / STEPS - 30
        if slope > 0:
            low, high = max(low, (-sure - offset) / slope), min(high, (sure - offset) / slope)
        out.append((low, high))
    return out


def _step(z: np.ndarray) -> np.ndarray:
    return np.floor((np.clip(z, -30, 30) + 30) * STEPS).astype(np.int64)


def pool_slopes(pool: DataFrame, teachers: list[np.ndarray], pupils: list[np.ndarray], confidence: float | list[tuple[float, float]]) -> list[tuple[int, np.ndarray]]:
    """For each view, the number of labels it is handed over the whole pool, and the sum of their gradients. ``confidence``: one probability for both views, or both views' limits."""
    limits = limits_of(confidence) if isinstance(confidence, float) else confidence

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 + w) for w in WIDTHS]
        for batch in batches:
            if batch.num_rows:
                t, m = _unpacked(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                x = [text_matrix(t), m]
                for k, (pick, y) in enumerate(handed_over(x, teachers, limits)):
                    own = x[k][pick]
                    sums[k][0] += len(pick)
                    sums[k][1:] += own.T @ (sigmoid(own @ pupils[k]) - y)
        for k in (0, 1):
            n = len(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(sums[k])], ["view", "at", "v"])

    out = [np.zeros(1 + w) for w in WIDTHS]
    for r in pool.select("t", "m").mapInArrow(run, "view int, at int, v double").groupBy("view", "at").agg(F.sum("v").alias("v")).collect():
        out[r["view"]][r["at"]] = r["v"]
    return [(round(v[0]), v[1:]) for v in out]


def train(docs: DataFrame, labels: DataFrame, spec: CoTrainSpec = CoTrainSpec(), seen: DataFrame | None = None) -> CoTrained:
    """Co-train on ``labels`` (doc_id, quality 0 or 1) and on all documents without one; ``seen``: their written ``views``.

    Rows with other values or a null id, and ids that are labelled both ways, are left out. An empty table of documents or labels gives one rate for all. Every fourth row of each label, by the hash, is kept for calibration. Without both
    classes in each part the model is the labels' rate.
    """
    seen = written(views(docs), "views") if seen is None else seen
    y = F.col("quality").cast("double")
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), y.alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top"))
    given = written(given.where("y = top").select("doc_id", "y"), "labels")
    some = written(given.join(bounded_broadcast(written(seen.select("doc_id").distinct(), "ids")), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").limit(spec.labelled), "sample")
    rows = seen.join(F.broadcast(some), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id").collect()
    y = np.array([r["y"] for r in rows])
    place = np.zeros(len(y), int)
    for label in (0, 1):
        place[y == label] = np.arange((y == label).sum())
    hold = place % 4 == 1
    if len(np.unique(y[~hold])) < 2 or len(np.unique(y[hold])) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return CoTrained([np.zeros(w) for w in WIDTHS], [np.array([np.log(rate / (1 - rate)), 0.0])] * 2, np.array([0.0, 0.5, 0.5]), [], [])
    t, m = _unpacked([bytes(r["t"]) for r in rows], [bytes(r["m"]) for r in rows])
    both = [text_matrix(t).astype(float), m.astype(float)]
    mine = [x[~hold] for x in both]
    weights = [fit_logistic(x, y[~hold]) for x in mine]
    held, held_y = [x[hold] for x in both], y[hold]
    pool, handed, kept = without_ids(seen, given), [], []
    for _ in range(spec.rounds):
        teachers = [w.copy() for w in weights]
        limits = pool_limits(pool, teachers, calibrated(held, held_y, teachers), float(y[~hold].mean()), spec)
        for _ in range(spec.steps):
            got = pool_slopes(pool, teachers, weights, limits)
            for k, (n, slope) in enumerate(got):
                weights[k] = learned(mine[k], y[~hold], weights[k], n, slope, spec)
        better = [not worse(x, held_y, w, old) for x, w, old in zip(held, weights, teachers, strict=True)]
        weights = [w if ok else old for w, old, ok in zip(weights, teachers, better, strict=True)]
        handed.append((got[0][0], got[1][0]))
        kept.append((better[0], better[1]))
    calibration = calibrated(held, held_y, weights)
    odds = [np.clip(x @ w, -30, 30) * c[1] + c[0] for x, w, c in zip(held, weights, calibration, strict=True)]
    ones = np.ones(len(held_y))
    return CoTrained(weights, calibration, fit_logistic(np.column_stack((ones, *odds)), held_y, 1.0), handed, kept)


SCORED = "score double, text_score double, meta_score double"


def score(docs: DataFrame, model: CoTrained, seen: DataFrame | None = None) -> DataFrame:
    """``doc_id`` with the combined and both calibrated views' probabilities of good quality, for every document; ``seen``: its written ``views``.

    Null texts are scored as empty ones, texts of any length whole; equal rows get equal scores, each by itself; an empty table gives none. Columns other than
    doc_id, text, lang, source and n_chars (where it is missing or null, the text's length) are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                got = model.scores(_unpacked(batch.column(1).to_pylist(), batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x.astype(float)) for x in got)], ["doc_id", "score", "text_score", "meta_score"])

    return (views(docs) if seen is None else seen).mapInArrow(run, f"doc_id long, {SCORED}")


def keep_good(docs: DataFrame, model: CoTrained, spec: CoTrainSpec = CoTrainSpec()) -> DataFrame:
    """The rows of ``docs`` (all their columns, texts untouched) whose score reaches the threshold; the views are computed where the rows are.

    Each row is judged by itself: null texts as empty ones, long texts whole, equal rows (ties) alike. An empty table stays empty; other columns pass through, whatever their names.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # names with dots can't be passed to tasks
    place = [names.index(c) for c in ("text", "lang", "source")]
    length = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts, langs, sources = (batch.column(i).cast(kind).to_pylist() for i, kind in zip(place, (pa.binary(), pa.string(), pa.string()), strict=True))
                sizes = [None] * len(texts) if length is None else batch.column(length).to_pylist()
                sizes = [len(t.decode()) if s is None and t else s for s, t in zip(sizes, texts, strict=True)]
                yield batch.filter(pa.array(model.scores(features(texts, langs, sources, sizes))[0] >= spec.threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
