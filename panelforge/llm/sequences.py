"""Training sequences of at most a fixed number of tokens, cut by dynamic programming.

Documents keep the order in which their table stores them. Their ids form a stream, which is cut into
sequences at ends of documents or sentences, or elsewhere where those stand far apart, so that padding
plus the penalties of cuts is least. A sequence whose length is a power of two is not padded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_broadcast, written
from panelforge.llm.packing import crc32_of
from panelforge.llm.tokens import ByteLevel, made


@dataclass(frozen=True)
class CutSpec:
    """Costs are in tokens of padding. ``sentence``: of a cut between a document's sentences; ``inside``: of any other cut in a document, looked at each ``every`` tokens between ends that stand further apart; ``sequence``: of each sequence.

    ``block_ids``: about so many ids are cut at once; a block ends with a document.
    """

    tokenizer: str
    end_id: int = 0
    capacity: int = 1024
    sentence: int = 1
    inside: int = 12
    every: int = 32
    sequence: int = 4
    block_ids: int = 1 << 19


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray, spec: CutSpec) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, ascending from 0 to its end, and the penalty of each. ``sentence_end``: of each id, 1 if it can end a sentence, 2 if it starts with white space."""
    marks = np.zeros(len(ids) + 1, np.uint8)
    kind = sentence_end[ids]
    marks[1:-1] = (kind[:-1] & 1) & (kind[1:] >> 1)
    marks[0] = marks[doc_ends] = 2
    places = np.flatnonzero(marks)
    gaps = np.diff(places)
    extra = np.maximum(gaps - 1, 0) // spec.every
    wide = np.flatnonzero(extra)
    more = np.repeat(places[wide], extra[wide]) + spec.every * (1 + np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra[wide]) - extra[wide], extra[wide]))
    every = np.concatenate((places, more))
    cost = np.concatenate((np.where(marks[places] == 2, 0, spec.sentence), np.full(len(more), spec.inside)))
    order = np.argsort(every, kind="stable")
    return every[order], cost[order]


def best_cuts(places: np.ndarray, penalties: np.ndarray, spec: CutSpec) -> np.ndarray:
    """The chosen ones of ``places`` with the least sum of padding, penalties and costs of sequences.

    The least cost up to a place is its penalty plus the least over earlier places in reach of their cost plus the padding between; padding is
    linear in the place, so a queue of places with ascending cost plus place gives it, each place entering and leaving once. Lengths that are powers of two need no padding and are looked up apart.
    """
    n, reach = len(places), spec.capacity
    powers = [1 << k for k in range(reach.bit_length()) if 1 << k <= reach]
    number = np.full(int(places[-1]) + 1, -1, np.int32)
    number[places] = np.arange(n)
    pairs = []
    for p in powers:
        to = np.arange(np.searchsorted(places, p), n)
        of = number[places[to] - p]
        pairs.append(np.stack((to, of))[:, of >= 0])
    to, of = np.concatenate(pairs, axis=1)
    exact = of[np.argsort(to, kind="stable")].tolist()  # earlier places at the distance of a power of two, by place
    upto = np.cumsum(np.bincount(to, minlength=n)).tolist()
    at, fee = places.tolist(), (penalties + spec.sequence).tolist()
    cost, back, value = [0] * n, [0] * n, [0] * n  # value: cost plus place
    queue, head, done = [0], 0, upto[0]
    for j in range(1, n):
        here = at[j]
        i = queue[head]
        if at[i] < here - reach:
            while at[queue[head]] < here - reach:
                head += 1
            i = queue[head]
        least = value[i] + reach - here
        if upto[j] > done:
            for e in exact[done : upto[j]]:
                if cost[e] <= least:
                    least, i = cost[e], e
            done = upto[j]
        least += fee[j]
        cost[j], back[j], here_value = least, i, least + here
        value[j] = here_value
        while len(queue) > head and value[queue[-1]] >= here_value:
            queue.pop()
        queue.append(j)
    chosen = [n - 1] if n > 1 else []
    while chosen and back[chosen[-1]]:
        chosen.append(back[chosen[-1]])
    return places[chosen[::-1]]


PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())])
SEQUENCES = "shard int, sequence long, ids array<int>, pieces array<struct<doc_id: long, start: long, length: long, doc_tokens: long>>"


def _sequences(shard: int, first: int, ids: np.ndarray, names: list[int | None], lengths: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
    """Rows of sequences that end at ``cuts``, with the pieces of documents in each."""
    doc_ends = np.cumsum(lengths)
    ends = np.union1d(doc_ends, cuts)
    starts = np.concatenate(([0], ends[:-1]))
    doc = np.searchsorted(doc_ends, starts, side="right")
    fields = [pa.array(names, pa.int64()).take(pa.array(doc)), pa.array(starts - (doc_ends - lengths)[doc]), pa.array(ends - starts), pa.array(lengths[doc])]
    pieces = pa.StructArray.from_arrays(fields, fields=list(PIECE))
    per_sequence = np.concatenate(([0], np.searchsorted(ends, cuts) + 1)).astype(np.int32)
    rows = [
        pa.array(np.full(len(cuts), shard, np.int32)),
        pa.array(first + np.arange(len(cuts))),
        pa.ListArray.from_arrays(pa.array(np.concatenate(([0], cuts)).astype(np.int32)), pa.array(ids.astype(np.int32))),
        pa.ListArray.from_arrays(pa.array(per_sequence), pieces),
    ]
    return pa.RecordBatch.from_arrays(rows, ["shard", "sequence", "ids", "pieces"])


def write_sequences(docs: DataFrame, spec: CutSpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of sequences: shard, number in it, ids, and pieces (doc_id, ids of the document before, length, ids of the document).

    Each partition of ``docs`` is cut by itself, in the order of its rows, so nothing is shuffled; sort ``docs`` first for another order. Null and
    empty texts hold the end id alone. Null and repeated ids are documents like others, and equal rows are packed as often as they stand. A text of any
    length is encoded whole, in one block. An empty table makes an empty table. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, shard, first = made(ByteLevel, spec.tokenizer), TaskContext.get().partitionId(), 0
        # what a sentence ends in, perhaps closed by a quote or bracket, and white space after it
        shown = [b.rstrip(b"\"')]") for b in tokenizer.bytes_of()]
        kinds = np.array([(s[-1:] in (b".", b"!", b"?") and s != b"") + 2 * (b[:1] in (b" ", b"\n", b"\t", b"\r")) for s, b in zip(shown, tokenizer.bytes_of(), strict=True)], np.uint8)
        end = np.array([spec.end_id], np.uint32)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[int] = []
        held = 0

        def flush() -> pa.RecordBatch:
            flat, sizes = np.concatenate(ids), np.array(lengths, np.int64)
            return _sequences(shard, first, flat, names, sizes, best_cuts(*boundaries(flat, np.cumsum(sizes), kinds, spec), spec))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for name, got in zip(part.column(0).to_pylist(), tokenizer.encode([t or "" for t in part.column(1).to_pylist()]), strict=True):
                    ids += (got, end)
                    lengths.append(len(got) + 1)
                    names.append(name)
                    held += len(got) + 1
                    if held >= spec.block_ids:
                        yield (out := flush())
                        first, held, ids, names, lengths = first + out.num_rows, 0, [], [], []
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(rows.mapInArrow(run, SEQUENCES), "sequences")


def read_pieces(sequences: DataFrame) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece; sequences are numbered through all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pieces = batch.column(2), batch.column(3)
            flat, first = ids.flatten().to_numpy(), ids.value_lengths().to_numpy()
            of = pieces.flatten()
            n = pieces.value_lengths().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), n)
            length = of.field("length").to_numpy()
            end = np.cumsum(length)  # pieces fill the ids without a gap
            crc = [crc32_of(flat[e - k : e]) for e, k in zip(end.tolist(), length.tolist(), strict=True)]
            offset = end - length - (np.cumsum(first) - first)[row]
            columns = [batch.column(0).take(pa.array(row)), of.field("doc_id"), of.field("start"), of.field("length"), pa.array(crc, pa.int64()), of.field("doc_tokens"), batch.column(1).take(pa.array(row)), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"])

    found = sequences.mapInArrow(run, "shard int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence long, offset long")
    totals = sequences.groupBy("shard").agg((F.max("sequence") + 1).alias("n"))
    starts = written(totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("before")), "shards")  # a row for each task that wrote
    joined = found.join(bounded_broadcast(starts), "shard")
    return joined.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset")
