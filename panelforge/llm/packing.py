"""Token ids in fixed-width bit packing.

The file format is a table of *blocks*, written by Spark's committing writer: shard (range of
document ids), block, number of ids before it in the shard, bits of an id, the packed ids, and
the ids and lengths of its documents. Each id takes ``bits`` bits, the least that hold the
vocabulary, most significant first; a block ends on a byte. With the offsets any range of ids can
be found and unpacked by numpy without reading others. Documents don't cross blocks.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import bounded_broadcast, mix64, written

#: Units whose ids a Python worker remembers.
MEMO = 1_000_000
WORD = re.compile("[^ \t-\r]+")
#: Classes of code points below 256: 0 white space, 1 Latin letter, 2 digit, 3 other printable ASCII, 4 anything else (the apostrophe too).
CLASS = np.full(257, 4, np.uint8)
CLASS[33:127], CLASS[39], CLASS[48:58], CLASS[[9, 10, 11, 12, 13, 32]] = 3, 4, 2, 0
CLASS[[*range(65, 91), *range(97, 123), *range(192, 215), *range(216, 247), *range(248, 256)]] = 1
LOWER = np.arange(257, dtype=np.uint64)
LOWER[[*range(65, 91), *range(192, 215), *range(216, 223)]] += np.uint64(32)
FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class PackSpec:
    """``pieces``: the tokenizer ignores case and encodes runs of letters, single digits and runs of other characters apart, so a plain word's pieces can be encoded once each."""

    tokenizer: str
    end_id: int = 2
    pieces: bool = False
    block_ids: int = 1 << 18


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype(">u2").tobytes()
    planes = (ids[:, None].astype(np.uint32) >> np.arange(bits - 1, -1, -1, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel()).tobytes()


def unpack_bits(data: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a block, reading only their bytes."""
    first, last = start * bits, (start + count) * bits
    part = np.frombuffer(data, np.uint8)[first // 8 : -(-last // 8)]
    if bits == 16:
        return part.view(">u2").astype(np.uint32)
    flat = np.unpackbits(part)[first % 8 : first % 8 + count * bits].reshape(count, bits)
    return flat @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


class UnitEncoder:
    """Ids of whole texts by way of units that the tokenizer encodes apart, so that each distinct unit is encoded once while it is remembered.

    Units are words - the tokenizer drops white space and never joins what it separates - or, with ``pieces``, a plain
    text's runs of letters, single digits and runs of other characters. A unit is found by the 64-bit polynomial hash of
    its lower-case characters, which running sums give for all units of a batch, and then compared with the remembered unit's
    characters; one that differs is encoded by itself.
    """

    def __init__(self, path: str, pieces: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.pieces = Tokenizer.from_file(path), pieces
        self.size = self.tokenizer.get_vocab_size()
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)
        self.chars, self.char_at, self.char_n = np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64)
        self.head, self.next = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def _ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts = array("I"), []
        for at in range(0, len(units), 10_000):
            for e in self.tokenizer.encode_batch_fast(units[at : at + 10_000], add_special_tokens=False):
                ids = e.ids
                flat.extend(ids)
                counts.append(len(ids))
        return np.frombuffer(flat, np.uint32) if len(flat) else np.empty(0, np.uint32), np.array(counts, np.int64)

    def _places(self, keys: np.ndarray, at: np.ndarray, ends: np.ndarray, text: str, lower: np.ndarray) -> np.ndarray:
        """Where each distinct key is remembered; unknown ones are encoded first."""
        if len(self.keys) > MEMO:
            self.forget()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if not len(new):
            return place
        ids, counts = self._ids([text[s:e] for s, e in zip(at[new].tolist(), ends[new].tolist(), strict=True)])
        firsts = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate((self.flat, ids))
        sizes = ends[new] - at[new]
        began = len(self.chars) + np.cumsum(sizes) - sizes
        self.chars = np.concatenate((self.chars, lower[_runs(at[new], sizes)]))
        to = np.searchsorted(self.keys, keys[new])
        heads = _eight(lower, at[new], sizes), _eight(lower, np.where(sizes > 8, at[new] + 8, 0), np.maximum(sizes - 8, 0))
        every = ((self.keys, keys[new]), (self.first, firsts), (self.count, counts), (self.char_at, began), (self.char_n, sizes), (self.head, heads[0]), (self.next, heads[1]))
        self.keys, self.first, self.count, self.char_at, self.char_n, self.head, self.next = (np.insert(a, to, b) for a, b in every)
        return np.searchsorted(self.keys, keys)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        texts = [t or "" for t in texts]
        text = "\n".join(texts) + "\n"
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        small = np.minimum(chars, 256)
        kind = CLASS[small]
        doc_ends = np.cumsum([len(t) + 1 for t in texts])
        if self.pieces:
            marks = np.flatnonzero((kind == 4) | ((chars == 60) & np.append(chars[1:] == 124, False)))
            odd = np.unique(np.searchsorted(doc_ends, marks, side="right"))
            before = np.concatenate(([0], kind[:-1]))
            after = np.append(kind[1:], 0)
            starts = np.flatnonzero((kind != 0) & ((kind != before) | (kind == 2)))
            ends = np.flatnonzero((kind != 0) & ((kind != after) | (kind == 2))) + 1
        else:
            odd = np.arange(len(texts))
            starts = ends = np.empty(0, np.int64)
        owner = np.searchsorted(doc_ends, starts, side="right")
        if len(odd):
            plain = ~np.isin(owner, odd)
            starts, ends, owner = starts[plain], ends[plain], owner[plain]
        n = len(chars)
        if len(self.power) < n:
            self.power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, BASE, np.uint64))), dtype=np.uint64)
            self.inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, pow(BASE, -1, 1 << 64), np.uint64))), dtype=np.uint64)
        low = LOWER[small]
        sums = np.concatenate(([np.uint64(0)], np.cumsum((low + np.uint64(1)) * self.power[:n], dtype=np.uint64)))
        low = np.append(low.astype(np.uint8), np.zeros(16, np.uint8))  # units of plain texts have no code points beyond 255
        keys = mix64((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        distinct, at, back = np.unique(keys, return_index=True, return_inverse=True)
        place = self._places(distinct, starts[at], ends[at], text, low)[back]
        first, count = self.first[place], self.count[place]
        flat, other = self.flat, self._others(place, starts, ends, low)
        if len(other):
            own, n_own = self._ids([text[s:e] for s, e in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
            first[other], count[other] = len(flat) + np.cumsum(n_own) - n_own, n_own
            flat = np.concatenate((flat, own))
        ids = flat[_runs(first, count)]
        per_doc = np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)
        out = np.split(ids, np.cumsum(per_doc)[:-1])
        for d in odd.tolist():
            words = WORD.findall(texts[d])
            got = {w: i for w, i in zip(dict.fromkeys(words), self._each(list(dict.fromkeys(words))), strict=True)}
            out[d] = np.concatenate([got[w] for w in words]) if words else np.empty(0, np.uint32)
        return out

    def _others(self, place: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """The units whose characters aren't those of the remembered unit at ``place``: the first 16 are compared as two numbers, further ones one by one."""
        sizes = ends - starts
        differ = (self.char_n[place] != sizes) | (self.head[place] != _eight(lower, starts, sizes))
        longer = np.flatnonzero((sizes > 8) & ~differ)
        differ[longer] = self.next[place[longer]] != _eight(lower, starts[longer] + 8, sizes[longer] - 8)
        longer = longer[(sizes[longer] > 16) & ~differ[longer]]
        wrong = np.flatnonzero(self.chars[_runs(self.char_at[place[longer]], sizes[longer])] != lower[_runs(starts[longer], sizes[longer])])
        differ[longer[np.searchsorted(np.cumsum(sizes[longer]), wrong, side="right")]] = True
        return np.flatnonzero(differ)

    def _each(self, units: list[str]) -> list[np.ndarray]:
        ids, counts = self._ids(units)
        return np.split(ids, np.cumsum(counts)[:-1]) if units else []


def _eight(chars: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Up to eight characters from each start as one number."""
    got = np.lib.stride_tricks.sliding_window_view(chars, 8)[starts].view("<u8").ravel()
    return got & FIRST_BYTES[np.minimum(sizes, 8)]


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``count`` places, one run after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


_encoders: dict[tuple[str, bool], UnitEncoder] = {}


def encoder_of(spec: PackSpec) -> UnitEncoder:
    """The Python worker's encoder: tasks that follow each other in a worker share what it remembers."""
    key = (spec.tokenizer, spec.pieces)
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = UnitEncoder(*key)
    return _encoders[key]


BLOCKS = "shard int, block int, first long, n_ids long, bits int, packed binary, doc_ids array<long>, lengths array<long>"


def write_packed(docs: DataFrame, spec: PackSpec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write them as packed blocks, in ascending order of id (equal ids by a hash of the text, then the text); gives the written table.

    Null texts are empty and still get the end id; null ids come first. An empty table makes an empty file. A text of any length is encoded
    whole and stands in one block, which it may exceed. Repeated rows are written as often as they stand. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = encoder_of(spec), TaskContext.get().partitionId()
        bits = bits_for(max(encoder.size, spec.end_id + 1))
        block = first = held = 0
        end = np.array([spec.end_id], np.uint32)
        ids: list[np.ndarray] = []
        names: list[int | None] = []
        lengths: list[int] = []

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            row = {"shard": [shard], "block": [block], "first": [first], "n_ids": [len(flat)], "bits": [bits], "packed": [pack_bits(flat, bits)], "doc_ids": [names], "lengths": [lengths]}
            kinds = {"shard": pa.int32(), "block": pa.int32(), "first": pa.int64(), "n_ids": pa.int64(), "bits": pa.int32(), "packed": pa.binary(), "doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64())}
            return pa.RecordBatch.from_arrays([pa.array(row[c], t) for c, t in kinds.items()], list(kinds))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for name, got in zip(part.column(0).to_pylist(), encoder.encode(part.column(1).to_pylist()), strict=True):
                    ids += (got, end)
                    lengths.append(len(got) + 1)
                    names.append(name)
                    held += len(got) + 1
                    if held >= spec.block_ids:
                        yield flush()
                        block, first, held, ids, names, lengths = block + 1, first + held, 0, [], [], []
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # ranges are found from ids and hashes, so that no texts are sampled to the driver
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    return written(ordered.select("doc_id", "text").mapInArrow(run, BLOCKS), "packed")


def shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, shard_start): ids of all shards before; one row for each written file part."""
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    return totals.select("shard", (F.sum("n").over(W.orderBy("shard")) - F.col("n")).alias("shard_start"))


def read_documents(blocks: DataFrame, use: Callable[[np.ndarray], int], name: str) -> DataFrame:
    """(doc_id, start, n_tokens, <name>) of each document, unpacked from the blocks; ``use`` turns its ids into a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack_bits(row["packed"], row["bits"], 0, row["n_ids"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                values = [use(ids[e - n : e]) for e, n in zip(ends.tolist(), row["lengths"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), row["shard"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths + row["first"]), pa.array(lengths), pa.array(values, pa.int64())], ["shard", "doc_id", "within", "n_tokens", name])

    docs = blocks.mapInArrow(run, f"shard int, doc_id long, within long, n_tokens long, {name} long")
    return docs.join(bounded_broadcast(written(shard_starts(blocks), "shards")), "shard").select("doc_id", (F.col("shard_start") + F.col("within")).alias("start"), "n_tokens", name)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def read_range(blocks: DataFrame, start: int, count: int) -> np.ndarray:
    """``count`` ids from global place ``start``, from the blocks that hold them only."""
    where = blocks.join(bounded_broadcast(written(shard_starts(blocks), "shards")), "shard").withColumn("at", F.col("shard_start") + F.col("first"))
    rows = where.where((F.col("at") < start + count) & (F.col("at") + F.col("n_ids") > start)).select("n_ids", "bits", "packed", "at").orderBy("at").collect()
    parts = [unpack_bits(r.packed, r.bits, max(0, start - r["at"]), min(r.n_ids, start + count - r["at"]) - max(0, start - r["at"])) for r in rows]
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)
