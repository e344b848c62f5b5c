"""Secret scans: fixed patterns, and a linear-chain conditional random field over tokens.

Tokens are runs without white space, tagged outside, begin or inside of a secret. A token's emission adds
weights of hashed features of its own shape, of its neighbours (two before, one after) and of the file
(digit density, assignments, length). The field is fitted on a bounded sample of documents whose tags come
from the fixed patterns, and on copies of them in which keywords are other words and values other random strings, so that it learns where secrets
stand and how they look instead of the patterns' own words. Viterbi decoding tags every token of every text. Tokens that are outside by more than any
transitions could change are fixed first, which is exact, so only the runs between them are decoded.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelforge.llm.common import mix64, written


#: Fixed patterns of the known kinds.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex")
KEYWORD = re.compile(r"(?ai)pass|secret|token|api_?key")
TOKEN = re.compile(r"[^\x20\t-\r]+")
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
BUCKETS, PER_TYPE, OFFSETS, FILES = 4096, 8, (0, 1, 2, -1), 32
MEMO_TYPES = 200_000


@dataclass(frozen=True)
class CrfSpec:
    """``positives`` and ``negatives`` bound the documents (with and without a known secret, by a hash of the id, up to ``longest`` characters) that the field is fitted on."""

    positives: int = 200
    negatives: int = 150
    longest: int = 20_000
    steps: int = 60
    rate: float = 0.1
    ridge: float = 0.05
    least: int = 8
    seed: int = 4


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed patterns, by start, then kind."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    out.sort()
    return out


#: Classes of code points below 128: 1 lower case, 2 upper case, 3 digit, 4 quote or bracket, else 5 and more; what is above counts as lower case.
CLASS = np.arange(5, 133, dtype=np.int64)
CLASS[[*range(97, 123)]], CLASS[[*range(65, 91)]], CLASS[[*range(48, 58)]] = 1, 2, 3
CLASS[[ord(c) for c in "\"'`,;()[]{}<>"]] = 4
POWERS = np.cumprod(np.full(16, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _places(mask: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each character, how many of its word's characters before it are in the mask."""
    count = np.cumsum(mask) - mask
    return count - np.repeat(count[begins], sizes)


def type_features(words: list[str]) -> np.ndarray:
    """Hashed features of tokens' own forms, a row for each (non-empty) token: shape, length, shares of digits and capitals, changes of class, alphabet, letters of a short word, outer punctuation."""
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(sizes) - sizes
    chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    kind = np.where(chars < 128, CLASS[np.minimum(chars, 127)], 1)
    add = lambda x: np.add.reduceat(x, begins)
    core = kind != 4
    n, digits, upper = add(core.astype(np.int64)), add((kind == 3).astype(np.int64)), add((kind == 2).astype(np.int64))
    change = np.concatenate(([True], kind[1:] != kind[:-1]))
    change[begins] = True
    place = _places(change, begins, sizes)
    shape = add(np.where(change & (place < 12), kind.astype(np.uint64) * POWERS[np.minimum(place, 15)], np.uint64(0)))
    lower = np.where(kind == 2, chars + 32, chars)
    letter = kind <= 2
    spelled = add(np.where(letter, lower.astype(np.uint64) * POWERS[np.minimum(_places(letter, begins, sizes), 15)], np.uint64(0)))
    hexes = add(((kind == 3) | ((chars >= 97) & (chars <= 102))).astype(np.int64))
    coded = add(((kind <= 3) & (chars < 128) | np.isin(chars, [43, 45, 47, 61, 95])).astype(np.int64))
    size = np.minimum(n, 63)
    bits = np.ceil(np.log2(size + 1)).astype(np.int64)
    alphabet = 2 * ((hexes == n) & (n >= 8)) + ((coded == n) & (n >= 12))
    first, last = chars[begins], chars[begins + sizes - 1]
    outer = np.where(kind[begins] > 3, first, 0) * 4096 + np.where(kind[begins + sizes - 1] > 3, last, 0)
    named = [shape, bits, digits * 8 // np.maximum(n, 1), upper * 4 // np.maximum(n, 1) * 8 + size // 8, np.minimum(add(change.astype(np.int64)), 30), alphabet, np.where((n <= 10) & (digits == 0), spelled, np.uint64(0)), outer]
    return np.stack([(mix64(np.asarray(x).astype(np.uint64) + np.uint64((k + 1) * 0xD6E8FEB86659FD93 % 2**64)) % np.uint64(BUCKETS)).astype(np.int64) for k, x in enumerate(named)], 1)


def file_bucket(text: str) -> int:
    """Digit density, assignments and length of the whole text."""
    n = max(1, len(text))
    digits = sum(map(text.count, "0123456789"))
    return min(3, digits * 50 // n) * 8 + ("=" in text) * 4 + min(3, n.bit_length() // 4)


class Field:
    """Weights: emissions by offset, bucket and tag; by file bucket and tag; transitions from tag to tag. Texts begin and end outside."""

    def __init__(self, own: np.ndarray, files: np.ndarray, trans: np.ndarray):
        self.own, self.files, self.trans = own, files, trans
        self.types: dict[str, int] = {}
        self.scores = np.empty((0, len(OFFSETS), 3), np.float32)
        self.fresh: list[np.ndarray] = []

    def codes(self, words: list[str]) -> np.ndarray:
        types = self.types
        fresh = [w for w in set(words) if w not in types]
        if fresh:
            feats = type_features(fresh)
            types.update(zip(fresh, range(len(types), len(types) + len(fresh)), strict=True))
            self.fresh.append(self.own[:, feats].sum(2).transpose(1, 0, 2))
        return np.fromiter(map(types.__getitem__, words), np.int64, len(words))

    def table(self) -> np.ndarray:
        """Emission of each type as seen from each offset."""
        if self.fresh:
            self.scores = np.concatenate((self.scores, *self.fresh)).astype(np.float32)
            self.fresh = []
        return self.scores

    def forget(self) -> None:
        if len(self.types) > MEMO_TYPES:
            self.types, self.scores, self.fresh = {}, self.scores[:0], []


def _shifted(sizes: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray]:
    """For concatenated sequences: which places have a neighbour ``offset`` before, and where it is."""
    n = int(sizes.sum())
    begins = np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(n) - offset
    ok = (at >= begins) & (at < ends)
    return np.flatnonzero(ok), at[ok]


def emissions(field: Field, codes: np.ndarray, sizes: np.ndarray, files: np.ndarray) -> np.ndarray:
    table = field.table()
    out = np.repeat(field.files[files], sizes, axis=0).astype(np.float32)
    for k, offset in enumerate(OFFSETS):
        to, at = _shifted(sizes, offset)
        out[to] += table[codes[at], k]
    return out


def decode(field: Field, em: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best tags of concatenated sequences by Viterbi."""
    tags = np.zeros(len(em), np.int8)
    slack = 2 * float(field.trans.max() - field.trans.min())
    open_ = em[:, OUTSIDE] - em[:, 1:].max(1) <= slack
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(open_)
    if not len(at):
        return tags
    new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])))
    heads = at[new]
    lengths = np.diff(np.append(np.flatnonzero(new), len(at)))
    order = np.argsort(-lengths, kind="stable")
    heads, lengths = heads[order], lengths[order]
    best = field.trans[OUTSIDE] + em[heads]
    back = []
    for t in range(1, int(lengths[0])):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        step = best[:live, :, None] + field.trans[None]
        back.append(step.argmax(1).astype(np.int8))
        best[:live] = step.max(1) + em[heads[:live] + t]
    last = (best + field.trans[:, OUTSIDE]).argmax(1).astype(np.int8)
    state = last.copy()
    for t in range(int(lengths[0]) - 1, -1, -1):
        live = int(np.searchsorted(-lengths, -t, side="left"))
        tags[heads[:live] + t] = state[:live]
        if t:
            state[:live] = back[t - 1][np.arange(live), state[:live]]
    return tags


def _tags(text: str, values: list[tuple[int, int]] | None = None) -> tuple[list[str], np.ndarray]:
    """Tokens of a text and their tags by ``values`` (start, end), else by those of the fixed patterns."""
    found = list(TOKEN.finditer(text))
    tags = np.zeros(len(found), np.int8)
    begins, ends = np.array([m.start() for m in found]), np.array([m.end() for m in found])
    for value, end in [(v, e) for _, _, e, v in base_spans(text)] if values is None else values:
        hit = np.flatnonzero((begins < end) & (ends > value))
        tags[hit] = INSIDE
        tags[hit[:1]] = BEGIN
    return [m[0] for m in found], tags


LETTERS, CAPITALS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def masked(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """A copy of a text with random words for the keywords and random characters for the values of its secrets, and the values' places in it."""
    pick = lambda alphabet, n: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    out, values, at, size = [], [], 0, 0

    def put(part: str) -> None:
        nonlocal size
        out.append(part)
        size += len(part)

    for start, kind, end, value in base_spans(text):
        if start < at:
            continue
        put(text[at:start])
        if kind == 0:
            word = re.match("[A-Za-z_]+", text[start:value])
            put(pick(LETTERS, rng.integers(3, 9)) + text[start + word.end() : value])
        old = text[value:end]
        alphabet = LETTERS + DIGITS + CAPITALS * (old.lower() != old)
        values.append((size, size + len(old)))
        put(pick(alphabet, len(old)))
        at = end
    put(text[at:])
    return "".join(out), values


def fit(texts: list[str], spec: CrfSpec) -> Field:
    """Penalised maximum likelihood by Adam; the gradient comes from forward-backward sums over pieces of 64 tokens."""
    own, files, trans = np.zeros((len(OFFSETS), BUCKETS, 3)), np.zeros((FILES, 3)), np.zeros((3, 3))
    words, tags, sizes, kinds = [], [], [], []
    rng = np.random.default_rng(spec.seed)
    copies = [masked(t, rng) for t in texts if base_spans(t)]
    for text, values in [*((t, None) for t in texts), *copies]:
        w, y = _tags(text, values)
        for at in range(0, len(w), 64):
            if values is not None and not y[at : at + 64].any():
                continue  # of a copy only the parts that differ
            words += w[at : at + 64]
            tags.append(y[at : at + 64])
            sizes.append(len(tags[-1]))
            kinds.append(file_bucket(text))
    if not words or not any(y.any() for y in tags):
        files[:, OUTSIDE] = 50.0
        return Field(own, files, trans)
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    feats = type_features(list(names))
    code = np.array([names[w] for w in words])
    sizes, kinds, y = np.array(sizes), np.array(kinds), np.concatenate(tags).astype(int)
    owner, place = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(n) for n in sizes])
    length, n_seq = int(sizes.max()), len(sizes)
    links = [_shifted(sizes, o) for o in OFFSETS]
    params = [own, files, trans]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    onehot = np.eye(3)[y]
    valid = np.zeros((n_seq, length), bool)
    valid[owner, place] = True
    for step in range(1, spec.steps + 1):
        em = files[np.repeat(kinds, sizes)].copy()
        for k, (to, at) in enumerate(links):
            em[to] += own[k][feats].sum(1)[code[at]]
        grid = np.zeros((n_seq, length, 3))
        grid[owner, place] = em
        fwd = np.full((n_seq, length + 1, 3), -np.inf)
        fwd[:, 0] = trans[OUTSIDE] + grid[:, 0]
        lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
        for t in range(1, length):
            on = valid[:, t]
            fwd[:, t] = np.where(on[:, None], lse(fwd[:, t - 1, :, None] + trans[None], 1) + grid[:, t], fwd[:, t - 1])
        back = np.zeros((n_seq, length, 3))
        back[:, length - 1] = trans[:, OUTSIDE]
        for t in range(length - 2, -1, -1):
            on = valid[:, t + 1]
            back[:, t] = np.where(on[:, None], lse(trans[None] + (grid[:, t + 1] + back[:, t + 1])[:, None, :], 2), trans[:, OUTSIDE])
        total = lse(fwd[:, length - 1] + trans[:, OUTSIDE], 1)
        node = np.exp(np.minimum(fwd[:, :length] + back - total[:, None, None], 0))[owner, place]
        miss = onehot - node
        g_own, g_files = np.zeros_like(own), np.zeros_like(files)
        for k, (to, at) in enumerate(links):
            per_type = np.stack([np.bincount(code[at], weights=miss[to, c], minlength=len(feats)) for c in range(3)], 1)
            for j in range(PER_TYPE):
                for c in range(3):
                    g_own[k, :, c] += np.bincount(feats[:, j], weights=per_type[:, c], minlength=BUCKETS)
        np.add.at(g_files, np.repeat(kinds, sizes), miss)
        g_trans = np.zeros((3, 3))
        for t in range(1, length):
            on = valid[:, t]
            edge = np.exp(np.minimum(fwd[on, t - 1, :, None] + trans[None] + (grid[on, t] + back[on, t])[:, None, :] - total[on, None, None], 0)).sum(0)
            g_trans -= edge
        g_trans[OUTSIDE] -= node[place == 0].sum(0)
        g_trans[:, OUTSIDE] -= node[place == np.repeat(sizes, sizes) - 1].sum(0)
        same = owner[1:] == owner[:-1]
        np.add.at(g_trans, (y[:-1][same], y[1:][same]), 1)
        np.add.at(g_trans, (np.zeros(n_seq, int), y[place == 0]), 1)
        np.add.at(g_trans, (y[place == np.repeat(sizes, sizes) - 1], np.zeros(n_seq, int)), 1)
        for p, g, a, b in zip(params, (g_own, g_files, g_trans), m1, m2, strict=True):
            g = g - spec.ridge * p
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += spec.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    return Field(own.astype(np.float32), files.astype(np.float32), trans.astype(np.float32))


def train(docs: DataFrame, spec: CrfSpec = CrfSpec(), id_col: str = "doc_id", text_col: str = "text") -> Field:
    """The field fitted on a bounded sample of ``docs``, the first by a hash of id and text.

    Null, empty and longer texts are left out of the sample, and equal rows are in it once; without any known secret, as in an empty table, the field tags nothing.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null").where(F.length("text").between(1, spec.longest))
    hit = F.col("text").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{14}|(?-i)[0-9a-f]{16}")
    rows = rows.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    first = F.row_number().over(W.partitionBy("hit").orderBy("h"))
    chosen = rows.select("h", hit.alias("hit")).withColumn("n", first).where((F.col("n") <= spec.positives) & (F.col("hit") | (F.col("n") <= spec.negatives)))
    chosen = written(chosen.select("h", "hit"), "sample").distinct()
    found = rows.join(F.broadcast(chosen), "h").dropDuplicates(["h"]).orderBy(F.desc("hit"), "h").select("text").collect()
    return fit([r["text"] for r in found], spec)


SPANS = "array<struct<s:int,k:int,kind:string,e:int>>"


def extra_spans(text: str, tags: np.ndarray, base: list, spec: CrfSpec) -> list[tuple[int, int]]:
    """Tagged runs of a text, without quotes and closing punctuation, that touch no span of a known kind."""
    found, out = list(TOKEN.finditer(text)), []
    starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
    i = 0
    while i < len(tags):
        if tags[i]:
            j = i + 1
            while j < len(tags) and tags[j] == INSIDE:
                j += 1
            start, end = found[i].start(), found[j - 1].end()
            while start < end and text[start] in "\"'`([{<":
                start += 1
            while start < end and text[end - 1] in "\"'`)]}>,;.!?":
                end -= 1
            before = bisect_left(starts, end)
            if end - start >= spec.least and not (before and reach[before - 1] > start):
                out.append((start, end))
            i = j
        else:
            i += 1
    return out


def scan(docs: DataFrame, field: Field, spec: CrfSpec = CrfSpec(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, extra): spans (start s, kind, end e, code points) of the fixed patterns and of the field, for every row.

    A null or empty text has none; long texts are read whole; equal rows get equal spans; an empty table gives none; other columns are not looked at.
    Of equally good tag sequences one with more outside tokens is taken. Spans of two kinds at one start stand in the order of the kinds.
    """
    weights = (field.own, field.files, field.trans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*weights)
        kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("kind", pa.string()), ("e", pa.int32())]))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                split = [TOKEN.findall(t) for t in texts]
                own.forget()
                sizes = np.array([len(w) for w in split], np.int64)
                codes = own.codes([w for words in split for w in words])
                tags = decode(own, emissions(own, codes, sizes, np.array([file_bucket(t) for t in texts], np.int64)), sizes) if len(codes) else np.empty(0, np.int8)
                ends = np.cumsum(sizes)
                base = [base_spans(t) for t in texts]
                marked = np.add.reduceat(np.append(tags, 0) > 0, ends - sizes) if len(sizes) else []
                extra = [extra_spans(t, tags[e - n : e], b, spec) if n and m else [] for t, e, n, b, m in zip(texts, ends.tolist(), sizes.tolist(), base, marked, strict=True)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0),
                    pa.array([[{"s": s, "k": k, "kind": KINDS[k], "e": e} for s, k, e, _ in b] for b in base], kind),
                    pa.array([[{"s": s, "k": len(KINDS), "kind": "crf", "e": e} for s, e in x] for x in extra], kind),
                ], ["doc_id", "base", "extra"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base {SPANS}, extra {SPANS}")
