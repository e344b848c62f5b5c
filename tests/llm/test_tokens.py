"""Operators 11 to 13 against plain versions, on whole tables and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelforge.llm import alignment, importance, queries, sequences, tokens

BYTE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TEXTS = [None, "", " ", "a", "A", "  two  spaces ", "I've said 'so'. It's fine!\n\nNew line", "tab\tand\r\nline ", "<|endoftext|> plain <s> <unk> <0x0A>", "näïve Straße ½ × 漢字 🙂", "▁odd", "a\x1eb", "ǆ", "x" * 3000, "no stop " * 900, "One. " * 1500, "'s're'", "a  \n b  \u0085c", "ﬁ ligature"]
LETTERS = [*"ab Zé's'll.!?\n\t\r\x0b\x0c\x1c\x1e\x1f\x85\xa0 09²½¾ªµ×÷ɏ  ''\x00̀漢ɐ▁<>", "<|endoftext|>", "<s>", "<0x0A>", "ﬁ", "🙂", " the", "ing"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def sides():
    plain = Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    return Tokenizer.from_file(BYTE), plain, tokens.Pieces(PIECE).model


def test_ids_are_the_tokenizers(sides, docs):
    """Ids by way of units equal those of whole texts, over random texts of awkward characters, edge cases and documents."""
    rng = random.Random(7)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts = [*made, *(t for t in TEXTS if t is not None), *(t for _, t in docs[:100])]
    ours = [tokens.ByteLevel(BYTE), tokens.ByteLevel(BYTE, True), tokens.Pieces(PIECE)]
    for _ in range(2):  # the second time units are remembered
        for at in range(0, len(texts), 333):
            part = texts[at : at + 333]
            want = [[e.ids for e in s.encode_batch(part, add_special_tokens=False)] for s in sides[:2]] + [sides[2].encode(part)]
            for mine, ids in zip(ours, want, strict=True):
                assert [x.tolist() for x in mine.encode(part)] == ids
    assert b"".join(ours[1].bytes_of()[i] for i in sides[1].encode(TEXTS[9], add_special_tokens=False).ids) == TEXTS[9].encode()


def test_cache_takes_over_slots(monkeypatch):
    monkeypatch.setattr(tokens, "SLOTS", 4)
    mine, plain = tokens.ByteLevel(BYTE), Tokenizer.from_file(BYTE)
    texts = [f"word{k} and {k} more, {'long' * (k % 9)} ones" for k in range(200)]
    for _ in range(2):
        assert [x.tolist() for x in mine.encode(texts)] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def plain_resample(docs, target, spec):
    def features(text):
        words = WORDS.findall(lower(text))
        return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % spec.buckets for n in range(1, spec.run + 1) for i in range(len(words) - n + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = s.total() + spec.buckets, t.total() + spec.buckets
    out = []
    for i, words, f in found:
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b in f)
        h = int(hashlib.sha256(f"{spec.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= spec.least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(fit[: len(fit) * spec.percent // 100]):
        r[4] = k + 1
    return sorted((r[:5] for r in out), key=str)


def test_resampling(spark, sf, docs):
    want = plain_resample(docs, [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()], importance.ResampleSpec())
    assert sorted(([*r] for r in queries.QUERIES["op11_resampling"](spark, sf).collect()), key=str) == want


def test_resampling_sql(spark, sf, duck):
    name = "op11_resampling"
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(cursor.fetchall(), key=str) == sorted((tuple(r) for r in queries.QUERIES[name](spark, sf).select(*columns).collect()), key=str)


@pytest.mark.parametrize("run", [1, 3])
def test_resampling_edges(spark, make_docs, monkeypatch, run):
    """Null ids, equal rows, ties, texts without words, small tries, longer runs; an empty table."""
    monkeypatch.setattr(importance, "NODES", 3)
    monkeypatch.setattr(importance, "CHUNK", 64)
    spec = importance.ResampleSpec(run=run, buckets=97, percent=50, least_words=2)
    rows = [*((k, t) for k, t in enumerate(TEXTS)), (None, "one two three"), (3, "one two three"), (3, "one two three"), (77, "a b A B a b c")]
    target = make_docs([(1, "one two a b"), (2, None), (3, "")])
    got = importance.resample(make_docs(rows), target, spec).collect()
    assert sorted(([*r] for r in got), key=str) == plain_resample(rows, ["one two a b", None, ""], spec)
    assert importance.resample(make_docs([]), target, spec).collect() == []
    assert len(importance.resample(make_docs(rows), make_docs([]), spec).collect()) == len(rows)


def check_pieces(got, docs, encode, capacity, end_id):
    """Each document's ids lie once, in order, in pieces that fill sequences from 0 without a gap; documents keep their order."""
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in docs:
        ids = np.array([*encode(text or ""), end_id], "<u4")
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    sizes = []
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= capacity
        sizes.append(at)
    return sizes


def padding(sizes, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes)


def test_sequences(spark, sf, docs, sides):
    got = queries.QUERIES["op12_sequences"](spark, sf).collect()
    sizes = check_pieces(got, docs, lambda t: sides[0].encode(t, add_special_tokens=False).ids, 1024, 0)
    assert padding(sizes, 1024) < 0.01 * sum(sizes)
    inside = [r for r in got if r.start + r.length < r.doc_tokens]
    assert len(inside) < 1.25 * sum(sizes) / 1024


def test_sequences_edges(spark, make_docs, sides):
    rows = [*((k, t) for k, t in enumerate(TEXTS))]
    spec = sequences.CutSpec(BYTE, capacity=64, block_ids=500)
    read = sequences.read_pieces(sequences.write_sequences(make_docs(rows).repartition(3), spec))
    sizes = check_pieces(read.collect(), rows, lambda t: sides[0].encode(t, add_special_tokens=False).ids, 64, 0)
    assert padding(sizes, 64) < 0.2 * sum(sizes)
    assert sequences.read_pieces(sequences.write_sequences(make_docs([]), spec)).collect() == []
    again = sequences.read_pieces(sequences.write_sequences(make_docs([(None, "a b"), (5, "a b"), (5, "a b"), (None, None)]), spec)).collect()
    assert Counter((r.doc_id, r.length) for r in again) == Counter({(None, 3): 1, (5, 3): 2, (None, 1): 1})


def test_cuts_are_the_cheapest():
    """The queue's cuts cost as little as those of a plain quadratic recursion."""
    rng = np.random.default_rng(5)
    spec = sequences.CutSpec("", capacity=16, sentence=2, inside=5, every=4, sequence=1)
    for _ in range(200):
        ids = rng.integers(0, 6, rng.integers(1, 120))
        ends = np.unique(np.append(rng.integers(1, len(ids) + 1, 4), len(ids)))
        kinds = np.array([1, 2, 0, 0, 0, 0], np.uint8)
        places, fees = sequences.boundaries(ids, ends, kinds, spec)
        cost = [0.0] + [math.inf] * (len(places) - 1)
        pad = lambda n: 0 if n & (n - 1) == 0 else 16 - n
        for j in range(1, len(places)):
            cost[j] = min(cost[i] + pad(places[j] - places[i]) for i in range(j) if places[j] - places[i] <= 16) + fees[j] + 1
        cuts = sequences.best_cuts(places, fees, spec)
        fee = dict(zip(places.tolist(), fees.tolist(), strict=True))
        got = sum(pad(e - s) + fee[e] + 1 for s, e in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True))
        assert cuts[-1] == len(ids) and max(np.diff(cuts, prepend=0)) <= 16 and got == cost[-1]


def plain_alignment(rows, plain, model):
    unshown = {c: b for b, c in zip([*range(33, 127), *range(161, 173), *range(174, 256)], map(chr, [*range(33, 127), *range(161, 173), *range(174, 256)]), strict=True)}
    unshown |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in unshown.values())}
    out, links, counts = [], [], Counter()
    for doc, text in rows:
        a = plain.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        of_a = [bytes(unshown[c] for c in plain.id_to_token(i)) for i in a]
        of_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
            a = b = of_a = of_b = []
        mine, i, j, end_a, end_b, groups, left, right = [], 0, 0, 0, 0, [], [], []
        while i < len(a):
            mine.append((a[i], b[j]))
            stop_a, stop_b = end_a + len(of_a[i]), end_b + len(of_b[j])
            if stop_a <= stop_b:
                left.append(str(a[i]))
            if stop_b <= stop_a:
                right.append(str(b[j]))
            if stop_a == stop_b:
                groups.append(",".join(left) + "|" + ",".join(right))
                left, right = [], []
            if stop_a <= stop_b:
                i, end_a = i + 1, stop_a
            if stop_b <= stop_a:
                j, end_b = j + 1, stop_b
        counts.update(mine)
        links.append(mine)
        out.append([doc, len(a), len(b), len(groups), len(mine), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    return sorted(([*r[:5], sum(counts[p] == best[p[1]] for p in m), sum(counts[p] for p in m), r[5]] for r, m in zip(out, links, strict=True)), key=str)


def test_alignment(spark, sf, docs, sides):
    got = queries.QUERIES["op13_alignment"](spark, sf).collect()
    assert sorted(([*r] for r in got), key=str) == plain_alignment(docs, *sides[1:])


def test_alignment_edges(spark, make_docs, sides):
    """Many stripes and small blocks, null and repeated rows, texts that a side changes; an empty table."""
    rows = [*((k, t) for k, t in enumerate(TEXTS)), (None, "One. two"), (5, "One. two"), (5, "One. two")]
    spec = alignment.AlignSpec(BYTE, PIECE, stripes=500, block_links=40)
    got = alignment.align(make_docs(rows).repartition(3), spec).collect()
    assert sorted(([*r] for r in got), key=str) == plain_alignment(rows, *sides[1:])
    assert alignment.align(make_docs([]), spec).collect() == []


def test_alignment_rows_are_small(spark, make_docs, sides):
    """No row of the written blocks holds more than a row's links or a stripe's pairs, and long texts in several rows give the same figures."""
    rows = [(1, " ".join(f"word{k}" for k in range(700))), (None, "One. two"), (2, None), (3, "a b " * 900)]
    spec = alignment.AlignSpec(BYTE, PIECE, stripes=64, block_links=1000, row_links=50)
    written = alignment.write_blocks(make_docs(rows).repartition(1), spec).collect()
    assert max(len(r.link_at or b"") for r in written) == 4 * 50 and sum(len(r.link_at or b"") for r in written) == 4 * sum(r.n_links or 0 for r in written)
    assert all(r.place < 64 and len(r.counts) == 2 * len(r.codes) for r in written if r.codes is not None)
    got = alignment.align(make_docs(rows).repartition(2), spec).collect()
    assert sorted(([*r] for r in got), key=str) == plain_alignment(rows, *sides[1:])
