"""Token ids of whole texts by way of units that a tokenizer encodes apart, so that a unit is encoded once while it is remembered."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np

from panelforge.llm.common import mix64

#: Slots of a Python worker's cache; a unit that falls on another's slot takes its place.
SLOTS = 1 << 19
#: Bytes of a unit that a slot holds; longer units are encoded each time they come.
WIDTH = 24
#: The character put between texts; texts that hold it are encoded whole.
SEP = "\x1e"
#: What of a slot's bytes a unit of each size fills.
FILLED = np.array([[255] * k + [0] * (WIDTH - k) for k in range(WIDTH + 1)], np.uint8).view(np.uint64)
#: Kinds of Latin-1 characters for the byte-level split: 0 the separator, 1 letters, 2 numbers, 3 others, 4 the space, 5 other white space.
KIND = np.full(256, 3, np.uint8)
KIND[[*range(65, 91), *range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = 1
KIND[[*range(48, 58), 0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = 2
KIND[[9, 10, 11, 12, 13, 0x85, 0xA0]] = 5
KIND[ord(" ")], KIND[ord(SEP)] = 4, 0


def runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for ``count`` places, one run after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class UnitCache:
    """Ids of units, looked up by their bytes: a table of one unit a slot, of fixed size. ``encode`` gives all ids of units and the number of each."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.encode = encode
        self.keys = np.zeros((SLOTS, WIDTH // 8 + 1), np.uint64)  # the unit's bytes and its size
        self.count = np.zeros(SLOTS, np.uint8)
        self.ids = np.zeros((SLOTS, WIDTH), np.uint16)

    def lookup(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units ``data[start:end]`` and the number of each unit."""
        windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(WIDTH), np.uint8), WIDTH)
        sizes = ends - starts
        keys = np.empty((len(sizes), WIDTH // 8 + 1), np.uint64)
        keys[:, :-1] = windows[starts].view(np.uint64) & FILLED[np.minimum(sizes, WIDTH)]
        keys[:, -1] = sizes
        mixed = mix64(keys[:, 0] + mix64(keys[:, 1] + mix64(keys[:, 2] + keys[:, 3])))
        slot = (mixed >> np.uint64(44)).astype(np.int64) & (SLOTS - 1)
        hit = (self.keys[slot] == keys).all(axis=1)
        miss = np.flatnonzero(~hit)
        flat, first, counts = self.ids.ravel(), slot * WIDTH, self.count[slot].astype(np.int64)
        if not len(miss):
            return flat[runs(first, counts)].astype(np.uint32), counts
        at: dict[bytes, int] = {}
        which = np.array([at.setdefault(data[s:e], len(at)) for s, e in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)])
        new, n_new = self.encode(list(at))
        first_new = np.cumsum(n_new) - n_new
        counts[miss], first[miss] = n_new[which], -1
        out = np.empty(int(counts.sum()), np.uint32)
        ends_out = np.cumsum(counts)
        old = np.flatnonzero(hit)
        out[runs((ends_out - counts)[old], counts[old])] = flat[runs(first[old], counts[old])]
        out[runs((ends_out - counts)[miss], counts[miss])] = new[runs(first_new[which], counts[miss])]
        _, once = np.unique(which, return_index=True)  # the first place of each new unit, by its number
        keep = once[(sizes[miss[once]] <= WIDTH) & (n_new <= WIDTH)]
        _, last = np.unique(slot[miss[keep]], return_index=True)  # one new unit a slot
        keep = keep[last]
        unit, to, rows = which[keep], slot[miss[keep]], miss[keep]
        self.keys[to], self.count[to] = keys[rows], n_new[unit]
        flat[runs(to * WIDTH, n_new[unit])] = new[runs(first_new[unit], n_new[unit])]
        return out, counts


def _split(flat: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(np.bincount(owner, weights=counts, minlength=n).astype(np.int64))[:-1])


class ByteLevel:
    """A byte-level BPE of the ``tokenizers`` library with at most 65,536 ids. ``plain``: its special tokens' strings in a text are plain text.

    Texts are split as its pattern says ('s and the like, letters, numbers, others with a space before them, white space). The units' merges are
    left to ``tiktoken``, with ranks from the tokenizer's own file, where the order of merges is that of their ids; texts beyond Latin-1, and those
    with special tokens, are encoded whole by ``tokenizers``.
    """

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, self.added))) if self.added and not plain else None
        self.ranked = self._ranks(path)
        self.cache = UnitCache(self._merge if self.ranked else self._one_by_one)

    def _ranks(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in pairs]
        if any(a >= b for a, b in zip(ids, ids[1:], strict=False)):
            return None
        ranks = {b: i for i, b in enumerate(self.bytes_of()) if self.tokenizer.id_to_token(i) not in self.added}
        return tiktoken.Encoding("units", pat_str=f"[^{SEP}]+|{SEP}", mergeable_ranks=ranks, special_tokens={})

    def _merge(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.ranked.encode_ordinary(SEP.join(u.decode("latin-1") for u in units)), np.uint32)
        cuts = np.append(np.flatnonzero(ids == self.ranked.encode_single_token(SEP)), len(ids))
        counts = np.diff(cuts, prepend=-1) - 1
        return np.delete(ids, cuts[:-1]), counts

    def _one_by_one(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode("latin-1") for u in units], add_special_tokens=False)]
        return np.array([i for x in ids for i in x], np.uint32), np.array(list(map(len, ids)), np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts, whole = [], {}
        for k, t in enumerate(texts):
            try:
                part = t.encode("latin-1")
            except UnicodeEncodeError:
                part = None
            if part is None or SEP in t or self.special and self.special.search(t):
                whole[k], part = self.tokenizer.encode(t, add_special_tokens=False).ids, b""
            parts.append(part)
        data = b"\x1e".join((*parts, b""))  # one after each text
        chars = np.frombuffer(data, np.uint8)
        kind = KIND[chars]
        before, after = np.append(np.uint8(0), kind[:-1]), np.append(kind[1:], np.uint8(0))
        white = kind > 3
        # white space gives its last character, a space to the unit after it, the rest is a unit
        start = np.where(white, (before < 4) | (after < 4) & (after > 0), (kind != before) & (before != 4) | (kind == 0))
        marks = np.flatnonzero((chars == 39) & start & (after == 1))
        if len(marks):
            one, two = chars[marks + 1], chars[np.minimum(marks + 2, len(chars) - 1)]
            short = np.isin(one, [*b"stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            start[marks[short | long] + 1] = False
            start[marks[short] + 2] = start[marks[long] + 3] = True
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], len(chars))
        inside = kind[starts] != 0
        owner = np.cumsum(~inside)[inside]
        flat, counts = self.cache.lookup(data, starts[inside], ends[inside])
        out = _split(flat, counts, owner, len(texts))
        for k, ids in whole.items():
            out[k] = np.array(ids, np.uint32)
        return out

    def bytes_of(self) -> list[bytes]:
        """The bytes of each id."""
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        out = [b""] * self.tokenizer.get_vocab_size()
        for piece, i in self.tokenizer.get_vocab().items():
            out[i] = piece.encode() if piece in self.added else bytes(letters[c] for c in piece)
        return out


class Pieces:
    """A ``sentencepiece`` BPE with byte fallback that puts a space before the text. No piece has a space behind another character, so spaces and what follows them are encoded apart."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces, self.space = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())], self.model.piece_to_id("▁")
        self.apart = not any(re.search("[^▁]▁", p) for p in self.pieces) and self.model.normalize("a  b\tﬁ ") == "▁a▁▁b\tﬁ▁"
        self.cache = UnitCache(self._each)

    def _each(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [i or [self.space] for i in self.model.encode([u[1:].decode() for u in units], num_threads=1)]
        return np.array([i for x in ids for i in x], np.uint32), np.array(list(map(len, ids)), np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        whole = {k: self.model.encode(t, num_threads=1) for k, t in enumerate(texts) if not self.apart or "▁" in t or SEP in t}
        data = "".join(f" {t}{SEP}" if t and k not in whole else SEP for k, t in enumerate(texts)).encode()
        chars = np.frombuffer(data, np.uint8)
        space = chars == 32
        end = chars == ord(SEP)
        starts = np.flatnonzero(end | space & np.append(True, ~space[:-1]))
        ends = np.append(starts[1:], len(chars))
        inside = ~end[starts]
        flat, counts = self.cache.lookup(data, starts[inside], ends[inside])
        out = _split(flat, counts, np.cumsum(~inside)[inside], len(texts))
        for k, ids in whole.items():
            out[k] = np.array(ids, np.uint32)
        return out

    def bytes_of(self) -> list[bytes]:
        """The bytes of each id."""
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]


_made: dict[tuple, object] = {}


def made(kind: type, *args):
    """A Python worker's own object of a kind: tasks that follow each other in a worker share what it remembers."""
    if (kind, args) not in _made:
        _made[kind, args] = kind(*args)
    return _made[kind, args]


def forget() -> None:
    """Gives back the memory of a worker's objects, for tasks of later stages that need none."""
    _made.clear()
