"""Plain versions of the operators' results, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

UPPER = {c: c + 32 for c in range(65, 91)}
LOWER = lambda t: (t or "").translate(UPPER)
SPLIT = re.compile("[^\x20\x09-\x0d]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingles(text, k):
    w = SPLIT.findall(LOWER(text))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def components(docs, k, percent):
    """doc_id -> (set size, component)."""
    sets = {i: shingles(t, k) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    owners = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    common = Counter((a, b) for ids in owners.values() for a in ids for b in ids if a < b)
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def leaks(docs, items, size=10):
    """doc_id -> (words, hit words, item ids)."""
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(LOWER(t))
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[s : s + n])].add(i)
    out = []
    for i, t in docs:
        w = WORD.findall(LOWER(t))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    found |= own
                    hit |= set(range(s, s + n))
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return out


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans)).encode()).hexdigest()


def secrets(text):
    t = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    return out + [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def personal(text):
    t = text or ""
    digits = lambda x: re.sub("[^0-9]", "", x)
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := digits(m[0])) <= 19 and luhn(d)]
    return out + [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def unigram_scores(docs):
    """doc_id -> (held out, tokens, known tokens, training tokens, base score)."""
    split = {i: [*SPLIT.findall(LOWER(t)), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in split}
    counts = Counter(w for i, words in split.items() if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    return {i: (held[i], len(words), sum(counts[w] > 0 for w in words), n, sum(log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in words)) for i, words in split.items()}


def packed(docs, path, end):
    """(doc_id, start, tokens, crc32) in order of id."""
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, []
    for i, t in sorted(docs, key=lambda x: (x[0], x[1] or "")):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    return out
