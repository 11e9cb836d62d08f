"""Plain versions of the contracts, straight from their wording, for small tables."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def listed(spans, kinds):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, kinds.index(k), b, k) for k, a, b in spans))


def secrets(text):
    text, out = text or "", []
    assign = r"""(?:password|passwd|secret|token|api_?key)"""
    assign = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in assign).replace("(?:", "(?:")
    for m in re.finditer(assign + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append(("assign", *m.span()))
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return out + [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def personal(text):
    text, out = text or "", []
    figures = lambda s: re.sub("[^0-9]", "", s)
    out += [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(figures(m[0])) <= 19 and luhn(figures(m[0])):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(figures(m[0])) <= 15]


def exact(rows):
    """{row index: (keep_id, group_size, kept, sha)}; rows are (doc_id, text) with distinct ids."""
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append(i)
    out = {}
    for norm, at in groups.items():
        keep = min(at, key=lambda i: (-len(rows[i][1] or ""), rows[i][0]))
        for i in at:
            out[i] = (rows[keep][0], len(at), i == keep, sha(norm))
    return out


def line_key(line):
    return line.strip(" \t\n\v\f\r").translate(FOLD)


def line_dedup(rows, min_docs=3, min_chars=20):
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(line_key(x)) >= min_chars:
                held[line_key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(held[line_key(x)]) < min_docs or d == max(held[line_key(x)])]
        out.append((d, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def repeats(rows, size=50):
    """[(doc_id, n_words, n_removed, kept text)] of the substring contract."""
    split = [(d, SPACED.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def leaks(rows, items, size=10):
    held = defaultdict(set)
    for k, t in items:
        w = words(t)
        if w:
            n = min(size, len(w))
            for i in range(len(w) - n + 1):
                held[tuple(w[i : i + n])].add(str(k))
    sizes, out = {len(k) for k in held}, []
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in held:
                    hit.update(range(i, i + n))
                    found |= held[tuple(w[i : i + n])]
        out.append((d, len(w), len(hit), sorted(found)))
    return out


def fingerprint(text):
    w = SPACED.findall((text or "").translate(FOLD))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows, distance=4):
    """[(doc_id, fingerprint, smallest id reachable)]."""
    fps = np.array([fingerprint(t) for _, t in rows], dtype=np.uint64)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps) <= distance):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(d, int(fps[i]), least[root(i)]) for i, (d, _) in enumerate(rows)]
