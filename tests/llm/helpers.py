"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    """Disjoint sets whose names are their smallest members."""

    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


def shingles(text, size):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = WORDS.findall(lowered)
    if not words:
        return set()
    if len(words) < size:
        return {tuple(words)}
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def near_documents(docs, size, percent):
    """doc_id -> (shingles, class), from all pairs that share a shingle."""
    sets = {i: shingles(t, size) for i, t in docs}
    holders, groups = defaultdict(list), Sets()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for i, s in sets.items():
        common = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                groups.join(i, j)
    return {i: (len(s), groups.find(i)) for i, s in sets.items()}


def cut_texts(docs, length):
    """doc_id -> (bytes, removed, runs, bytes left); ids are unique, null first."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            window = data[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        runs = sum(1 for k, x in enumerate(gone) if x and (k == 0 or not gone[k - 1]))
        out[i] = (len(data), sum(gone), runs, bytes(c for c, x in zip(data, gone) if not x))
    return out


def own_figures(text):
    """Words, characters in words, symbols, repeated lines and repeated words of a text."""
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {k for i, w in enumerate(windows) if counts[w] > 1 for k in range(i, i + 5)}
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    )
