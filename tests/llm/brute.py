"""Plain versions of the operators for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(rows, k, percent):
    """doc_id to (set size, least id of the group)."""
    sets = {}
    for i, t in rows:
        w = words(fold(t))
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else (frozenset([tuple(w)]) if w else frozenset())
    owners = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in owners[x] if j > i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def without_repeats(rows, window):
    """Per row (n_words, n_removed, kept text)."""
    every = [words(t) for _, t in rows]
    starts = Counter(tuple(w[a : a + window]) for w in every for a in range(len(w) - window + 1))
    out = []
    for w in every:
        gone = set()
        for a in range(len(w) - window + 1):
            if starts[tuple(w[a : a + window])] > 1:
                gone.update(range(a, a + window))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n, r = len(w), len(hit)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n
