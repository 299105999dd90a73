"""Plain versions of the operators, for small tables."""

import hashlib
import re

BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PLAIN_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def substring(rows, m):
    docs = [(d, BLANK_WORDS.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        if d is not None:
            for i in range(len(w) - m + 1):
                k = tuple(w[i : i + m])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        if d is not None:
            for i in range(len(w) - m + 1):
                if first[tuple(w[i : i + m])] < d:
                    gone[i : i + m] = [True] * m
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def contained(docs, items, m):
    windows = {}
    for i, t in items:
        w = PLAIN_WORDS.findall(lowered(t))
        if w and i is not None:
            for k in range(max(1, len(w) - m + 1)):
                windows.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = PLAIN_WORDS.findall(lowered(t))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                ids = windows.get(tuple(w[k : k + n]))
                if ids:
                    hit.update(range(k, k + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def shingles(text, size):
    w = BLANK_WORDS.findall(lowered(text))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(ids, linked):
    """Smallest reachable id of each id; `linked` gives pairs."""
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def jaccard(docs, size=5, percent=75):
    sets = {d: shingles(t, size) for d, t in docs}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    found = components(ids, links)
    return sorted((d, len(sets[d]), found[d]) for d in ids)


def rows(df):
    return sorted((tuple(x) for x in df.collect()), key=str)
