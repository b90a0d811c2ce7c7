"""Plain versions of the operators, for small inputs."""

import re


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def near_groups(rows, n=4, num=85, den=100):
    """{key: (n_shingles, smallest key of its group)} of (key, text) with distinct keys."""
    sets = {k: shingles(t, n) for k, t in rows}
    keys = [k for k in sets if k is not None and sets[k]]
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k) if k in root else k) for k, s in sets.items()}


def repeated(rows, span=50):
    """[(covered byte flags)] of (key, bytes)."""
    first = {}
    for k, t in rows:
        if k is not None:
            for i in range(len(t) - span + 1):
                w = t[i:i + span]
                first[w] = min(first.get(w, k), k)
    out = []
    for k, t in rows:
        c = bytearray(len(t))
        if k is not None:
            for i in range(len(t) - span + 1):
                if first[t[i:i + span]] < k:
                    c[i:i + span] = b"\1" * span
        out.append(bytes(c))
    return out
