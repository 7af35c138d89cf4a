"""Near copies by brute force over five-word sets."""

import itertools


def words_set(t, size=5):
    w = (t or "").encode().lower().split()
    return frozenset([b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] * bool(w))


def least_ids(rows):
    sets, up = {i: words_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(up), 2):
        x, y = sets[a], sets[b]
        if x == y or 5 * len(x & y) >= 4 * len(x | y):
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    return {find(i) for i in up}
