"""Plain Python versions of what the operators compute, for small inputs."""

import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=True):
    text = text or ""
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def shingle_set(text, width):
    w = words(text)
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_duplicates(rows, width, percent):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {i: shingle_set(t, width) for i, t in rows}
    union = Union()
    for i in sets:
        union.find(i)
    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        both = len(a & b)
        if both and 100 * both >= percent * len(a | b):
            union.join(i, j)
    return {i: (len(sets[i]), union.find(i)) for i in sets}


def targets(sizes, shares=(3, 1, 2), total=1.5, most=2):
    """source -> target by sharing out, capping and sharing again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: shares[k % len(shares)] for k, s in enumerate(order)}
    left, open_, out = total * sum(sizes.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * unit >= most * sizes[s]]
        if not full:
            out |= {s: weight[s] * unit for s in open_}
            break
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out
