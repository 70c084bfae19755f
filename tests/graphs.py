"""Plain Python answers on small graphs, and makers of small tables."""

import hashlib
import random
from collections import defaultdict, deque


def both_ways(pairs):
    pairs = list(pairs)
    return sorted({(a, b) for a, b in pairs if a != b} | {(b, a) for a, b in pairs if a != b})


def random_graph(seed, n=40, m=45):
    draw = random.Random(seed)
    return both_ways((draw.randrange(n), draw.randrange(n)) for _ in range(m))


def neighbours(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    return out


def distances(edges, start):
    near, found, todo = neighbours(edges), {start: 0}, deque([start])
    while todo:
        v = todo.popleft()
        for w in near[v]:
            if w not in found:
                found[w] = found[v] + 1
                todo.append(w)
    return found


def greedy_cover(edges):
    """One vertex at a time: the largest residual degree, ties by the smallest MD5 of the id."""
    mixed = lambda x: hashlib.md5(str(x).encode()).hexdigest()
    near, cover = {v: set(ws) for v, ws in neighbours(edges).items()}, {}
    while any(near.values()):
        v = min(near, key=lambda x: (-len(near[x]), mixed(x), x))
        cover[v] = len(near[v])
        for w in near.pop(v):
            near[w].discard(v)
    return cover


def rows(df):
    return sorted(tuple(r) for r in df.collect())
