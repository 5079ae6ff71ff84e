"""Plain-Python references shared by the tests."""


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def components(rows, percent=80):
    """doc_id -> (set size, smallest linked id), all pairs that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inverted = {}
    for d in sorted(sets):
        for s in sets[d]:
            inverted.setdefault(s, []).append(d)
    pairs = {(a, b) for ids in inverted.values() for i, a in enumerate(ids) for b in ids[i + 1:]}
    for a, b in pairs:
        x, y = sets[a], sets[b]
        if 100 * len(x & y) >= percent * len(x | y):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in sets}
