"""Brute-force versions of the operators, for small tables."""

import collections


def words(text):
    return (text or "").encode().lower().split()


def thue_morse(n, letters="ab"):
    """n letters and their complement: equal under every polynomial hash modulo 2**64 for n = 2,048."""
    one = [letters[i.bit_count() & 1] for i in range(n)]
    return one, [letters[1 - letters.index(x)] for x in one]


def brute_tiles(item, doc, m):
    marked_i, marked_j, out = set(), set(), []
    while True:
        best = None
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in marked_i and j + n not in marked_j:
                    n += 1
                if n >= m and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        marked_i |= set(range(best[0], best[0] + best[2]))
        marked_j |= set(range(best[1], best[1] + best[2]))


def brute_quality(text):
    t = text or ""
    w = t.encode().split()
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if x.encode().split():
            dup += x in seen
            seen.add(x)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside), failed


def brute_simhash(text):
    import xxhash

    w = words(text)
    if not w:
        return 0
    grams = [w[i : i + 4] for i in range(len(w) - 3)] or [w]
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def repeats(texts, n=51):
    held = collections.defaultdict(set)
    for k, t in texts.items():
        w = words(t)
        for i in range(len(w) - n + 1):
            held[b" ".join(w[i : i + n])].add(k)
    return [v for v in held.values() if len(v) > 1]


def brute_alike(texts, width=5, similarity=0.8):
    """The least key of each text's group, linked by the Jaccard similarity of word shingles, over all pairs."""
    sets = {}
    for k, t in texts.items():
        w = words(t)
        n = min(width, max(len(w), 1))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    label = {k: k for k in texts}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {k: root(k) for k in texts}
