"""Plain versions of the operators, for small inputs."""

import hashlib

import xxhash


def covered(docs, k):
    """docs: (id, tokens). For each: which tokens a window covers that starts in a document with a smaller id."""
    least = {}
    ids = [float("inf") if i is None else i for i, _ in docs]
    for i, (_, t) in zip(ids, docs, strict=True):
        for s in range(len(t) - k + 1):
            w = tuple(t[s : s + k])
            least[w] = min(least.get(w, float("inf")), i)
    out = []
    for i, (_, t) in zip(ids, docs, strict=True):
        gone = [False] * len(t)
        for s in range(len(t) - k + 1):
            if least[tuple(t[s : s + k])] < i:
                gone[s : s + k] = [True] * k
        out.append(gone)
    return out


def op1(rows, k=13):
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    return sorted(((i, len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for (i, w), g in zip(docs, covered(docs, k), strict=True)), key=str)


def op4(rows, k=50):
    docs = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, b), g in zip(docs, covered(docs, k), strict=True):
        spans = sum(y and not (j and g[j - 1]) for j, y in enumerate(g))
        out.append((i, len(b), sum(g), spans, hashlib.sha256(bytes(x for x, y in zip(b, g, strict=True) if not y)).hexdigest()))
    return sorted(out, key=str)


def simhash(text, shingle=4, seed=42):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, seed) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    """nodes: list of ids; linked: predicate on positions. The least id reachable from each."""
    label = list(range(len(nodes)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(i, j):
                a, b = root(i), root(j)
                if a != b:
                    label[max(a, b)] = min(a, b)
    least = {}
    for i, n in enumerate(nodes):
        if n is not None:
            least[root(i)] = min(least.get(root(i), n), n)
    return [least.get(root(i)) for i in range(len(nodes))]
