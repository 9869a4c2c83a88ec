"""The operators' results by plain loops."""

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(prints, bits=3):
    """Smallest key reachable, per key, over fingerprints of at most so many bits apart."""
    keys = sorted(prints)
    root = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if (prints[a] ^ prints[b]).bit_count() <= bits and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def without_chunks(docs):
    """``{(key, place in docs): (text, removed lines)}`` of ``[(key, text)]``: pairs of lines
    that are not blank, their first occurrences, and of those the ones that lose no line."""
    rid = lambda t: (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted({(k is not None, k or 0, rid(t or ""), t) for k, t in docs})
    solid = {d: [i for i, x in enumerate((d[3] or "").split("\n")) if x.strip(" \t\r\v\f")] for d in order}
    lines = {d: (d[3] or "").split("\n") for d in order}
    pair = lambda d, p: (lines[d][solid[d][p]], lines[d][solid[d][p + 1]])
    first, others = {}, []
    for d in order:
        for p in range(len(solid[d]) - 1):
            e, q = first.setdefault(pair(d, p), (d, p))
            if e != d or p >= q + 2:
                others.append((d, p))
    lost = {(d, i) for d, p in others for i in (p, p + 1)}
    whole = {w for w, (d, p) in first.items() if not {(d, p), (d, p + 1)} & lost}
    gone = {d: set() for d in order}
    for d, p in others:
        if pair(d, p) in whole:
            gone[d].update(range(solid[d][p], solid[d][p + 1] + 1))
    out = {}
    for n, (k, t) in enumerate(docs):
        d = (k is not None, k or 0, rid(t or ""), t)
        kept = "\n".join(x for i, x in enumerate(lines[d]) if i not in gone[d])
        out[k, n] = (t if t is None else kept, len(gone[d]))
    return out


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """Resharing by rounds, as the rule is told. ``sizes``: ``{source: words}``."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    stopped, total = {}, float(sum(sizes.values()))
    while True:
        open_ones = [s for s in order if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
        above = [s for s in open_ones if share[s] >= most * sizes[s]]
        if not above:
            return {**stopped, **share}
        stopped.update({s: most * sizes[s] for s in above})


def nearest(ids, vectors, query, k):
    scores = [(-(vectors[i] * vectors[query]).sum(), ids[i]) for i in range(len(ids)) if ids[i] != ids[query]]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def integer_vectors(vectors):
    return np.floor(np.asarray(vectors, np.float64) * 64).astype(np.int64)
