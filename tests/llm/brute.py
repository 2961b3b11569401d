"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text, lower=False):
    b = (text or "").encode()
    return (b.translate(_LOWER) if lower else b).split()


def smallest_reachable(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = words(text, True)
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def near_duplicates(docs):
    """docs: list of (id, text) with distinct ids -> {id: (set size, component)}."""
    sets = {d: shingles(t) for d, t in docs}
    ids = sorted(sets)
    links = []
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    component = smallest_reachable(ids, links)
    return {d: (len(sets[d]), component[d]) for d in ids}


def without_repeats(docs, window=50):
    """docs: list of (id, text) with distinct ids -> {id: kept words}."""
    first = {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, t in docs:
        w = words(t)
        cut = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                cut.update(range(i, i + window))
        out[d] = [x for k, x in enumerate(w) if k not in cut]
    return out


def greedy_pieces(word, heads, tails):
    at, n = 0, 0
    while at < len(word):
        known = heads if at == 0 else tails
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def water_filled(sizes, weights, share, max_rate):
    """Targets by sharing the excess again until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    cap = {s: max_rate * sizes[s] for s in order}
    target = dict.fromkeys(order, 0.0)
    left = share * sum(sizes.values())
    open_ = set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= cap[s]:
                left += target[s] - cap[s]
                target[s] = cap[s]
                open_.discard(s)
    return target


def fold(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod


def unigram(train, texts):
    """(tokens, distinct, {id: base score parts}) as the contract of the base score says."""
    counts = Counter(t for text in train for t in [*words(text, True), None])
    return sum(counts.values()), len(counts), {d: [counts[t] for t in [*words(x, True), None]] for d, x in texts}


def links_of_vectors(rows, threshold):
    """rows: (id, vector, label) -> ({id: links}, {id: component})."""
    import math

    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    links, count = [], defaultdict(int)
    for i, (a, v, x) in enumerate(rows):
        for b, w, y in rows[i + 1 :]:
            if x is None or x != y or not usable(v) or not usable(w) or len(v) != len(w):
                continue
            dot = sum(p * q for p, q in zip(v, w))
            if dot / math.sqrt(sum(p * p for p in v) * sum(q * q for q in w)) >= threshold:
                links.append((a, b))
                count[a] += 1
                count[b] += 1
    return count, smallest_reachable([r[0] for r in rows], links)


def kneser_ney(learn, ask, d=0.75):
    """log10 probability per token of texts by interpolated Kneser-Ney on the word before, words unknown sharing one place."""
    pairs = Counter()
    for t in learn:
        line = ["<s>", *words(t, lower=True), "</s>"]
        pairs.update(zip(line, line[1:]))
    total, followers, before = Counter(), Counter(), Counter()
    for (u, w), n in pairs.items():
        total[u] += n
        followers[u] += 1
        before[w] += 1
    score, tokens = 0.0, 0
    for t in ask:
        line = ["<s>", *words(t, lower=True), "</s>"]
        for u, w in zip(line, line[1:]):
            p = (max(before[w] - d, 0) + d * len(before) / (len(before) + 1)) / len(pairs)
            if total[u]:
                p = (max(pairs[u, w] - d, 0) + d * followers[u] * p) / total[u]
            score += math.log10(p)
            tokens += 1
    return score / tokens
