"""Random forests on binned rows, many trees at a time in NumPy.

Rows with equal bins and class are one cell with a count, and a bag draws as many rows as there are, so a forest of cells has
the distribution of one of rows. Trees grow level by level, all trees of a batch in one histogram. Tree i depends on the seed,
its parameters and i alone: the first trees of a large forest are the small one.
"""

from __future__ import annotations

import numpy as np

BINS = 32
#: Cells times trees of a batch: some MB an array.
BATCH = 100_000


def splits(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """At most BINS - 1 thresholds between values of x: all midpoints, or those nearest to equal shares of weight."""
    values, at = np.unique(x, return_inverse=True)
    if len(values) <= BINS:
        cut = np.arange(1, len(values))
    else:
        below = np.cumsum(np.bincount(at, weight))[:-1]  # of values[:i + 1]
        share = np.arange(1, BINS) * weight.sum() / BINS
        i = np.minimum(np.searchsorted(below, share), len(below) - 1)
        i -= (i > 0) & (share - below[np.maximum(i - 1, 0)] < below[i] - share)
        cut = np.unique(i) + 1
    low, high = values[cut - 1], values[cut]
    mid = low + (high - low) / 2
    return np.where(mid < high, mid, low)  # neighbours without a number between them


def binned(x: np.ndarray, thresholds: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(t, x[:, f], side="left") for f, t in enumerate(thresholds)], axis=1).astype(np.uint8)


def cells(codes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, class, count) of the different rows."""
    key, room = y.astype(np.int64), 2
    for f in range(codes.shape[1]):
        if room > 2**62 // BINS:
            found, key = np.unique(key, return_inverse=True)
            room = len(found)
        key, room = key * BINS + codes[:, f], room * BINS
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return codes[first], y[first], count


def resampled(y: np.ndarray, count: np.ndarray, seed: int) -> np.ndarray:
    """Counts of as many rows of each class, drawn with replacement."""
    out, rng = np.zeros_like(count), np.random.default_rng(seed)
    for c in (0, 1):
        if (of := y == c).any():
            out[of] = rng.multinomial(count[of].sum(), count[of] / count[of].sum())
    return out


def _tried(key: np.ndarray, heap: np.ndarray, width: int, tries: int) -> np.ndarray:
    """(node, try): different features of each node, by a hash of its tree's key, its place and the feature."""
    if tries >= width:
        return np.broadcast_to(np.arange(width), (len(heap), width))
    h = (key + heap * np.uint64(0x9E3779B97F4A7C15))[:, None] + np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.argsort(h ^ (h >> np.uint64(31)), axis=1)[:, :tries]


def _best(codes: np.ndarray, y: np.ndarray, node: np.ndarray, cell: np.ndarray, drawn: np.ndarray, tried: np.ndarray, raw: np.ndarray, per: np.ndarray, leaf: int, bins: int) -> tuple[np.ndarray, ...]:
    """Of each node (gain, feature, bin, draws to the left by class) of its best split; a gain of 0 is none."""
    n, width = len(raw), codes.shape[1]
    gain, feature, last, left = np.zeros(n), np.zeros(n, np.intp), np.zeros(n, np.intp), np.zeros((n, 2))
    flat, base, slot = codes.ravel(), cell * width, node * (2 * bins) + y[cell]
    weight, size = raw * per, raw.sum(1)[:, None]
    total = weight.sum(1)
    before, every = weight[:, 0] * weight[:, 1] / total, np.arange(n)
    for f in tried.T:
        h = np.bincount(slot + 2 * flat[base + f[node]].astype(np.intp), drawn, n * bins * 2).reshape(n, bins, 2)
        zero, one = (h[:, :, c].cumsum(1)[:, :-1] for c in (0, 1))
        count = zero + one
        valid = (count >= leaf) & (size - count >= leaf)
        a, b = zero * per[0], one * per[1]
        c, d = weight[:, :1] - a, weight[:, 1:] - b
        after = a * b / np.where(valid, a + b, 1) + c * d / np.where(valid, c + d, 1)
        got = np.where(valid, 2 * (before[:, None] - after) / total[:, None], 0)
        i = got.argmax(1)
        better = (g := got[every, i]) > np.maximum(gain, 1e-12)
        gain, feature, last = np.where(better, g, gain), np.where(better, f, feature), np.where(better, i, last)
        left[better] = np.stack([zero[better, i[better]], one[better, i[better]]], axis=1)
    return gain, feature, last, left


def _bags(count: np.ndarray, seed: int, ids: range) -> tuple[np.ndarray, ...]:
    """(tree, cell, draws) of the cells that are drawn, and a key of each tree."""
    m, n = len(count), int(count.sum())
    bag, keys = np.empty((len(ids), m), np.int64), np.empty(len(ids), np.uint64)
    rows = np.repeat(np.arange(m), count) if n <= 8 * m else None  # two ways to the same draw; the quicker one
    for k, i in enumerate(ids):
        rng = np.random.default_rng([seed, i])
        keys[k] = rng.integers(2**63)
        bag[k] = rng.multinomial(n, count / n) if rows is None else np.bincount(rows.take(rng.integers(0, n, n)), minlength=m)
    at = np.flatnonzero(bag)
    return *divmod(at, m), bag.ravel()[at], keys


def _batch(codes: np.ndarray, y: np.ndarray, per: np.ndarray, bags: tuple[np.ndarray, ...], seen: np.ndarray, tries: int, leaf: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(probability of class 1 of each seen cell by tree, importances by tree, each tree's adding up to 1 or 0)."""
    tree, cell, drawn, keys = bags
    t, width, q, bins, node = len(keys), codes.shape[1], len(seen), int(codes.max()) + 1, tree
    raw = np.bincount(2 * tree + y[cell], drawn, 2 * t).reshape(t, 2)
    owner, heap = np.arange(t), np.ones(t, np.uint64)
    votes, gains = np.zeros(t * q), np.zeros(t * width)
    at, vote = np.repeat(owner, q), np.arange(t * q)  # nodes of the seen cells, places of their votes
    flat = seen.ravel()
    for level in range(depth + 1):
        weight = raw * per
        total = weight.sum(1)
        chance = np.divide(weight[:, 1], total, out=np.zeros(len(total)), where=total > 0)
        split, feature, last, left = np.zeros(len(raw), bool), np.zeros(len(raw), np.intp), np.zeros(len(raw), np.intp), np.zeros((len(raw), 2))
        if level < depth and bins > 1:
            live = (raw > 0).all(1) & (raw.sum(1) >= 2 * leaf)
            place, keep = np.cumsum(live) - 1, live[node]
            node, cell, drawn = node[keep], cell[keep], drawn[keep]
            if len(node):
                gain, f, b, l = _best(codes, y, place[node], cell, drawn, _tried(keys[owner[live]], heap[live], width, tries), raw[live], per, leaf, bins)
                split[live], feature[live], last[live], left[live] = gain > 0, f, b, l
                gains += np.bincount(owner[live] * width + f, gain * total[live], t * width)
        done = ~split[at]
        votes[vote[done]] = chance[at[done]]
        if not split.any():
            break
        child = 2 * (np.cumsum(split) - 1)
        at, vote = at[~done], vote[~done]
        at = child[at] + (flat[(vote % q) * width + feature[at]] > last[at])
        keep = split[node]
        node, cell, drawn = node[keep], cell[keep], drawn[keep]
        node = child[node] + (codes.ravel()[cell * width + feature[node]] > last[node])
        raw = np.stack([left[split], raw[split] - left[split]], axis=1).reshape(-1, 2)
        owner, heap = np.repeat(owner[split], 2), np.repeat(2 * heap[split], 2)
        heap[1::2] += np.uint64(1)
    gains = gains.reshape(t, width)
    whole = gains.sum(1, keepdims=True)
    return votes.reshape(t, q), np.divide(gains, whole, out=np.zeros_like(gains), where=whole > 0)


def grown(codes: np.ndarray, y: np.ndarray, count: np.ndarray, seen: np.ndarray, tries: int, leaves: list[int], trees: list[int], seed: int, depth: int = 10) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By (leaf, number of trees) (probability of class 1 of each seen cell, importances). Classes weigh n / (2 * n_c); a node tries
    `tries` features and needs `leaf` draws on either side of a split. Leaf sizes share their bags."""
    y, some = y.astype(np.intp), count > 0
    codes, y, count = codes[some], y[some], count[some]
    size = np.bincount(y, count, 2)
    per = np.divide(size.sum(), 2 * size, out=np.zeros(2), where=size > 0)
    out, at, step = {}, 0, max(1, BATCH // max(len(count), len(seen)))
    votes, gains = np.zeros((len(leaves), len(seen))), np.zeros((len(leaves), codes.shape[1]))
    for most in sorted(set(trees)):
        while at < most:
            bags = _bags(count, seed, range(at, min(most, at + step)))
            for i, leaf in enumerate(leaves):
                v, g = _batch(codes, y, per, bags, seen, tries, leaf, depth)
                votes[i] += v.sum(0)
                gains[i] += g.sum(0)
            at += len(bags[-1])
        for i, leaf in enumerate(leaves):
            out[leaf, most] = votes[i] / most, gains[i] / (gains[i].sum() or 1)
    return out


def outcome(y: np.ndarray, chance: np.ndarray, count: np.ndarray) -> tuple[int, int, int, int, float | None]:
    """(tn, fp, fn, tp, auc) of cells; class 1 from over half, auc with ties, None with one class."""
    tn, fp, fn, tp = np.bincount(2 * y.astype(np.intp) + (chance > 0.5), count, 4)
    _, at = np.unique(chance, return_inverse=True)
    bad, good = np.bincount(at, np.where(y == 0, count, 0)), np.bincount(at, np.where(y == 1, count, 0))
    pairs = bad.sum() * good.sum()
    return int(tn), int(fp), int(fn), int(tp), float((good * (np.cumsum(bad) - bad / 2)).sum() / pairs) if pairs else None
