"""A linear-chain conditional random field over words, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .text import flat_index, hash_spans, mix

#: Hashed features, and words in a block of the forward-backward pass.
FEATURES, BLOCK = 1 << 17, 64


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram features in a row, with 2 n + 1 for a word of n bytes; affix and lexicon features, 7 a word)."""
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    b = data[flat_index(starts, sizes)].astype(np.uint64) + np.uint64(1)
    one, two = np.roll(b, 1), np.roll(b, 2)
    one[first] = 0
    two[first] = 0
    long = first[sizes > 1]
    two[long + 1] = 0
    pair = one << np.uint64(9) | b
    triple = np.uint64(1) << np.uint64(40) | two << np.uint64(18) | pair
    at = first + sizes - 1
    closing = np.uint64(1) << np.uint64(41) | one[at] << np.uint64(9) | b[at]
    grams = np.empty(2 * len(b) + len(sizes), np.uint64)
    base = 2 * first + np.arange(len(sizes))
    within = np.arange(len(b)) - np.repeat(first, sizes)
    place = np.repeat(base, sizes) + 2 * within
    grams[place], grams[place + 1] = pair, triple
    grams[base + 2 * sizes] = closing
    affix = np.empty((len(sizes), 7), np.uint64)
    for k in (1, 2, 3):
        head, tail = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
        for j in range(k):
            head = head << np.uint64(9) | np.where(sizes > j, b[np.minimum(first + j, at)], 0)
            tail = tail << np.uint64(9) | np.where(sizes > j, b[np.maximum(at - j, first)], 0)
        affix[:, 2 * k - 2], affix[:, 2 * k - 1] = head | np.uint64(k) << np.uint64(44), tail | np.uint64(k + 4) << np.uint64(44)
    affix[:, 6] = hash_spans(data, starts, ends)
    slot = lambda x: (mix(x) % np.uint64(FEATURES)).astype(np.int32)
    return slot(grams), slot(affix)


@dataclass
class CRF:
    labels: list[str]
    weights: np.ndarray  # FEATURES x labels
    transitions: np.ndarray  # from x to
    start: np.ndarray

    @classmethod
    def blank(cls, labels: list[str]) -> CRF:
        n = len(labels)
        return cls(labels, np.zeros((FEATURES, n), np.float32), np.zeros((n, n)), np.zeros(n))

    def emissions(self, grams: np.ndarray, affix: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of each word for each label."""
        if not len(sizes):
            return np.zeros((0, len(self.labels)), np.float32)
        each = 2 * sizes + 1
        return np.add.reduceat(self.weights[grams], np.cumsum(each) - each, axis=0) + self.weights[affix].sum(axis=1)

    def posteriors(self, scores: np.ndarray, before: np.ndarray, pairs: bool = False):
        """Marginals of each word's label by forward-backward; texts are bounded by `before`.

        Texts are cut into blocks of words. All blocks' transfer matrices are made side by side,
        chained within each text, and then the forward and backward vectors run in all blocks at
        once, so a long text needs no more steps than others. With `pairs`, also the summed
        marginals of neighbouring labels.
        """
        n, labels = scores.shape
        none = np.zeros((labels, labels))
        if not n:
            return (np.zeros((0, labels)), none) if pairs else np.zeros((0, labels))
        sizes = np.diff(before)
        e = np.exp((scores - scores.max(axis=1, keepdims=True)).astype(np.float64))
        full = sizes > 0
        opening = before[:-1][full]
        e[opening] *= np.exp(self.start - self.start.max())
        step = np.exp(self.transitions - self.transitions.max())
        blocks = -(-sizes[full] // BLOCK)
        text = np.repeat(np.arange(len(blocks)), blocks)
        number = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = opening[text] + number * BLOCK
        length = np.minimum(BLOCK, sizes[full][text] - number * BLOCK)
        head = number == 0
        longest = int(length.max())
        norm = lambda x, axes: x / np.maximum(x.sum(axis=axes, keepdims=True), 1e-300)

        matrix = np.broadcast_to(np.eye(labels), (len(text), labels, labels)).copy()
        if int(blocks.max()) > 1:
            for t in range(longest):
                on = np.flatnonzero((length > t) & ~(head & (t == 0)))
                matrix[on] = norm(matrix[on] @ step * e[at[on] + t][:, None, :], (1, 2))
                if t == 0:
                    on = np.flatnonzero(head)
                    matrix[on] = np.eye(labels) * e[at[on]][:, None, :]
        enter, leave = np.ones((len(text), labels)), np.ones((len(text), labels))
        for k in range(1, int(blocks.max())):
            on = np.flatnonzero(number == k)
            enter[on] = norm((enter[on - 1][:, None, :] @ matrix[on - 1])[:, 0], 1)
        last = blocks[text] - 1 - number
        for k in range(1, int(blocks.max())):
            on = np.flatnonzero(last == k)
            leave[on] = norm((matrix[on + 1] @ leave[on + 1][:, :, None])[:, :, 0], 1)

        forward, backward = np.empty((n, labels)), np.empty((n, labels))
        vector = enter
        for t in range(longest):
            on = np.flatnonzero(length > t)
            came = vector[on] @ step
            if t == 0:
                came[head] = 1.0
            vector[on] = forward[at[on] + t] = norm(came * e[at[on] + t], 1)
        vector = leave
        for t in range(longest - 1, -1, -1):
            on = np.flatnonzero(length > t)
            backward[at[on] + t] = vector[on]
            vector[on] = norm((vector[on] * e[at[on] + t]) @ step.T, 1)
        marginals = norm(forward * backward, 1)
        if not pairs:
            return marginals
        inner = np.ones(n, bool)
        inner[opening] = False
        now = np.flatnonzero(inner)
        joint = forward[now - 1][:, :, None] * step * (e[now] * backward[now])[:, None, :]
        return marginals, norm(joint, (1, 2)).sum(axis=0) if len(now) else none


def train(texts: list[bytes], labels: list[str], spans, epochs: int = 6, batch: int = 24, rate: float = 0.5, seed: int = 1) -> CRF:
    """Fit by AdaGrad on the log-likelihood; spans(data) gives the words of a text.

    Every second sequence joins pieces of several texts, so that switches are learned too.
    """
    model = CRF.blank(sorted(set(labels)))
    if not texts:
        return model
    number = {x: k for k, x in enumerate(model.labels)}
    data = np.frombuffer(b" ".join(texts), np.uint8)
    edges = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, ends = spans(data)
    hashes = hash_spans(data, starts, ends)
    _, where, word = np.unique(hashes, return_index=True, return_inverse=True)
    sizes = ends[where] - starts[where]
    order = np.argsort(where)  # spans must be in order
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    where, sizes, word = where[order], sizes[order], rank[word]
    grams, affix = word_features(data, starts[where], ends[where])
    each = 2 * sizes + 1
    grams_at = np.cumsum(each) - each
    before = np.searchsorted(starts, edges)
    rnd = np.random.default_rng(seed)
    sums = np.full(model.weights.shape, 1e-2, np.float32)
    more = [np.full(model.transitions.shape, 1e-2), np.full(model.start.shape, 1e-2)]
    truth = np.array([number[x] for x in labels])
    for _ in range(epochs):
        for chosen in np.array_split(rnd.permutation(len(texts)), max(1, len(texts) // batch)):
            parts, tags, bounds, total = [], [], [0], 0
            for k, d in enumerate(chosen.tolist()):
                a, b = int(before[d]), int(before[d + 1])
                if k % 2 and b - a > 20:  # a piece, joined to the sequence before it
                    a = int(rnd.integers(a, b - 10))
                    b = min(b, a + int(rnd.integers(5, 60)))
                elif total > bounds[-1]:
                    bounds.append(total)
                parts.append(word[a:b])
                tags.append(np.full(b - a, truth[d]))
                total += b - a
            ids, tag = np.concatenate(parts), np.concatenate(tags)
            bound = np.array(bounds + [total] * (total > bounds[-1]))
            used, back = np.unique(ids, return_inverse=True)
            if not len(used):
                continue
            own = grams[flat_index(grams_at[used], each[used])]
            scores = model.emissions(own, affix[used], sizes[used])
            marginals, pairs = model.posteriors(scores[back], bound, pairs=True)
            error = -marginals
            error[np.arange(len(ids)), tag] += 1
            step = -pairs
            opening = np.zeros(len(ids) + 1, bool)
            opening[bound] = True
            now = np.flatnonzero(~opening[: len(ids)])
            np.add.at(step, (tag[now - 1], tag[now]), 1)
            begin = error[bound[:-1]].sum(axis=0)
            by_word = np.stack([np.bincount(back, error[:, c], len(used)) for c in range(len(model.labels))], 1)
            slots, inverse = np.unique(np.concatenate([own, affix[used].reshape(-1)]), return_inverse=True)
            owner = np.concatenate([np.repeat(np.arange(len(used)), each[used]), np.repeat(np.arange(len(used)), 7)])
            gradient = np.stack([np.bincount(inverse, by_word[owner, c], len(slots)) for c in range(len(model.labels))], 1) / max(1, len(chosen))
            sums[slots] += gradient**2
            model.weights[slots] += rate * 0.2 * gradient / np.sqrt(sums[slots])
            for value, g, total in ((model.transitions, step / len(chosen), more[0]), (model.start, begin / len(chosen), more[1])):
                total += g**2
                value += rate * 0.2 * g / np.sqrt(total)
    return model
