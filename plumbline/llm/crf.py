"""A linear-chain conditional random field with two labels over sparse binary features, in numpy.

Only the sums that training and decoding need: scores are s[t] for label 1 against 0, and four transition weights.
Forward and backward values are kept as ratios of label 1 to label 0, so one number a position is enough.
Sequences lie end to end in one flat array. Long ones are walked in chunks, all chunks at once; what a chunk does to the
messages that pass through it is a 2 x 2 matrix, so messages are carried over exactly and no sequence is cut.
"""

from __future__ import annotations

import numpy as np

LIMIT = 30.0
#: Positions of a chunk.
CHUNK = 256


class Steps:
    """The positions of sequences in chunks, ordered so that step t holds every chunk longer than t."""

    def __init__(self, lengths: np.ndarray, chunk: int = CHUNK):
        whole = np.asarray(lengths, np.int64)
        whole = whole[whole > 0]
        times = -(-whole // chunk)
        owner = np.repeat(np.arange(len(whole)), times)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(times) - times, times)
        lengths = np.minimum(chunk, whole[owner] - place * chunk)
        self.n = int(lengths.sum())
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        self.starts, self.ends = starts[order], (starts + lengths)[order]
        self.head, self.tail = (place == 0)[order], (place == times[owner] - 1)[order]
        most = int(lengths.max()) if len(lengths) else 0
        self.live = np.searchsorted(-lengths[order], -np.arange(most), "left").tolist()  # chunks longer than t
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.long = [rank[at : at + n] for at, n in zip((np.cumsum(times) - times)[times > 1].tolist(), times[times > 1].tolist(), strict=True)]

    def forward(self):
        for t, m in enumerate(self.live):
            yield self.starts[:m] + t

    def backward(self):
        for t, m in enumerate(self.live):
            yield self.ends[:m] - 1 - t


def _through(e: np.ndarray, w: np.ndarray, positions, n: int, forward: bool) -> np.ndarray:
    """(2, 2, chunks): what each chunk makes of the message at its first (backward: last) position, up to a factor."""
    out, before = np.zeros((2, 2, n)), None
    out[0, 0] = out[1, 1] = 1
    for at in positions:
        m = len(at)
        if before is None:
            if forward:
                out[1] *= e[at]
        else:
            a = out[..., :m].copy()
            if forward:
                out[..., :m] = np.stack([w[0, 0] * a[0] + w[1, 0] * a[1], (w[0, 1] * a[0] + w[1, 1] * a[1]) * e[at]])
            else:
                x = a[1] * e[before[:m]]
                out[..., :m] = np.stack([w[0, 0] * a[0] + w[0, 1] * x, w[1, 0] * a[0] + w[1, 1] * x])
            out[..., :m] /= out[..., :m].max(axis=(0, 1))
        before = at
    return out


def _carried(e: np.ndarray, w: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """For each chunk the forward ratio just before it, and the backward ratio just after it (at the next chunk's start)."""
    before, after = np.ones(len(steps.starts)), np.ones(len(steps.starts))
    if steps.long:
        f = _through(e, w, steps.forward(), len(steps.starts), True)
        b = _through(e, w, steps.backward(), len(steps.starts), False)
        for chunks in steps.long:
            v = np.ones(2)
            for c, following in zip(chunks[:-1].tolist(), chunks[1:].tolist(), strict=True):
                v = f[..., c] @ v
                before[following] = v[1] / v[0]
                v = w.T @ (v / v.max())
            u = np.ones(2)
            for c, earlier in zip(chunks[:0:-1].tolist(), chunks[-2::-1].tolist(), strict=True):
                u = b[..., c] @ u
                after[earlier] = u[1] / u[0]
                u = w @ (u / u.max() * np.array([1.0, e[steps.starts[c]]]))
    return before, after


def ratios(s: np.ndarray, trans: np.ndarray, steps: Steps) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios at every position; trans[i, j] is the weight of label i then j."""
    e = np.exp(np.clip(s, -LIMIT, LIMIT))
    w = np.exp(np.clip(trans, -LIMIT, LIMIT))
    before, after = _carried(e, w, steps)
    f, b = np.empty(steps.n), np.empty(steps.n)
    r = None
    for at in steps.forward():
        if r is None:
            r = e[at] * np.where(steps.head, 1, (w[0, 1] + before * w[1, 1]) / (w[0, 0] + before * w[1, 0]))
        else:
            r = e[at] * (w[0, 1] + r[: len(at)] * w[1, 1]) / (w[0, 0] + r[: len(at)] * w[1, 0])
        f[at] = r
    r = None
    for at in steps.backward():
        if r is None:
            x = e[np.minimum(at + 1, steps.n - 1)] * after
            r = np.where(steps.tail, 1, (w[1, 0] + w[1, 1] * x) / (w[0, 0] + w[0, 1] * x))
        else:
            x = e[at + 1] * r[: len(at)]
            r = (w[1, 0] + w[1, 1] * x) / (w[0, 0] + w[0, 1] * x)
        b[at] = r
    return f, b


def marginals(s: np.ndarray, trans: np.ndarray, steps: Steps) -> np.ndarray:
    """The probability of label 1 at every position."""
    f, b = ratios(s, trans, steps)
    x = f * b
    return x / (1 + x)


def viterbi(s: np.ndarray, trans: np.ndarray) -> list[int]:
    """The likeliest labels of one sequence; ties go to label 0."""
    score, back = [0.0, float(s[0])] if len(s) else [], []
    for x in s[1:].tolist():
        step = [max((score[i] + trans[i, j], -i) for i in (0, 1)) for j in (0, 1)]
        back.append([-step[0][1], -step[1][1]])
        score = [step[0][0], step[1][0] + x]
    if not score:
        return []
    path = [int(score[1] > score[0])]
    for choice in reversed(back):
        path.append(choice[path[-1]])
    return path[::-1]


def train(
    chunks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], flat: np.ndarray, sizes: np.ndarray, n_features: int, rounds: int = 80, rate: float = 0.3, l2: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and transition weights, by AdaGrad on the mean log likelihood.

    chunks: (items, labels, lengths) of sequences; a position's item is the number of a feature list, and the lists
    lie end to end in `flat`, with their `sizes`. One chunk's values are in memory at a time.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    w, trans = np.zeros(n_features), np.zeros((2, 2))
    seen, seen_t = np.full(n_features, 1e-8), np.full((2, 2), 1e-8)
    plans = []
    for items, _, lengths in chunks:
        lengths = np.asarray(lengths, np.int64)
        first = np.zeros(len(items), bool)
        first[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        plans.append((Steps(lengths), np.flatnonzero(~first)))
    scale = 1 / max(1, sum(len(c[0]) for c in chunks))
    for _ in range(rounds):
        own = np.bincount(owner, w[flat], len(sizes))
        u = np.exp(np.clip(trans, -LIMIT, LIMIT))
        by_item, grad_t = np.zeros(len(sizes)), np.zeros((2, 2))
        for (items, labels, _), (steps, at) in zip(chunks, plans, strict=True):
            s, y = own[items], labels.astype(float)
            f, b = ratios(s, trans, steps)
            p = f * b / (1 + f * b)
            by_item += np.bincount(items, y - p, len(sizes))
            # what the labels say about neighbours, less what the field expects
            x, e = f[at - 1], np.exp(np.clip(s[at], -LIMIT, LIMIT)) * b[at]
            pair = np.array([[u[0, 0] + 0 * x, u[0, 1] * e], [u[1, 0] * x, u[1, 1] * x * e]])
            total = pair.sum(axis=(0, 1))
            before, now = y[at - 1], y[at]
            want = np.array([[((1 - before) * (1 - now)).sum(), ((1 - before) * now).sum()], [(before * (1 - now)).sum(), (before * now).sum()]])
            grad_t += want - (pair / total).sum(axis=2)
        grad = np.bincount(flat, by_item[owner], n_features) * scale - l2 * w
        grad_t = grad_t * scale - l2 * trans
        seen += grad**2
        seen_t += grad_t**2
        w += rate * grad / np.sqrt(seen)
        trans += rate * grad_t / np.sqrt(seen_t)
    return w, trans
