"""A linear-chain conditional random field over sparse named features.

Training is exact maximum likelihood (forward-backward, batched over padded sequences)
with Adam and L2; decoding is Viterbi over a batch of sequences at once.  Everything is
deterministic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_FLOOR = -1e4


@dataclass
class Crf:
    """Weights: ``emit[feature] -> one weight per label``, ``trans[from, to]``, ``start[label]``."""

    labels: tuple[str, ...]
    index: dict[str, int] = field(default_factory=dict)
    emit: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scores(self, sequences: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(padded emissions [n, longest, labels], lengths); features never seen in training are ignored."""
        get = self.index.get
        lens = np.fromiter(map(len, sequences), np.int64, len(sequences))
        flat: list[int] = []
        count: list[int] = []
        for seq in sequences:
            for feats in seq:
                ids = [i for f in feats if (i := get(f)) is not None]
                flat += ids
                count.append(len(ids))
        out = np.zeros((len(sequences), int(lens.max(initial=0)), len(self.labels)))
        if flat:
            sums = np.concatenate([np.zeros((1, len(self.labels))), np.cumsum(self.emit[flat], axis=0)])
            ends = np.cumsum(count)
            per = sums[ends] - sums[ends - np.array(count)]
            mask = np.arange(out.shape[1])[None, :] < lens[:, None]
            out[mask] = per
        return out, lens

    def decode(self, sequences: list[list[list[str]]]) -> list[np.ndarray]:
        """The likeliest labels of each sequence (Viterbi), as label indexes."""
        if not sequences:
            return []
        e, lens = self.scores(sequences)
        n, longest, k = e.shape
        if not longest:
            return [np.zeros(0, np.int64) for _ in sequences]
        best = e[:, 0] + self.start
        back = np.zeros((n, longest, k), np.int64)
        last = best.copy()
        for t in range(1, longest):
            options = best[:, :, None] + self.trans[None]
            back[:, t] = options.argmax(1)
            best = options.max(1) + e[:, t]
            live = lens > t
            last[live] = best[live]
        out = np.zeros((n, longest), np.int64)
        rows = np.arange(n)
        cur = last.argmax(1)
        for t in range(longest - 1, -1, -1):
            at_end = lens - 1 == t
            inside = lens - 1 > t
            if t + 1 < longest:
                cur = np.where(inside, back[rows, min(t + 1, longest - 1), cur], cur)
            out[:, t] = np.where(at_end | inside, cur, 0)
        return [out[i, : lens[i]] for i in range(n)]


def _logsumexp(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(
    sequences: list[list[list[str]]],
    tags: list[list[int]],
    labels: tuple[str, ...],
    *,
    epochs: int = 60,
    rate: float = 0.15,
    l2: float = 1e-3,
    min_count: int = 2,
) -> Crf:
    """Fit on labelled sequences; each token is a list of feature names."""
    seen: dict[str, int] = {}
    for seq in sequences:
        for feats in seq:
            for f in feats:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= min_count))}
    k = len(labels)
    model = Crf(labels, index, np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k))
    order = sorted(range(len(sequences)), key=lambda i: (len(sequences[i]), i))
    batches = [order[i : i + 256] for i in range(0, len(order), 256)]
    prepared = []
    for b in batches:
        seqs = [sequences[i] for i in b]
        lens = np.array([len(s) for s in seqs])
        longest = int(lens.max())
        y = np.zeros((len(b), longest), np.int64)
        tok, fid = [], []
        for r, i in enumerate(b):
            y[r, : lens[r]] = tags[i]
            for t, feats in enumerate(sequences[i]):
                ids = [index[f] for f in feats if f in index]
                tok += [r * longest + t] * len(ids)
                fid += ids
        prepared.append((lens, longest, y, np.array(tok), np.array(fid)))
    params = [model.emit, model.trans, model.start]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    total = sum(len(s) for s in sequences)
    for epoch in range(epochs):
        lr = rate * (1 - epoch / epochs) + 0.01
        for lens, longest, y, tok, fid in prepared:
            n = len(lens)
            e = np.stack([np.bincount(tok, model.emit[fid, c], n * longest) for c in range(k)], 1).reshape(n, longest, k)
            mask = np.arange(longest)[None, :] < lens[:, None]
            alpha = np.zeros((n, longest, k))
            alpha[:, 0] = e[:, 0] + model.start
            for t in range(1, longest):
                a = _logsumexp(alpha[:, t - 1][:, :, None] + model.trans[None], 1) + e[:, t]
                alpha[:, t] = np.where(mask[:, t][:, None], a, alpha[:, t - 1])
            z = _logsumexp(alpha[:, -1], 1)
            beta = np.zeros((n, longest, k))
            for t in range(longest - 2, -1, -1):
                b = _logsumexp(model.trans[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(mask[:, t + 1][:, None], b, 0.0)
            p = np.exp(np.where(mask[:, :, None], alpha + beta - z[:, None, None], _FLOOR))
            g = p.copy()
            rows, cols = np.nonzero(mask)
            g[rows, cols, y[rows, cols]] -= 1
            at_tokens = g.reshape(-1, k)[tok]
            g_emit = np.stack([np.bincount(fid, at_tokens[:, c], len(model.emit)) for c in range(k)], 1)
            g_trans = np.zeros((k, k))
            for t in range(1, longest):
                live = mask[:, t]
                if live.any():
                    joint = alpha[live, t - 1][:, :, None] + model.trans[None] + (e[live, t] + beta[live, t])[:, None, :] - z[live][:, None, None]
                    g_trans += np.exp(joint).sum(0)
                    np.subtract.at(g_trans, (y[live, t - 1], y[live, t]), 1)
            g_start = g[:, 0].sum(0)
            step += 1
            for i, (w, gr) in enumerate(zip(params, (g_emit, g_trans, g_start))):
                gr = gr / n + l2 * w * (n / max(total, 1)) * 50
                m1[i] = 0.9 * m1[i] + 0.1 * gr
                m2[i] = 0.999 * m2[i] + 0.001 * gr * gr
                w -= lr * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    return model
