"""Linear-chain conditional random field over sparse binary features, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

Sequence_ = Sequence[Sequence[str]]


class LinearChainCRF:
    """Features per position are strings; weights per (feature, tag) and per pair of neighbouring tags."""

    def __init__(self, tags: Sequence[str], l2: float = 1e-3, epochs: int = 40, rate: float = 0.1):
        self.tags, self.l2, self.epochs, self.rate = list(tags), l2, epochs, rate
        self.index: dict[str, int] = {}
        self.w = self.t = self.start = None

    def _scores(self, seq: Sequence_) -> np.ndarray:
        out = np.zeros((len(seq), len(self.tags)))
        for i, feats in enumerate(seq):
            ids = [self.index[f] for f in feats if f in self.index]
            if ids:
                out[i] = self.w[ids].sum(axis=0)
        return out

    @staticmethod
    def _lse(a: np.ndarray, axis: int) -> np.ndarray:
        m = a.max(axis=axis, keepdims=True)
        return (m + np.log(np.exp(a - m).sum(axis=axis, keepdims=True))).squeeze(axis)

    def _forward_backward(self, s: np.ndarray):
        n, k = s.shape
        f, b = np.zeros((n, k)), np.zeros((n, k))
        f[0] = self.start + s[0]
        for i in range(1, n):
            f[i] = s[i] + self._lse(f[i - 1][:, None] + self.t, 0)
        for i in range(n - 2, -1, -1):
            b[i] = self._lse(self.t + (s[i + 1] + b[i + 1])[None, :], 1)
        return f, b, float(self._lse(f[-1], 0))

    def fit(self, rows: Sequence[Sequence_], labels: Sequence[Sequence[str]]) -> LinearChainCRF:
        """Mini-batch AdaGrad on the penalised log likelihood, in a fixed order."""
        k = len(self.tags)
        for seq in rows:
            for feats in seq:
                for f in feats:
                    self.index.setdefault(f, len(self.index))
        self.w, self.t, self.start = np.zeros((len(self.index), k)), np.zeros((k, k)), np.zeros(k)
        tag = {x: i for i, x in enumerate(self.tags)}
        gw, gt, gs = np.full_like(self.w, 1e-6), np.full_like(self.t, 1e-6), np.full_like(self.start, 1e-6)
        ids = [[[self.index[f] for f in feats] for feats in seq] for seq in rows]
        ys = [[tag[y] for y in seq] for seq in labels]
        order = np.random.RandomState(7).permutation(len(rows))
        for _ in range(self.epochs):
            for lo in range(0, len(order), 64):
                dw, dt, ds = self.l2 * self.w, self.l2 * self.t, self.l2 * self.start
                part = order[lo : lo + 64]
                single = [r for r in part if len(ids[r]) == 1]
                if single:  # sequences of one position need no chain
                    at = np.concatenate([ids[r][0] for r in single])
                    of = np.repeat(np.arange(len(single)), [len(ids[r][0]) for r in single])
                    s = np.tile(self.start, (len(single), 1))
                    np.add.at(s, of, self.w[at])
                    d = np.exp(s - self._lse(s, 1)[:, None])
                    d[np.arange(len(single)), [ys[r][0] for r in single]] -= 1
                    np.add.at(dw, at, d[of] / 64)
                    ds = ds + d.sum(axis=0) / 64
                for r in part:
                    if len(ids[r]) == 1:
                        continue
                    s = np.array([self.w[f].sum(axis=0) for f in ids[r]])
                    f, b, z = self._forward_backward(s)
                    p = np.exp(f + b - z)
                    for i, feats in enumerate(ids[r]):
                        d = p[i].copy()
                        d[ys[r][i]] -= 1
                        np.add.at(dw, feats, d / 64)
                    d = p[0].copy()
                    d[ys[r][0]] -= 1
                    ds = ds + d / 64
                    for i in range(1, len(s)):
                        joint = np.exp(f[i - 1][:, None] + self.t + (s[i] + b[i])[None, :] - z)
                        joint[ys[r][i - 1], ys[r][i]] -= 1
                        dt = dt + joint / 64
                for x, g, d in ((self.w, gw, dw), (self.t, gt, dt), (self.start, gs, ds)):
                    g += d * d
                    x -= self.rate * d / np.sqrt(g)
        return self

    def tag(self, seq: Sequence_) -> list[str]:
        """Best tags of a sequence."""
        if not seq:
            return []
        s = self._scores(seq)
        best, back = self.start + s[0], []
        for i in range(1, len(s)):
            step = best[:, None] + self.t
            back.append(step.argmax(axis=0))
            best = step.max(axis=0) + s[i]
        out = [int(best.argmax())]
        for choice in reversed(back):
            out.append(int(choice[out[-1]]))
        return [self.tags[i] for i in reversed(out)]
