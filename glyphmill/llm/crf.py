"""A linear-chain conditional random field with two labels over sets of binary features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    names: dict[str, int]  # feature -> row
    unary: np.ndarray  # features x 2
    pair: np.ndarray  # 2 x 2, from label to label
    first: np.ndarray  # 2

    @classmethod
    def train(cls, pages: list[list[set[str]]], labels: list[list[int]], steps: int = 250, ridge: float = 2e-5) -> Chain:
        """Maximises the conditional log-likelihood by Adam; all pages of a step run through the
        forward and backward recursions together, padded to the longest."""
        names = {f: i for i, f in enumerate(sorted({f for p in pages for b in p for f in b}))}
        n, width, f = len(pages), max(map(len, pages)), len(names)
        x, y, mask = np.zeros((n, width, f), np.float32), np.zeros((n, width), int), np.zeros((n, width), bool)
        for i, (p, own) in enumerate(zip(pages, labels)):
            for t, b in enumerate(p):
                x[i, t, [names[k] for k in b]] = 1
            y[i, : len(own)], mask[i, : len(own)] = own, True
        gold = np.eye(2)[y] * mask[..., None]
        total = mask.sum()
        last = mask.sum(1) - 1
        both = mask[:, 1:] & mask[:, :-1]
        gold_pair = np.einsum("nta,ntb,nt->ab", gold[:, :-1], gold[:, 1:], both)
        theta = np.zeros(2 * f + 6)
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        flat = x.reshape(-1, f)
        for step in range(1, steps + 1):
            w, pair, first = theta[: 2 * f].reshape(f, 2), theta[2 * f : 2 * f + 4].reshape(2, 2), theta[-2:]
            u = (flat @ w.astype(np.float32)).reshape(n, width, 2).astype(float)
            fwd, bwd = np.zeros((n, width, 2)), np.zeros((n, width, 2))
            fwd[:, 0] = u[:, 0] + first
            for t in range(1, width):
                fwd[:, t] = np.logaddexp(fwd[:, t - 1, :1] + pair[0], fwd[:, t - 1, 1:] + pair[1]) + u[:, t]
            for t in range(width - 2, -1, -1):
                nxt = u[:, t + 1] + bwd[:, t + 1]
                step_ = np.logaddexp(pair[:, 0] + nxt[:, :1], pair[:, 1] + nxt[:, 1:])
                bwd[:, t] = np.where((t < last)[:, None], step_, 0)
            z = np.logaddexp(fwd[np.arange(n), last, 0], fwd[np.arange(n), last, 1])
            marg = np.exp(np.minimum(fwd + bwd - z[:, None, None], 0)) * mask[..., None]
            pairs = np.exp(np.minimum(fwd[:, :-1, :, None] + pair + (u + bwd)[:, 1:, None, :] - z[:, None, None, None], 0))
            d = gold - marg
            g = np.concatenate([
                (flat.T @ d.reshape(-1, 2).astype(np.float32)).ravel() / total,
                (gold_pair - np.einsum("ntab,nt->ab", pairs, both)).ravel() / total,
                d[:, 0].sum(0) / total,
            ]) - ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta + 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(names, theta[: 2 * f].reshape(f, 2), theta[2 * f : 2 * f + 4].reshape(2, 2), theta[-2:])

    def decode(self, page: list[set[str]]) -> list[int]:
        """The likeliest labels by Viterbi; of equally likely ones label 0."""
        if not page:
            return []
        gain = (self.unary[:, 1] - self.unary[:, 0]).tolist()
        (p00, p01), (p10, p11) = self.pair.tolist()
        a, b = self.first.tolist()
        names, back = self.names, []
        for t, feats in enumerate(page):
            u = sum([gain[names[k]] for k in feats if k in names])
            if t:
                from0, from1 = b_from = (a + p01 >= b + p11, a + p00 >= b + p10)
                back.append((0 if from1 else 1, 0 if from0 else 1))
                a, b = (a + p00 if from1 else b + p10), (a + p01 if b_from[0] else b + p11)
            b += u
        at = 1 if b > a else 0
        out = [at]
        for step in reversed(back):
            at = step[at]
            out.append(at)
        return out[::-1]
