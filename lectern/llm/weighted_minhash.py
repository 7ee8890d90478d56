"""Improved consistent weighted sampling of weighted sets, vectorised over elements.

Each element has, for each of `samples` hash functions, two Gamma(2, 1) draws r and c and a uniform b,
looked up by bits of its hash in tables of quantiles, so that they are the same in every task. For
an element of weight w, t = floor(ln w / r + b) and ln a = ln c - r * (t - b + 1); the sample of a set is
its (element, t) of least a. Two sets agree in a sample with the probability of their weighted Jaccard
similarity.
"""

from __future__ import annotations

import numpy as np

from lectern.llm.words import mix

TABLE_BITS = 16
LANES = 1 << 14


def _gamma2_quantiles(n: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middles of n equal parts, by Newton's method on 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    x = np.sqrt(2 * p)
    x = np.maximum(x, -np.log1p(-p))
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x


class Sampler:
    def __init__(self, samples: int, seed: int = 1):
        quantiles = _gamma2_quantiles(1 << TABLE_BITS)
        self.r = quantiles.astype(np.float32)
        self.log_c = np.log(quantiles).astype(np.float32)
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.samples = samples

    def _draws(self, element: np.ndarray, odd: np.uint64):
        u = element * odd
        u ^= u >> np.uint64(32)
        r = self.r[(u >> np.uint64(48)).astype(np.intp)]
        c = self.log_c[((u >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.intp)]
        b = ((u & np.uint64(0xFFFF)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-16)
        return r, c, b

    def _piece(self, element: np.ndarray, log_w: np.ndarray, starts: np.ndarray):
        """(least ln a, its element, its t) by set and sample, for sets that lie whole in the piece."""
        least = np.empty((len(starts), self.samples), np.float32)
        print_ = np.empty((len(starts), self.samples), np.uint64)
        index = np.arange(len(element), dtype=np.int64)
        for j in range(self.samples):
            r, c, b = self._draws(element, self.odd[j])
            t = np.floor(log_w / r + b)
            a = c - r * (t - b + np.float32(1))
            bits = a.view(np.int32)
            ordered = np.where(bits < 0, bits ^ np.int32(0x7FFFFFFF), bits).astype(np.int64)
            best = np.minimum.reduceat((ordered << 32) | index, starts)
            at = best & 0xFFFFFFFF
            least[:, j] = a[at]
            print_[:, j] = mix(element[at] ^ (t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return least, print_

    def sample(self, element: np.ndarray, weight: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Fingerprints [set, sample] of the sets element[offsets[i]:offsets[i + 1]]; sets must not be empty."""
        out = np.empty((len(offsets) - 1, self.samples), np.uint64)
        log_w = np.log(weight).astype(np.float32)
        at = 0
        while at < len(out):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + LANES, side="right")) - 1)
            lo, hi = int(offsets[at]), int(offsets[end])
            if hi - lo <= 4 * LANES:
                _, out[at:end] = self._piece(element[lo:hi], log_w[lo:hi], offsets[at:end] - lo)
            else:  # one large set: the best of its parts
                best = None
                for p in range(lo, hi, LANES):
                    least, found = self._piece(element[p : min(p + LANES, hi)], log_w[p : min(p + LANES, hi)], np.zeros(1, np.int64))
                    if best is not None:
                        found = np.where(least < best[0], found, best[1])
                        least = np.minimum(least, best[0])
                    best = least, found
                out[at] = best[1][0]
            at = end
        return out
