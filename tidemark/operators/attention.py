"""Attention over a grid of patches by blocks, forward and backward.

Scores exist for a block of queries and a block of keys at a time: the softmax is carried over the key blocks by its
running maximum and sum, so memory is patches x block. `local` attention visits the grid rows near a query only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

MODES = ("none", "local", "inverted")
BLOCK = 128


@dataclass(frozen=True)
class Mask:
    """Which keys a query doesn't see: with `local` those over window // 2 rows or columns away, with `inverted` the
    others, with `none` none. `pairs`, a matrix for small grids, comes on top. A query that sees no key gives not-a-number."""

    side: int
    mode: str = "none"
    window: int = 9
    pairs: np.ndarray | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")

    def blocks(self) -> Iterator[tuple[slice, list[slice]]]:
        """Blocks of queries, each with the blocks of keys that it may see."""
        n, r = self.side**2, self.window // 2
        band = max(1, BLOCK // self.side) * self.side if self.mode == "local" else BLOCK
        for a in range(0, n, band):
            b = min(a + band, n)
            low, high = (max(0, a // self.side - r) * self.side, min(self.side, (b - 1) // self.side + r + 1) * self.side) if self.mode == "local" else (0, n)
            yield slice(a, b), [slice(k, min(k + BLOCK, high)) for k in range(low, high, BLOCK)]

    def hidden(self, q: slice, k: slice) -> np.ndarray | None:
        out = None
        if self.mode != "none":
            i, j, r = np.arange(q.start, q.stop)[:, None], np.arange(k.start, k.stop)[None, :], self.window // 2
            near = (abs(i // self.side - j // self.side) <= r) & (abs(i % self.side - j % self.side) <= r)
            out = near if self.mode == "inverted" else ~near
        if self.pairs is not None:
            out = self.pairs[q, k] if out is None else out | self.pairs[q, k]
        return out


def _scores(q: np.ndarray, k: np.ndarray, mask: Mask, rows: slice, cols: slice) -> np.ndarray:
    s = q[:, :, rows] @ k[:, :, cols].swapaxes(2, 3) / np.sqrt(q.shape[-1])
    hidden = mask.hidden(rows, cols)
    return s if hidden is None else np.where(hidden, -np.inf, s)


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, mask: Mask) -> tuple[np.ndarray, np.ndarray]:
    """What each query gets, and the logarithm of its softmax's sum. Arrays are (images, heads, patches, width)."""
    out, lse = np.empty_like(v), np.empty(q.shape[:3])
    for rows, keys in mask.blocks():
        top, total, got = np.full(q[:, :, rows].shape[:3], -np.inf), 0.0, 0.0
        for cols in keys:
            s = _scores(q, k, mask, rows, cols)
            now = np.maximum(top, s.max(-1))
            base = np.where(now == -np.inf, 0, now)
            scale, e = np.exp(top - base), np.exp(s - base[..., None])
            total, got, top = total * scale + e.sum(-1), got * scale[..., None] + e @ v[:, :, cols], now
        with np.errstate(divide="ignore", invalid="ignore"):
            out[:, :, rows], lse[:, :, rows] = got / total[..., None], top + np.log(total)
    return out, lse


def received(q: np.ndarray, k: np.ndarray, lse: np.ndarray, mask: Mask) -> np.ndarray:
    """(images, patches): the mean over heads and queries of the weight that each key receives."""
    out = np.zeros((len(q), q.shape[2]))
    for rows, keys in mask.blocks():
        for cols in keys:
            out[:, cols] += np.exp(_scores(q, k, mask, rows, cols) - lse[:, :, rows, None]).sum(axis=(1, 2))
    return out / (q.shape[1] * q.shape[2])


def backward(q: np.ndarray, k: np.ndarray, v: np.ndarray, out: np.ndarray, lse: np.ndarray, dout: np.ndarray, mask: Mask) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of queries, keys and values. The weights are made again, block by block."""
    dq, dk, dv, share = np.zeros_like(q), np.zeros_like(k), np.zeros_like(v), (dout * out).sum(-1)
    for rows, keys in mask.blocks():
        d = dout[:, :, rows]
        for cols in keys:
            p = np.exp(_scores(q, k, mask, rows, cols) - lse[:, :, rows, None])
            dv[:, :, cols] += p.swapaxes(2, 3) @ d
            ds = p * (d @ v[:, :, cols].swapaxes(2, 3) - share[:, :, rows, None]) / np.sqrt(q.shape[-1])
            dq[:, :, rows] += ds @ k[:, :, cols]
            dk[:, :, cols] += ds.swapaxes(2, 3) @ q[:, :, rows]
    return dq, dk, dv
