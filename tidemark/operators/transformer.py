"""A small vision transformer over image rows: forward, backward, and inference with weights sent to the tasks.

Spark deals the rows; a task runs batches of bounded bytes through numpy, a few lines for each block of the model.
Attention goes by blocks, so an image of 4,096 patches needs no matrix of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions.flux import MARGIN
from tidemark.operators.attention import BLOCK, Mask, attend, backward, received

SCHEMA = "total double, flux array<double>, attention array<double>"
#: Bytes of all arrays of a layer that a task takes at once.
BATCH_BYTES = 32 << 20
LOW, HIGH = 1e-15, 1.0


@dataclass
class Weights:
    """Arrays by name, and what the shapes don't tell. hidden: which (query, key) pairs attention leaves out; mode and
    window: as in Mask."""

    arrays: dict[str, np.ndarray]
    channels: int
    side: int
    patch: int
    heads: int
    layers: int
    mean: float
    std: float
    hidden: np.ndarray | None = None
    mode: str = "none"
    window: int = 9

    @property
    def mask(self) -> Mask:
        return Mask(self.side // self.patch, self.mode, self.window, self.hidden)

    @staticmethod
    def seeded(channels: int, side: int, patch: int, dim: int, hidden_dim: int, layers: int, heads: int, mean: float, std: float, seed: int = 0, hidden: np.ndarray | None = None, mode: str = "none", window: int = 9) -> Weights:
        rng, n = np.random.default_rng(seed), (side // patch) ** 2
        shapes = {"embed.w": (channels * patch * patch, dim), "embed.b": (dim,), "position": (n, dim), "out.g": (dim,), "out.b": (dim,), "head.w": (dim, 1), "head.b": (1,)}
        for i in range(layers):
            shapes |= {f"{i}.{k}": s for k, s in {"g1": (dim,), "b1": (dim,), "qkv": (dim, 3 * dim), "qkv.b": (3 * dim,), "proj": (dim, dim), "proj.b": (dim,), "g2": (dim,), "b2": (dim,), "up": (dim, hidden_dim), "up.b": (hidden_dim,), "down": (hidden_dim, dim), "down.b": (dim,)}.items()}
        gains = {"g1", "g2", "g"}
        arrays = {k: np.ones(s) if k.split(".")[-1] in gains else 0.1 * rng.standard_normal(s) for k, s in shapes.items()}
        return Weights(arrays, channels, side, patch, heads, layers, mean, std, hidden, mode, window)

    def at_once(self) -> int:
        """Images of a batch, by what a layer holds of one: its input and output, norms and heads (13 widths a patch), the
        hidden width with what erf needs (12 of them), blocks of scores (3), and the pixels, flat and by patch."""
        n, dim = self.arrays["position"].shape
        hidden = max((self.arrays[f"{i}.up"].shape[1] for i in range(self.layers)), default=0)
        values = n * (13 * dim + 12 * hidden) + 3 * self.heads * min(n, BLOCK) ** 2 + 2 * self.channels * self.side**2
        return max(1, BATCH_BYTES // (values * 8))


def patched(x: np.ndarray, channels: int, side: int, patch: int) -> np.ndarray:
    """(n, channels * side * side) as (n, patches, channels * patch * patch), patches in row order."""
    per = side // patch
    return x.reshape(-1, channels, per, patch, per, patch).transpose(0, 2, 4, 1, 3, 5).reshape(len(x), per * per, -1)


#: erf and its slope on a grid, for cubics between the points (within 1e-12).
_STEP = 1 / 512
_GRID = np.arange(0, 6 + 2 * _STEP, _STEP)
_ERF = np.array([math.erf(x) for x in _GRID])
_SLOPE = 2 / math.sqrt(math.pi) * np.exp(-(_GRID**2)) * _STEP


def erf(x: np.ndarray) -> np.ndarray:
    at = np.fmin(np.abs(x), 6.0) / _STEP
    i = np.minimum(at, len(_GRID) - 2).astype(np.int64)
    t = at - i
    a, b, u, v = _ERF[i], _ERF[i + 1], _SLOPE[i], _SLOPE[i + 1]
    y = a + t * (u + t * (3 * (b - a) - 2 * u - v + t * (2 * (a - b) + u + v)))
    return np.where(np.isnan(x), np.nan, np.copysign(y, x))


class Norm:
    """Normalised rows, with what the way back needs."""

    def __init__(self, x: np.ndarray, gain: np.ndarray, bias: np.ndarray):
        self.gain, self.scale = gain, 1 / np.sqrt(x.var(-1, keepdims=True) + 1e-5)
        self.plain = (x - x.mean(-1, keepdims=True)) * self.scale
        self.out = self.plain * gain + bias

    def back(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of the rows, the gain and the bias."""
        g, axes = d * self.gain, tuple(range(d.ndim - 1))
        dx = (g - g.mean(-1, keepdims=True) - self.plain * (g * self.plain).mean(-1, keepdims=True)) * self.scale
        return dx, (d * self.plain).sum(axes), d.sum(axes)


class Layer:
    """One block of the model over h (images, patches, width)."""

    def __init__(self, h: np.ndarray, w: Weights, i: int):
        self.w, self.i, self.shape = w, i, h.shape
        a = lambda k: w.arrays[f"{i}.{k}"]
        self.first = Norm(h, a("g1"), a("b1"))
        n, p, dim = h.shape
        self.q, self.k, self.v = (self.first.out @ a("qkv") + a("qkv.b")).reshape(n, p, 3, w.heads, dim // w.heads).transpose(2, 0, 3, 1, 4)
        self.got, self.lse = attend(self.q, self.k, self.v, w.mask)
        self.joined = self.got.transpose(0, 2, 1, 3).reshape(n, p, dim)
        h = h + self.joined @ a("proj") + a("proj.b")
        self.second = Norm(h, a("g2"), a("b2"))
        self.up = self.second.out @ a("up") + a("up.b")
        self.half = 0.5 * (1 + erf(self.up / math.sqrt(2)))
        self.out = h + (self.up * self.half) @ a("down") + a("down.b")

    def attention(self) -> np.ndarray:
        return received(self.q, self.k, self.lse, self.w.mask)

    def back(self, d: np.ndarray, grads: dict[str, np.ndarray]) -> np.ndarray:
        """The gradient of h; those of the weights are added to grads."""
        n, p, dim = self.shape
        a = lambda k: self.w.arrays[f"{self.i}.{k}"]

        def add(k: str, value: np.ndarray) -> None:
            grads[f"{self.i}.{k}"] += value

        def linear(k: str, x: np.ndarray, d: np.ndarray) -> np.ndarray:
            add(k, x.reshape(-1, x.shape[-1]).T @ d.reshape(-1, d.shape[-1]))
            add(f"{k}.b", d.sum((0, 1)))
            return d @ a(k).T

        du = linear("down", self.up * self.half, d) * (self.half + self.up * np.exp(-0.5 * self.up**2) / math.sqrt(2 * math.pi))
        dx, dg, db = self.second.back(linear("up", self.second.out, du))
        add("g2", dg), add("b2", db)
        d = d + dx
        dgot = linear("proj", self.joined, d).reshape(n, p, self.w.heads, -1).transpose(0, 2, 1, 3)
        each = backward(self.q, self.k, self.v, self.got, self.lse, dgot, self.w.mask)
        dqkv = np.stack(each).transpose(1, 3, 0, 2, 4).reshape(n, p, 3 * dim)
        dx, dg, db = self.first.back(linear("qkv", self.first.out, dqkv))
        add("g1", dg), add("b1", db)
        return d + dx


def _embedded(x: np.ndarray, w: Weights) -> np.ndarray:
    return patched(x, w.channels, w.side, w.patch) @ w.arrays["embed.w"] + w.arrays["embed.b"] + w.arrays["position"]


def _flux(h: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray, Norm]:
    """(total, flux of each patch, the power of ten in it, the last norm)."""
    norm = Norm(h, w.arrays["out.g"], w.arrays["out.b"])
    power = 10 ** ((norm.out @ w.arrays["head.w"] + w.arrays["head.b"])[..., 0] * w.std + w.mean)
    flux = np.clip(power - MARGIN, LOW, HIGH)
    return np.maximum(flux.sum(axis=1), LOW), flux, power, norm


def forward(x: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(total flux, flux of each patch, weight that each patch receives in the last layer) of flat images."""
    h = _embedded(x, w)
    attention = np.zeros(h.shape[:2])
    for i in range(w.layers):
        layer = Layer(h, w, i)
        h = layer.out
        attention = layer.attention() if i == w.layers - 1 else attention
    total, flux, _, _ = _flux(h, w)
    return total, flux, attention


def loss_and_gradients(x: np.ndarray, target: np.ndarray, share: np.ndarray, w: Weights, delta: float = 0.3) -> tuple[float, dict[str, np.ndarray]]:
    """Sums over images of share times the Huber loss of the normalised total flux, and of its gradients.

    Only the layers' inputs are kept on the way there; a layer is made again on the way back. An output that isn't finite
    is an error.
    """
    a, inputs = w.arrays, [_embedded(x, w)]
    for i in range(w.layers):
        inputs.append(Layer(inputs[-1], w, i).out)
    total, flux, power, norm = _flux(inputs.pop(), w)
    if not np.isfinite(total).all():
        raise ValueError("the model's output is not finite")
    error = (np.log10(total + MARGIN) - w.mean) / w.std - target
    loss = np.where(np.abs(error) <= delta, 0.5 * error**2, delta * (np.abs(error) - 0.5 * delta))
    dtotal = share * np.clip(error, -delta, delta) / ((total + MARGIN) * math.log(10) * w.std)
    inside = (power - MARGIN >= LOW) & (power - MARGIN <= HIGH)
    dlogit = (np.where(flux.sum(axis=1) >= LOW, dtotal, 0)[:, None] * inside * power * math.log(10) * w.std)[..., None]
    grads = {k: np.zeros_like(v) for k, v in a.items()}
    grads["head.w"] += norm.out.reshape(-1, norm.out.shape[-1]).T @ dlogit.reshape(-1, 1)
    grads["head.b"] += dlogit.sum((0, 1))
    d, dg, db = norm.back(dlogit @ a["head.w"].T)
    grads["out.g"] += dg
    grads["out.b"] += db
    for i in reversed(range(w.layers)):
        d = Layer(inputs[i], w, i).back(d, grads)
    patches = patched(x, w.channels, w.side, w.patch)
    grads["embed.w"] += patches.reshape(-1, patches.shape[-1]).T @ d.reshape(-1, d.shape[-1])
    grads["embed.b"] += d.sum((0, 1))
    grads["position"] += d.sum(0)
    return float((share * loss).sum()), grads


def predicted(rows: DataFrame, key: str, pixels: str, weights: Weights, batch: int | None = None) -> DataFrame:
    """(key, total, flux, attention) of each image; rows with a null image are left out. Without `batch` a task takes as
    many images at once as BATCH_BYTES allow."""
    sent = rows.sparkSession.sparkContext.broadcast(weights)  # a model of fixed size
    source = rows.where(rows[pixels].isNotNull()).select(key, pixels)
    batch = batch or weights.at_once()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                total, flux, attention = forward(np.stack(part[pixels].to_numpy()).astype(np.float64), sent.value)
                yield pd.DataFrame({key: part[key].to_numpy(), "total": total, "flux": list(flux), "attention": list(attention)})

    return source.mapInPandas(run, f"{key} {source.schema[key].dataType.simpleString()}, {SCHEMA}")
