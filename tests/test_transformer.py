"""Attention by blocks, gradients and training steps against plain formulas."""

import dataclasses
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import attention, training, transformer
from tidemark.operators.attention import Mask
from tidemark.operators.transformer import BATCH_BYTES, Weights, erf, forward, loss_and_gradients
from tidemark.plans import registry

DIR = "/root/testdata/sf0.001"


def hidden(side, mode, window):
    """All pairs, for small grids."""
    i = np.arange(side * side)
    near = (abs(i[:, None] // side - i // side) <= window // 2) & (abs(i[:, None] % side - i % side) <= window // 2)
    return {"none": np.zeros_like(near), "local": ~near, "inverted": near}[mode]


@pytest.mark.parametrize("mode", attention.MODES)
@pytest.mark.parametrize("side,window", [(4, 1), (13, 3), (16, 9), (20, 40)])
def test_blocks_equal_the_whole_matrix(mode, side, window):
    rng = np.random.default_rng(1)
    q, k, v, d = rng.standard_normal((4, 2, 3, side * side, 5)) * 3
    bar = hidden(side, mode, window)
    if bar.all(axis=1).any():
        mask = Mask(side, mode, window)
        with np.errstate(invalid="ignore"):
            assert np.isnan(attention.attend(q, k, v, mask)[0][:, :, bar.all(axis=1)]).all()
        return
    s = np.where(bar, -np.inf, q @ k.swapaxes(2, 3) / math.sqrt(5))
    p = np.exp(s - s.max(-1, keepdims=True))
    p /= p.sum(-1, keepdims=True)
    mask = Mask(side, mode, window)
    out, lse = attention.attend(q, k, v, mask)
    assert np.allclose(out, p @ v) and np.allclose(attention.received(q, k, lse, mask), p.mean(axis=(1, 2)))
    ds = p * (d @ v.swapaxes(2, 3) - (d * (p @ v)).sum(-1, keepdims=True)) / math.sqrt(5)
    want = ds @ k, ds.swapaxes(2, 3) @ q, p.swapaxes(2, 3) @ d
    assert all(np.allclose(a, b) for a, b in zip(attention.backward(q, k, v, out, lse, d, mask), want))


def test_local_attention_visits_near_rows_only():
    near = sum((q.stop - q.start) * sum(k.stop - k.start for k in ks) for q, ks in Mask(64, "local", 9).blocks())
    assert near < 0.2 * 4096**2 and sum((q.stop - q.start) * sum(k.stop - k.start for k in ks) for q, ks in Mask(64).blocks()) == 4096**2
    with pytest.raises(ValueError):
        Mask(4, "near")


def test_the_reference_size_fits_in_memory():
    """4,096 patches and 8 heads: a matrix of all pairs alone would take 1 GB an image."""
    w = Weights.seeded(7, 512, 8, 64, 128, 1, 8, -5.0, 0.5, mode="inverted", window=9)
    x = np.random.default_rng(0).standard_normal((1, 7 * 512 * 512))
    tracemalloc.start()
    total, flux, got = forward(x, w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isfinite(total).all() and flux.shape == (1, 4096) and got.sum() == pytest.approx(1) and peak < 300e6
    assert w.at_once() < 12 and Weights.seeded(4, 4, 2, 16, 32, 2, 4, -5.0, 0.5).at_once() > 1_000


def test_a_batch_holds_no_more_than_its_bytes():
    """All arrays of a layer count, not the largest one only."""
    for w in (Weights.seeded(4, 4, 2, 16, 32, 2, 4, -5.0, 0.5), Weights.seeded(3, 32, 4, 32, 64, 2, 4, -5.0, 0.5)):
        x = np.random.default_rng(0).standard_normal((min(w.at_once(), 10_000), w.channels * w.side**2))
        tracemalloc.start()
        forward(x, w)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 1.5 * BATCH_BYTES


def test_erf():
    x = np.r_[np.linspace(-8, 8, 4_001), 0.0, -0.0, np.inf, -np.inf]
    assert np.abs(erf(x) - np.array([math.erf(v) for v in x])).max() < 1e-12 and np.isnan(erf(np.array([np.nan])))[0]


@pytest.mark.parametrize("mode,window", [("none", 3), ("local", 3), ("inverted", 1)])
def test_gradients_equal_finite_differences(mode, window):
    w = Weights.seeded(2, 6, 2, 8, 12, 2, 2, -5.0, 0.5, mode=mode, window=window)
    rng = np.random.default_rng(2)
    x, y, share = rng.standard_normal((4, 72)), np.array([1.9, 0.2, -3.0, 1.8]), np.array([1.0, 0.5, 2.0, 1.5])
    loss, grads = loss_and_gradients(x, y, share, w)
    for name, array in w.arrays.items():
        for at in rng.choice(array.size, min(4, array.size), replace=False):
            ends = []
            for eps in (1e-5, -1e-5):
                moved = array.copy()
                moved.flat[at] += eps
                ends.append(loss_and_gradients(x, y, share, dataclasses.replace(w, arrays=w.arrays | {name: moved}))[0])
            assert grads[name].flat[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, rel=2e-4, abs=1e-7), name
    with np.errstate(all="ignore"), pytest.raises(ValueError, match="not finite"):
        loss_and_gradients(x * np.nan, y, share, w)


def plain_steps(x, y, w, steps, lr, decay=1e-5, share=None):
    p, log = training.flat(w.arrays), []
    m, v = np.zeros_like(p), np.zeros_like(p)
    for s, rows in enumerate(steps, 1):
        loss, grads = loss_and_gradients(x[rows], y[rows], np.ones(len(rows)) if share is None else share[rows], dataclasses.replace(w, arrays=training.shaped(p, w.arrays)))
        g = training.flat(grads) / len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p * (1 - lr * decay) - lr * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.999**s)) + 1e-8)
        log.append((s, loss / len(rows), len(rows)))
    return p, log


def test_steps_equal_a_plain_loop_and_resume(spark, tmp_path, monkeypatch):
    """Three tasks, summed two at a time; chunks smaller than the model; nulls; a run that goes on after its second step."""
    monkeypatch.setattr(training, "CHUNK", 700)
    monkeypatch.setattr(training, "FAN", 2)
    w = Weights.seeded(2, 4, 2, 8, 12, 1, 2, -5.0, 0.5)
    rng = np.random.default_rng(3)
    x, y, share = rng.standard_normal((30, 32)), rng.standard_normal(30), rng.uniform(0.5, 2, 30)
    rows = [(i, x[i].tolist(), float(y[i]), float(share[i])) for i in range(30)] + [(0, None, 1.0, 1.0), (1, x[0].tolist(), None, 1.0)]
    df = spark.createDataFrame(rows, "i int, px array<double>, y double, s double").repartition(3)
    want, log = plain_steps(x, y, w, [np.arange(0, 30, 2), np.arange(1, 30, 2), np.arange(0, 30, 2)], 0.01, share=share)
    run = lambda steps: training.trained(df, "px", "y", w, f"{tmp_path}/run", steps, 0.01, F.col("i") % 2, 2, share="s")
    run(2)
    found, got = run(3)
    assert np.allclose(training.flat(found.arrays), want, atol=1e-9)
    assert [(r.step, pytest.approx(r.loss), r.n) for r in got.orderBy("step").collect()] == log
    _, same = training.trained(df.limit(0), "px", "y", w, f"{tmp_path}/run", 3, 0.01)  # whole steps are read, not computed
    assert same.count() == 3
    kept, none = training.trained(df.limit(0), "px", "y", w, f"{tmp_path}/none", 1, 0.01)
    assert np.array_equal(training.flat(kept.arrays), training.flat(w.arrays)) and none.first().n == 0 and none.first().loss is None
    clipped, _ = training.trained(df, "px", "y", w, f"{tmp_path}/clip", 1, 0.01, clip=1e-9)
    assert np.abs(training.flat(clipped.arrays) - training.flat(w.arrays)).max() < 0.01
    with pytest.raises(Exception, match="not finite"):
        training.trained(df.withColumn("px", F.transform("px", lambda v: v * float("nan"))), "px", "y", w, f"{tmp_path}/bad", 1, 0.01)


def test_training_query_falls_and_equals_a_plain_loop(spark):
    got = registry.queries()["t_training"](spark, DIR).orderBy("step").collect()
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()
    x, y = np.array([r.embedding for r in rows], np.float64), np.array([r.label / 4.0 for r in rows])
    odd = np.array([r.vec_id % 2 for r in rows])
    _, log = plain_steps(x, y, Weights.seeded(4, 4, 2, 16, 32, 2, 4, -5.0, 0.5), [np.flatnonzero(odd == s % 2) for s in range(4)], 0.003)
    assert [(r.step, pytest.approx(r.loss, rel=1e-9), r.n) for r in got] == log and sum(r.n for r in got) == 2 * len(rows)
    assert got[2].loss < got[0].loss and got[3].loss < got[1].loss


def test_inference_queries_equal_the_model_row_by_row(spark):
    """t_inference_patches gives for each patch what t_inference has in its arrays, and that is what the model gives alone."""
    whole = {r.vec_id: r for r in registry.queries()["t_inference"](spark, DIR).collect()}
    patches = registry.queries()["t_inference_patches"](spark, DIR).collect()
    w = Weights.seeded(4, 4, 2, 16, 32, 2, 4, -5.0, 0.5)
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").collect()
    assert len(rows) == len(whole) and len(patches) == 4 * len(rows)
    alone = {r.vec_id: forward(np.array([r.embedding], np.float64), w) for r in rows}
    for i, (total, flux, att) in alone.items():
        assert whole[i].total == pytest.approx(total[0]) and whole[i].flux == pytest.approx(flux[0].tolist()) and whole[i].attention == pytest.approx(att[0].tolist())
    for r in patches:
        total, flux, att = alone[r.vec_id]
        assert r.flux == pytest.approx(flux[0, r.patch]) and r.attention == pytest.approx(att[0, r.patch])
    assert transformer.predicted(spark.createDataFrame([(1, None)], "k int, px array<double>"), "k", "px", w).collect() == []
