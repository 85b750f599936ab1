"""Edges of the library's operators on small hand-made frames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import arrays, flux, times
from tidemark.operators import align, evaluate, grids, quality, series, splits
from tidemark.operators.transformer import Weights, forward, patched, predicted


def t(text):
    return dt.datetime.fromisoformat(text)


def test_times(spark):
    df = spark.createDataFrame([("2024-01-01T00_01_02_aia",), ("plain_name.npy",), (None,)], "s string")
    assert [r[0] for r in df.select(times.normal_stem(F.col("s"))).collect()] == ["2024-01-01T00:01:02:aia", "plain_name.npy", None]
    df = spark.createDataFrame([("MISSING",), ("2024-01-01T00:00:60Z",), ("junk",), ("2024-01-01T00:00:01.60Z",)], "s string")
    assert [r[0] for r in df.select(times.observed(F.col("s"))).collect()] == [None, t("2024-01-01T00:00:59"), None, t("2024-01-01T00:00:01.600000")]
    assert df.select(times.observed(F.col("s"), True)).collect()[3][0] == t("2024-01-01T00:00:01.590000")
    assert df.select(times.stem_time(F.lit("2024-01-01T00:00:01.npy"))).first()[0] == t("2024-01-01T00:00:01")


def test_quality_limits_are_closed(spark):
    rows = [(1, 60.0, [1.0, 2.0], "0"), (2, -60.0, [1.0, 2.0], "0"), (3, 59.9, [1.0, 2.0], "junk"), (4, None, [0.0, 0.0], None), (5, 0.0, [float("nan")], "4"), (6, 0.0, None, "0"), (7, 0.0, [], "0.0")]
    got = {r.i: r for r in quality.bad_frames(spark.createDataFrame(rows, "i int, off double, px array<double>, q string"), "off", "px", "q").collect()}
    assert [got[i].bad_timing for i in range(1, 8)] == [True, True, False, False, False, False, False]
    assert [got[i].bad_blank for i in range(1, 8)] == [False, False, False, True, True, True, True]
    assert [got[i].bad_quality for i in range(1, 8)] == [False, False, False, False, True, False, False]


def test_first_channel_decides_unless_any(spark):
    df = spark.createDataFrame([(1, "a", False), (1, "b", True), (2, "a", True), (2, "b", False)], "ts int, ch string, bad boolean")
    flags = lambda first: {(r.ts, r.ch): r.quarantined for r in quality.quarantined(df, "ts", "ch", first).collect()}
    assert flags("a") == {(1, "a"): False, (1, "b"): False, (2, "a"): True, (2, "b"): True}
    assert all(flags(None).values())


def test_diode_column_is_optional(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (None, 0)], "flag int, quad_diode int")
    assert quality.flagged_good(df, "flag").count() == 1 and quality.flagged_good(df.drop("quad_diode"), "flag").count() == 2


def test_flux_edges(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (float("nan"),), (None,), (1e-6,), (1e-5,), (1e-4,), (float("inf"),)], "x double")
    got = df.select(flux.log_flux(F.col("x")).alias("l"), flux.valid(F.col("x")).alias("v"), flux.class_of(F.col("x")).alias("c"), flux.class_of(F.col("x"), True).alias("b")).collect()
    assert [r.l for r in got[:4]] == [None] * 4 and [r.v for r in got] == [True, False, False, False, True, True, True, False]
    assert [r.c for r in got[4:7]] == ["C", "M", "X"] and got[1].c == "Quiet" and got[1].b is None and got[0].b == "Quiet"


def test_inverse_of_normalised(spark):
    df = spark.range(1, 200).select((F.col("id") * 1e-7).alias("x"))
    z = flux.normalised(F.col("x"), F.lit(-5.2), F.lit(0.4))
    assert df.select(F.max(F.abs(flux.denormalised(z, F.lit(-5.2), F.lit(0.4)) / F.col("x") - 1))).first()[0] < 1e-9


def test_nearest_prefers_good_then_near_within_closed_bounds(spark):
    targets = spark.createDataFrame([(t("2024-01-01T00:10:00"),)], "ts timestamp_ntz")
    channels = spark.createDataFrame([(1,), (2,), (3,)], "ch int")
    frames = spark.createDataFrame([(10, t("2024-01-01T00:10:05"), 1, True), (11, t("2024-01-01T00:11:00"), 1, None), (12, t("2024-01-01T00:08:00"), 2, True), (13, t("2024-01-01T00:12:01"), 3, False)], "id int, ts timestamp_ntz, ch int, bad boolean")
    found = align.nearest(targets, frames, channels, "ts", "ch", 120, "bad", "id")
    assert {r.ch: r.id for r in found.collect()} == {1: 11, 2: 12}
    assert [r.ch for r in align.missing_channels(targets, channels, found, "ts", "ch").collect()] == [3]


def test_grid_leaves_its_end_out(spark):
    assert [r.ts.minute for r in align.grid(spark, "2024-01-01 00:00:00", "2024-01-01 00:50:00", 1500).collect()] == [0, 25]
    assert align.grid(spark, "2024-01-01 00:00:00", "2024-01-01 00:00:00", 60).count() == 0


def test_sources_are_averaged_within_themselves_first(spark):
    targets = spark.createDataFrame([(1,), (2,)], "k int")
    readings = spark.createDataFrame([(1, 13, 1.0), (1, 13, 3.0), (1, 15, 5.0), (2, 13, None), (3, 13, 1.0)], "k int, sat int, x double")
    assert [tuple(r) for r in align.mean_of_sources(targets, readings, "k", "sat", "x").collect()] == [(1, 3.5, "15,13")]


def test_interpolation_fills_ends_and_all_null_series(spark):
    rows = [("a", 0, None), ("a", 10, 1.0), ("a", 20, None), ("a", 40, 4.0), ("a", 50, None), ("b", 0, None)]
    df = spark.createDataFrame([(s, t("2024-01-01T00:00:00") + dt.timedelta(seconds=x), v) for s, x, v in rows], "s string, ts timestamp_ntz, v double")
    assert [r.filled for r in series.interpolated(df, "s", "ts", "v").orderBy("s", "ts").collect()] == [1.0, 1.0, 2.0, 4.0, 4.0, None]


def test_thinning_equals_a_greedy_pass(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, t("2024-01-01T00:00:00") + dt.timedelta(minutes=int(m))) for g in range(5) for i, m in enumerate(rng.integers(0, 40, 30))]
    df = spark.createDataFrame(rows, "g int, i int, ts timestamp_ntz")
    want = set()
    for g in range(5):
        last = None
        for _, i, x in sorted(r for r in rows if r[0] == g):
            if last is None or (x - last).total_seconds() >= 60:
                want.add((g, i))
                last = x
    assert {(r.g, r.i) for r in series.thinned(df, "i", "ts", "g").collect()} == want
    kept = sorted(r.ts for r in series.thinned_anywhere(df.where("g = 0"), "ts", 300, ["g"]).collect())
    assert all((b - a).total_seconds() >= 300 for a, b in zip(kept, kept[1:])) and len(kept) > 3


def test_adaptive_weights_read_before_they_write(spark):
    df = spark.createDataFrame([("c", i, e) for i, e in enumerate([1.0, 1.0, 2.0, 4.0])], "c string, b int, e double")
    got = [r.multiplier for r in series.adaptive_multiplier(df, "c", "b", "e", 100, 1, 2, F.lit(1.0), F.lit(0.1), F.lit(1.5)).orderBy("b").collect()]
    assert got[:2] == [1.0, 1.0] and got[2] == 1.0 and got[3] == pytest.approx(min(1.5, math.exp(2 / (4 / 3) - 1)))


def test_next_valid_goes_round(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, None)], "g string, o int, v int")
    assert [r.used for r in series.next_valid(df, "g", "o", "v").orderBy("o").collect()] == [5, 5, 5]


def test_series_in_parts_are_as_whole_ones(spark):
    """What crosses the bounds of parts: series with gaps over whole parts, null keys and null times."""
    rng = np.random.default_rng(8)
    at = sorted(rng.choice(400, 120, replace=False).tolist())
    rows = [(s, t("2024-01-01T00:00:00") + dt.timedelta(minutes=15 * m), i, None if rng.random() < 0.7 or 100 < m < 250 else float(m)) for s in ("a", "b", None) for i, m in enumerate(at)]
    df = spark.createDataFrame([*rows, ("a", None, -1, 5.0), ("c", rows[0][1], 0, None)], "s string, ts timestamp_ntz, i int, v double")
    day, ten = F.date_trunc("day", "ts"), F.floor(F.col("i") / 10)
    both = lambda f, part: [sorted(map(str, f(df, p).collect())) for p in (None, part)]
    for f, part in (
        (lambda d, p: series.interpolated(d.where("ts IS NOT NULL"), "s", "ts", "v", p), day),
        (lambda d, p: series.next_valid(d, "s", "i", "v", p), ten),
        (lambda d, p: series.thinned(d.withColumn("ts", F.expr("timestampadd(MINUTE, (i * 7) % 30, ts)")), "i", "ts", "s", p), ten),
        (lambda d, p: splits.batched(d, "s", "i", 7, p), ten),
    ):
        whole, parts = both(f, part)
        assert whole == parts and len(whole) > 10
    numbers = splits.numbered(df.withColumn("o", F.struct("i", "s")), None, "o", ten).orderBy("o").collect()
    assert [r.number for r in numbers] == list(range(df.count()))
    with pytest.raises(ValueError):
        splits.batched(df, None, "i", 7)


def test_splits(spark):
    ranges = {"train": ("2024-01-01", "2024-01-31"), "test": ("2024-01-31", "2024-02-10")}
    df = spark.createDataFrame([(t("2024-01-31T23:59:59.999999"),), (t("2024-02-01T00:00:00"),), (t("2024-03-01T00:00:00"),)], "ts timestamp_ntz")
    assert [r[0] for r in df.select(splits.split_of(F.col("ts"), ranges)).collect()] == ["train", "test", None]
    assert splits.sample(spark.range(10), "id", "s", fraction=0.01).count() == 1 and splits.sample(spark.range(10), "id", "s").count() == 10
    assert splits.chunk_size(1000, 8, 4, 50) == 50 and splits.chunk_size(100_000, 8, 4, 50) == 3125


def test_metrics_of_constant_truth_have_no_r2(spark):
    df = spark.createDataFrame([(1e-6, 1e-6), (1e-6, 1e-5), (0.0, 1e-5)], "t double, p double")
    got = {r.model: r for r in evaluate.metrics(df, "t", "p").collect()}
    assert got.keys() == {"Overall", "C"} and got["C"].n == 2 and got["Overall"].n is None
    assert got["C"].mse == 0.5 and got["C"].r2 is None and got["C"].pearson is None
    assert {r["class"]: r.weight for r in evaluate.class_weights(df, "t").collect()} == {"Quiet": 3.0, "C": 1.5, "M": 3.0, "X": 3.0}


def test_masks(spark):
    local = {(r.query, r.key) for r in grids.neighbours(spark, 5, 3).collect()}
    assert local == {(q, k) for q in range(25) for k in range(25) if abs(q // 5 - k // 5) <= 1 and abs(q % 5 - k % 5) <= 1}
    with pytest.raises(ValueError):
        grids.mask_rows(spark, 5, 3, "other")


def test_arrays(spark):
    df = spark.createDataFrame([(list(range(32)), [1.0, 2.0])], "x array<int>, two array<double>")
    x = np.arange(32).reshape(2, 4, 4)
    got = df.select(arrays.patches(F.col("x"), 2, 4, 2)).first()[0]
    assert np.array(got).tolist() == patched(x.reshape(1, -1), 2, 4, 2)[0].tolist()
    assert df.select(arrays.channel_last(F.col("x"), 2, 16)).first()[0] == x.reshape(2, 16).T.ravel().tolist()
    with pytest.raises(Exception, match="assert_true|ASSERT|is not true"):
        df.select(arrays.only_value(F.col("two"))).collect()


def loops(x, w):
    """The same model in plain loops."""
    a, p = w.arrays, w.side // w.patch
    img = x.reshape(w.channels, w.side, w.side)
    h = []
    for i in range(p * p):
        r, c = i // p * w.patch, i % p * w.patch
        h.append(img[:, r : r + w.patch, c : c + w.patch].ravel() @ a["embed.w"] + a["embed.b"] + a["position"][i])
    norm = lambda v, g, b: (v - v.mean()) / math.sqrt(v.var() + 1e-5) * g + b
    dim = len(h[0])
    d, att = dim // w.heads, None
    for layer in range(w.layers):
        g = lambda k: a[f"{layer}.{k}"]  # noqa: B023, E731
        y = [norm(v, g("g1"), g("b1")) @ g("qkv") + g("qkv.b") for v in h]
        out, att = [np.zeros(dim) for _ in h], np.zeros(len(h))
        for head in range(w.heads):
            s = slice(head * d, head * d + d)
            for i in range(len(h)):
                e = np.array([math.exp(y[i][:dim][s] @ y[j][dim : 2 * dim][s] / math.sqrt(d)) if w.hidden is None or not w.hidden[i, j] else 0.0 for j in range(len(h))])
                e /= e.sum()
                att += e / (w.heads * len(h))
                out[i][s] = sum(e[j] * y[j][2 * dim :][s] for j in range(len(h)))
        h = [h[i] + out[i] @ g("proj") + g("proj.b") for i in range(len(h))]
        for i, v in enumerate(h):
            u = norm(v, g("g2"), g("b2")) @ g("up") + g("up.b")
            h[i] = v + np.array([z * 0.5 * (1 + math.erf(z / math.sqrt(2))) for z in u]) @ g("down") + g("down.b")
    flux_ = [min(max(10 ** (float((norm(v, a["out.g"], a["out.b"]) @ a["head.w"] + a["head.b"])[0]) * w.std + w.mean) - 1e-8, 1e-15), 1) for v in h]
    return max(sum(flux_), 1e-15), flux_, att


@pytest.mark.parametrize("hide", [False, True])
def test_transformer_against_loops(spark, hide):
    hidden = np.array([[abs(i // 2 - j // 2) <= 0 and i != j for j in range(4)] for i in range(4)]) if hide else None
    w = Weights.seeded(2, 4, 2, 8, 12, 2, 2, -5.0, 0.5, hidden=hidden)
    x = np.random.default_rng(1).standard_normal((5, 32))
    total, fl, att = forward(x, w)
    for i in range(5):
        want = loops(x[i], w)
        assert np.allclose(total[i], want[0]) and np.allclose(fl[i], want[1]) and np.allclose(att[i], want[2])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9, None)], "id long, px array<double>")
    got = {r.id: r.total for r in predicted(df, "id", "px", w, batch=2).collect()}
    assert got.keys() == set(range(5)) and np.allclose([got[i] for i in range(5)], total)
