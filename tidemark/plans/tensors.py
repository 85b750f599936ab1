"""Queries on arrays: embeddings taken as small images, patch grids, attention and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import arrays as ar
from tidemark.operators import grids
from tidemark.plans.adapters import table
from tidemark.plans.registry import query


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 values: 4 channels of 4 x 4, or one of 8 x 8."""
    return table(spark, sf_dir, "embeddings")


@query("SELECT vec_id, (label % 3 = 0) AS is_blank FROM embeddings")
def p_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("label") % 6 == 0, F.transform("embedding", lambda v: v * 0)).when(F.col("label") % 3 == 0, F.transform("embedding", lambda v: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return _images(spark, sf_dir).select("vec_id", ar.blank(x).alias("is_blank"))


@query("WITH i AS (SELECT vec_id, embedding, unnest(range(0, 32)) AS j FROM embeddings) SELECT vec_id, j AS pos, embedding[CASE WHEN j < 16 THEN 48 + j + 1 ELSE j - 16 + 1 END] AS value FROM i")
def p_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ar.channels(F.col("embedding"), 16, [94, 131, 171, 193], [193, 999, 94])
    return _images(spark, sf_dir).select("vec_id", F.posexplode(chosen).alias("pos", "value"))


@query("WITH i AS (SELECT vec_id, embedding, unnest(range(0, 64)) AS j FROM embeddings) SELECT vec_id, j AS pos, embedding[(j % 4) * 16 + j // 4 + 1] AS value FROM i")
def p_channel_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("vec_id", F.posexplode(ar.channel_last(F.col("embedding"), 4, 16)).alias("pos", "value"))


@query("""WITH i AS (SELECT vec_id, embedding, unnest(range(0, 64)) AS n FROM embeddings), x AS (SELECT *, n // 16 AS p, n % 16 AS f FROM i)
SELECT vec_id, p AS patch, f AS feature, embedding[(f // 4) * 16 + ((p // 2) * 2 + (f // 2) % 2) * 4 + (p % 2) * 2 + f % 2 + 1] AS value FROM x""")
def t_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4 channels of 4 x 4 in patches of 2 x 2."""
    each = _images(spark, sf_dir).select("vec_id", F.posexplode(ar.patches(F.col("embedding"), 4, 4, 2)).alias("patch", "values"))
    return each.select("vec_id", "patch", F.posexplode("values").alias("feature", "value"))


@query("SELECT vec_id, embedding[1] AS first_value, embedding[64] AS last_value, CAST(64 AS INTEGER) AS n FROM embeddings")
def t_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested to (4, 4, 4) and flat again."""
    nested = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("embedding", c * 16 + r * 4 + 1, 4)))
    flat = ar.flattened(nested)
    return _images(spark, sf_dir).select("vec_id", F.element_at(flat, 1).alias("first_value"), F.element_at(flat, -1).alias("last_value"), F.size(flat).alias("n"))


@query("SELECT vec_id, embedding[1] AS value FROM embeddings")
def p_only_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("vec_id", ar.only_value(F.slice("embedding", 1, 1)).alias("value"))


@query("WITH i AS (SELECT vec_id, embedding, unnest(range(1, 65)) AS j FROM embeddings) SELECT vec_id, round(sum(greatest(least(pow(10, CAST(embedding[j] AS DOUBLE) * 0.5 - 5) - 1e-8, 1), 1e-15)) * 1e4, 6) AS total FROM i GROUP BY vec_id")
def a_patch_flux(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("vec_id", F.round(ar.total_flux(F.col("embedding"), -5.0, 0.5) * 1e4, 6).alias("total"))


@query("WITH i AS (SELECT vec_id, embedding, unnest(range(0, 64)) AS j FROM embeddings) SELECT vec_id, j // 8 AS row, j % 8 AS col, embedding[j + 1] AS value FROM i")
def t_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _images(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("at", "value"))
    return grids.placed(each, "at", 8).select("vec_id", "row", "col", "value")


@query("SELECT a.i AS query, b.i AS key FROM range(0, 64) a(i) JOIN range(0, 64) b(i) ON abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1")
def j_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.neighbours(spark, 8, 3)


@query("WITH l AS (SELECT a.i AS query, count(*) AS n FROM range(0, 64) a(i) JOIN range(0, 64) b(i) ON abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1 GROUP BY a.i) SELECT query, 'local' AS mode, 64 - n AS n_masked FROM l UNION ALL SELECT query, 'inverted', n FROM l UNION ALL SELECT query, 'none', 0 FROM l")
def t_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for mode in ("local", "inverted", "none"):
        rows = grids.mask_rows(spark, 8, 3, mode).select("query", F.lit(mode).alias("mode"), "n_masked")
        out = rows if out is None else out.union(rows)
    return out


@query("""WITH i AS (SELECT vec_id, unnest(range(0, 64)) AS key, unnest(embedding) AS v FROM embeddings),
p AS (SELECT a.i AS query, b.i AS key FROM range(0, 64) a(i) JOIN range(0, 64) b(i) ON abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1)
SELECT vec_id, query, count(*) AS n, round(sum(CAST(v AS DOUBLE)), 5) AS total FROM i JOIN p ON p.key = i.key GROUP BY vec_id, query""")
def j_neighbour_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patch joined with its neighbours: a grid's pairs are a table of fixed size."""
    each = _images(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("key", "v"))
    near = each.join(F.broadcast(grids.neighbours(spark, 8, 3)), "key")
    return near.groupBy("vec_id", "query").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("double")), 5).alias("total"))


@query("""WITH i AS (SELECT vec_id, unnest(range(0, 64)) AS query, unnest(embedding) AS v FROM embeddings),
l AS (SELECT a.i AS query, count(*) AS n FROM range(0, 64) a(i) JOIN range(0, 64) b(i) ON abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1 GROUP BY a.i),
m AS (SELECT query, 'local' AS mode, 64 - n AS n_masked FROM l UNION ALL SELECT query, 'inverted', n FROM l UNION ALL SELECT query, 'none', 0 FROM l)
SELECT vec_id, mode, CAST(sum(n_masked) FILTER (WHERE v > 0) AS BIGINT) AS hidden_from_positive FROM i JOIN m ON m.query = i.query GROUP BY vec_id, mode""")
def t_mask_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys each mask hides from the patches of an image that are above zero."""
    masks = None
    for mode in grids.MODES:
        rows = grids.mask_rows(spark, 8, 3, mode).select("query", F.lit(mode).alias("mode"), "n_masked")
        masks = rows if masks is None else masks.union(rows)
    each = _images(spark, sf_dir).select("vec_id", F.posexplode("embedding").alias("query", "v"))
    found = each.join(F.broadcast(masks), "query")  # a row for each patch of the grid and mode
    return found.groupBy("vec_id", "mode").agg(F.sum(F.when(F.col("v") > 0, F.col("n_masked"))).alias("hidden_from_positive"))


@query("WITH i AS (SELECT label, embedding, unnest(range(0, 64)) AS j FROM embeddings) SELECT label AS sample, j % 16 AS key, round(avg(CAST(embedding[j + 1] AS DOUBLE)), 6) AS weight FROM i GROUP BY 1, 2")
def a_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _images(spark, sf_dir).select("label", F.posexplode("embedding").alias("at", "w"))
    long = each.select(F.col("label").alias("sample"), (F.col("at") % 16).alias("key"), F.col("w").cast("double").alias("weight"))
    return grids.received(long).select("sample", "key", F.round("weight", 6).alias("weight"))


@query("""WITH i AS (SELECT vec_id, unnest(range(0, 64)) AS patch, unnest(embedding) AS v FROM embeddings),
p AS (SELECT a.i AS patch, b.i AS other, abs(a.i // 8 - b.i // 8) <= 1 AND abs(a.i % 8 - b.i % 8) <= 1 AS is_near FROM range(0, 64) a(i), range(0, 64) b(i))
SELECT vec_id, CAST(p.patch AS INTEGER) AS patch, count(*) FILTER (WHERE is_near) AS n_near, round(avg(CAST(v AS DOUBLE)) FILTER (WHERE is_near), 6) AS near, round(avg(CAST(v AS DOUBLE)) FILTER (WHERE NOT is_near), 6) AS far
FROM i JOIN p ON p.other = i.patch GROUP BY vec_id, p.patch""")
def a_neighbourhood_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The means over a patch's neighbours and over all others, as local and inverted attention see them."""
    found = grids.neighbourhood_means(_images(spark, sf_dir), "vec_id", "embedding", 8, 3)
    return found.select("vec_id", "patch", "n_near", F.round("near", 6).alias("near"), F.round("far", 6).alias("far"))


@query("""SELECT vec_id // 64 AS block, CAST(count(*) AS INTEGER) AS n, round(sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))), 4) AS total
FROM embeddings WHERE (vec_id // 64) % 4 = 1 GROUP BY 1""")
def s_image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 vectors a file as FITS images, published together; a scan that reads the pixels of those that pass a filter."""
    from tidemark.sources import file_sink, fits
    from tidemark.streaming.checkpoints import fresh

    path, block = f"{fresh(spark)}-fits", F.floor(F.col("vec_id") / 64)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])  # 64 at most
    rows = _images(spark, sf_dir).groupBy(block.alias("block")).agg(F.flatten(lines).alias("px"))
    rows = rows.withColumns({"name": F.concat(F.col("block").cast("string"), F.lit(".fits")), "quality": F.col("block") % 4})
    file_sink.written(fits.as_files(rows, "name", "px", 64, {"OBS_ID": "block", "QUALITY": "quality"}), path)
    found = fits.images(spark, path, "OBS_ID long, QUALITY int, shape array<int>, pixels array<float>").where("QUALITY = 1")
    total = F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return found.select(F.col("OBS_ID").alias("block"), F.col("shape")[0].alias("n"), F.round(total, 4).alias("total"))


@query("WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, max(value) AS value FROM events GROUP BY 1, 2), w AS (SELECT hour, max(CASE WHEN event_type = 'click' THEN value END) AS a, max(CASE WHEN event_type = 'view' THEN value END) AS b FROM h GROUP BY hour) SELECT hour, a, b FROM w WHERE a IS NOT NULL AND b IS NOT NULL")
def s_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that meet at an hour, one after another."""
    from tidemark.sources.readers import stacked

    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    frames = table(spark, sf_dir, "events").groupBy(hour, "event_type").agg(F.array(F.max("value")).alias("pixels"))
    return stacked(frames, "hour", "event_type", "pixels", ["click", "view"]).select("hour", F.col("stack")[0].alias("a"), F.col("stack")[1].alias("b"))


@query()
def t_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded transformer over 4 channels of 4 x 4, checked in the tests against plain loops."""
    from tidemark.operators.transformer import Weights, predicted

    weights = Weights.seeded(4, 4, 2, 16, 32, 2, 4, -5.0, 0.5)
    return predicted(_images(spark, sf_dir), "vec_id", "embedding", weights)


@query()
def t_inference_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same model's flux and attention for each patch, in long form."""
    found = t_inference(spark, sf_dir)
    return found.select("vec_id", F.posexplode(F.arrays_zip("flux", "attention")).alias("patch", "x")).select("vec_id", "patch", "x.flux", "x.attention")


@query()
def t_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, loss, n) of four steps over all images, two batches in turn: the label's place in its range as target."""
    from tidemark.operators.training import trained
    from tidemark.operators.transformer import Weights
    from tidemark.streaming.checkpoints import fresh

    weights = Weights.seeded(4, 4, 2, 16, 32, 2, 4, -5.0, 0.5)
    rows = _images(spark, sf_dir).select("embedding", (F.col("label") / 4.0).alias("target"), F.pmod("vec_id", F.lit(2)).alias("batch"))
    return trained(rows, "embedding", "target", weights, fresh(spark), 4, 0.003, F.col("batch"), 2)[1]


@query("""WITH b AS (SELECT vec_id, embedding, list_position(embedding, list_max(embedding)) - 1 AS spot FROM embeddings),
s AS (SELECT *, greatest(0, least(spot // 8 - 1, 5)) AS top, greatest(0, least(spot % 8 - 1, 5)) AS lft FROM b), i AS (SELECT *, unnest(range(0, 9)) AS pos FROM s)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, embedding[(top + pos // 3) * 8 + lft + pos % 3 + 1] AS value FROM i""")
def p_brightest_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _images(spark, sf_dir).select("vec_id", F.posexplode(ar.brightest_patch(F.col("embedding"), 8, 8, 3)).alias("pos", "value"))
