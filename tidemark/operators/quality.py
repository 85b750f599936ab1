"""Quality gates of frames, and what follows for the channels of a time stamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import blank


def bad_number(quality: Column) -> Column:
    """Whether a quality text is a number other than zero; what isn't a number is not bad."""
    return F.coalesce(quality.try_cast("double") != 0, F.lit(False))


def bad_frames(frames: DataFrame, seconds: str, pixels: str | None, quality: str, limit: float = 60.0) -> DataFrame:
    """frames with bad_timing (off by `limit` seconds or more), bad_blank, bad_quality and bad."""
    timing = F.coalesce((F.col(seconds) <= -limit) | (F.col(seconds) >= limit), F.lit(False))
    marked = frames.withColumns({"bad_timing": timing, "bad_blank": blank(F.col(pixels)) if pixels else F.lit(False), "bad_quality": bad_number(F.col(quality))})
    return marked.withColumn("bad", F.col("bad_timing") | F.col("bad_blank") | F.col("bad_quality"))


def flagged_good(rows: DataFrame, flag: str, diode: str = "quad_diode") -> DataFrame:
    """Rows whose flag is 0, and whose diode column is 0 if there is such a column. Null flags go."""
    kept = rows.where(F.col(flag) == 0)
    return kept.where(F.col(diode) == 0) if diode in rows.columns else kept


def quarantined(frames: DataFrame, key: str, channel: str, first=None) -> DataFrame:
    """frames with `quarantined`: their time stamp is bad in the channel that decides (any, if none is named)."""
    decides = frames.where(F.col("bad") & (F.lit(True) if first is None else F.col(channel) == first))
    return frames.join(decides.select(key).distinct().withColumn("quarantined", F.lit(True)), key, "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(False)))
