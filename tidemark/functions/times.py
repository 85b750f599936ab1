"""Time stamps in names and headers. All times are without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_stem(stem: Column) -> Column:
    """A name with `_` for `:` after its first T, made a time stamp again; names without T stay as they are."""
    head = F.substring_index(stem, "T", 1)
    return F.when(stem.contains("T"), F.concat(head, F.replace(F.substr(stem, F.length(head) + 1), F.lit("_"), F.lit(":")))).otherwise(stem)


def stem_time(name: Column) -> Column:
    """The time that a file name holds before its first dot, to the second; null if it holds none."""
    return F.date_trunc("second", F.substring_index(name, ".", 1).try_cast("timestamp_ntz")).cast("timestamp_ntz")


def short_stem(name: Column) -> Column:
    """A name without its extension and without what follows its last `_`."""
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "_[^_]*$", "")


def observed(text: Column, every_sixty: bool = False) -> Column:
    """A header's observation time; `MISSING` and whatever can't be read are null. Second 60 counts as 59; with
    every_sixty, so does each other 60 in the text."""
    fixed = F.replace(text, F.lit("60"), F.lit("59")) if every_sixty else F.regexp_replace(text, ":60", ":59")
    return F.when(text != "MISSING", F.regexp_replace(fixed, "Z$", "").try_cast("timestamp_ntz"))


def seconds_between(a: Column, b: Column) -> Column:
    """a - b in seconds with fractions."""
    return F.timestamp_diff("MICROSECOND", b, a) / F.lit(1e6)
