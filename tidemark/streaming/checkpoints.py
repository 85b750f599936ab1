"""Where streams keep their progress."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset a single machine gets a local one; a cluster, whose
    executors would not see it, an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
