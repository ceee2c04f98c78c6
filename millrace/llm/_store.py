"""The library's tables in the shared folder, for the operators here; and what only they need."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from millrace.sources.shared import checkpoint_root, heavy_keys, keep_columns, release, share, shuffle_parts, skew_join, stash, stashed

__all__ = ["checkpoint_root", "heavy_keys", "keep_columns", "release", "share", "shuffle_parts", "skew_join", "small_batches", "stash", "stashed"]


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Lets a batch that goes to Python hold about 8 MB of texts, not 10,000 texts of any length: a setting of the session, lowered where it is higher and left so, as plans read it when they run."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(key)
    if not re.fullmatch(r"\d+b?", held) or int(held.rstrip("b")) > most:
        spark.conf.set(key, str(most))
