"""Bounded samples that do not depend on how rows are dealt, and need no task that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP, BINS = 1 << 63, 1 << 14


def key_hash(*keys: str) -> Column:
    """A hash of the keys from 0 up to TOP."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 1)


def below(rows: int, n: int, slack: float = 1.5) -> int:
    """A hash below which some more than `rows` of about n different keys lie."""
    return TOP - 1 if n <= rows else min(TOP - 1, int(TOP * (rows / n) * slack) + 1)


def one_each(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each key, that whose other columns have the least hash. Rows that share a key meet in the tasks that read them, so a key that many rows have is a row a task."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in others]), F.xxhash64(*[F.col(f"`{c}`") for c in others])).alias("__least")
    made = df.groupBy(*keys).agg(least)
    return made.select(*[F.col(f"__least.`{c}`") if c in others else F.col(f"`{c}`") for c in df.columns])


def hash_sample(df: DataFrame, rows: int, *keys: str, limit: int | None = None) -> DataFrame:
    """At most `rows` rows of different keys, those of least hash of the keys; where there are more keys than that, exactly `rows`.

    Rows that share a key count once (one_each). A first cut where somewhat more keys lie
    below is followed by counts in BINS ranges of hashes, and by the hashes of one range,
    which give the last cut. limit: the first cut, where the caller has made it already.
    """
    if limit is None:
        total, n = df.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*keys))).first()
        if total <= rows:
            return one_each(df, *keys)
        limit = below(rows, int(n * 1.2))
        if limit < TOP - 1:
            df = df.where(key_hash(*keys) <= limit)
    each = one_each(df, *keys)
    if rows <= 0:
        return each.limit(0)
    width = limit // BINS + 1
    bin_of = F.floor(key_hash(*keys) / F.lit(width)).cast("long")
    only = df.select(*keys).distinct()
    left = rows
    for r in sorted(only.groupBy(bin_of.alias("bin")).count().collect(), key=lambda r: r.bin):  # at most BINS rows
        if r["count"] > left:
            hashes = [x.h for x in only.where(bin_of == r.bin).select(key_hash(*keys).alias("h")).orderBy("h").limit(left + 1).collect()]
            return each.where(key_hash(*keys) < hashes[-1])
        left -= r["count"]
    return each
