"""Where jobs cut lineage: tables written to the shared checkpoint folder; and joins and broadcasts whose sizes are known."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_local: dict[str, str] = {}  # by application: the folder of one in local mode that names none
_tables: dict[str, list[str]] = {}  # by application: tables that stash has written


def checkpoint_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode only, a new one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return _local[app]


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start at the files, whichever executor is lost."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/millrace/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stashed(spark: SparkSession) -> list[str]:
    """Paths of the tables that stash has written and release has not deleted."""
    return list(_tables.get(spark.sparkContext.applicationId, ()))


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete stashed tables that nothing will read again. What the operators return reads some of them, so a caller does this once its own results are written."""
    own = _tables.get(spark.sparkContext.applicationId, [])
    for path in paths:
        if path in own:
            own.remove(path)
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_parts(spark: SparkSession) -> int:
    """Partitions that a job deals rows to: the session's own setting, which its user sizes to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def heavy_keys(df: DataFrame, key: str, one_in: int = 1000) -> list:
    """Values of key that more than one in so many rows hold, so fewer than one_in values whatever the size. Counted before any row is dealt by key."""
    total = df.count()
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return [r[0] for r in counts.where((F.col("n") > max(1.0, total / one_in)) & F.col(key).isNotNull()).select(key).collect()]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", heavy: list | None = None) -> DataFrame:
    """left (read more than once, so stashed) with right, which has a row a key: inner, left or left_semi.

    Rows of heavy keys stay where they lie and meet the few rows of right that have these keys
    by broadcast; all others meet by exchange, where no key has more than a thousandth of left.
    """
    heavy = heavy_keys(left, key) if heavy is None else heavy
    if not heavy:
        return left.join(right.hint("merge"), key, how)
    hot = lambda df: F.coalesce(df[key].isin(heavy), F.lit(False))
    light = left.where(~hot(left)).join(right.where(~hot(right)).hint("merge"), key, how)
    return light.unionByName(left.where(hot(left)).join(F.broadcast(right.where(hot(right))), key, how))


def keep_columns(df: DataFrame, new: list[str], *needed: str) -> DataFrame:
    """df without the columns that an operator adds; needed ones must be there."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; found {df.columns}")
    return df.drop(*[c for c in new if c not in needed])


def share(spark: SparkSession, value):
    """A broadcast of a bounded value whose classes need no import on executors; pickle.loads of its value gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))
