"""Ordered work where one key holds most rows: the same rows as a window by key, and no task that holds the key."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import chunking, embedding, logs
from millrace.plans import catalog
from tests.compare import assert_same


@pytest.fixture
def events(spark):
    r = random.Random(11)
    t0 = dt.datetime(2024, 3, 1)
    rows = [(i, t0 + dt.timedelta(seconds=r.choice((0, 1, 600)) * r.randrange(900)), 1 if r.random() < 0.6 else r.choice((2, 3, None, 4)), "/p", r.random() * 3, r.choice((200, 500))) for i in range(4000)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, path string, seconds double, status int")


def by_window(events, ttl):
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = logs.micros() - F.lag(logs.micros()).over(order)
    x = events.withColumn("new", F.when(gap < ttl * 1_000_000, 0).otherwise(1)).withColumn("s", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return x.groupBy("user_id", "s").agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_end"), F.count(F.lit(1)).alias("n")).drop("s")


@pytest.mark.parametrize("ttl", [1, 60, 700, 86400])
@pytest.mark.parametrize("batch", [10_000, 7])
def test_sessions(spark, events, ttl, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got, want = (sorted(map(str, df.collect())) for df in (logs.sessions(events, ttl_seconds=ttl), by_window(events, ttl)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_sessions_of_named_keys_and_of_none(spark, events):
    named = events.withColumn("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    assert sorted(map(str, logs.sessions(named, ttl_seconds=60).collect())) == sorted(map(str, by_window(named, 60).collect()))
    assert logs.sessions(events.where("false")).count() == 0


@pytest.mark.parametrize("seconds", [1, 60, 5000])
def test_trailing_requests(spark, events, seconds):
    x = events.withColumnRenamed("user_id", "client")
    own = W.partitionBy("client").orderBy(logs.micros()).rangeBetween(-seconds * 1_000_000 + 1, 0)
    want = x.withColumn("trailing", F.count(F.lit(1)).over(own))
    got = logs.trailing_requests(x, seconds=seconds)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_hot_client_is_many_groups(spark, events):
    """Requests are dealt by client and span: no group has more than what two spans hold of a client."""
    x = events.withColumnRenamed("user_id", "client")
    plan = logs.trailing_requests(x)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__key" in plan and "__span" in plan.split("hashpartitioning(__key")[1][:60]


@pytest.mark.parametrize("chars", [1, 5, 20])
def test_overlap_pairs(spark, chars):
    r = random.Random(chars)
    rows, before = [], ""
    for i in range(1500):
        said = None if r.random() < 0.02 else (before[-r.randint(0, 25) :] if r.random() < 0.6 else "") + " ".join(r.choice(["alpha", "beta", "  ", "gamma"]) for _ in range(r.randint(0, 6)))
        rows.append((f"k{0 if r.random() < 0.7 else r.randrange(3)}", f"c{i:05d}", r.choice(["s", "s", "t", None]), said))
        before = said or ""
    chunks = spark.createDataFrame(rows, "kb_name string, chunk_id string, section string, text string")
    own = W.partitionBy("kb_name").orderBy("chunk_id")
    last, section = F.lag("text").over(own), F.lag("section").over(own)
    tail = text.strip(F.substr(last, F.greatest(F.length(last) - chars + 1, F.lit(1))))
    want = chunks.withColumn("p", F.when(last.isNotNull() & section.eqNullSafe(F.col("section")), F.contains(F.col("text"), tail)).otherwise(False)).groupBy("kb_name").agg(F.count_if("p").alias("overlap_pairs"))
    got = chunking.overlap_pairs(chunks, chars)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and sum(x.overlap_pairs for x in got.collect()) > 50
    assert chunking.overlap_pairs(chunks.where("false"), chars).count() == 0


def test_latency_quantiles(spark):
    """Merged sketches: the rank of each quantile is within one hundredth of what was asked, with a small sketch and many calls; exact where all calls fit."""
    r = random.Random(13)
    t0 = dt.datetime(2024, 3, 1)
    rows = [(t0 + dt.timedelta(seconds=i // 2), "/a", r.lognormvariate(0, 1), r.choice((200, 503))) for i in range(60_000)] + [(t0, "/none", None, 200), (t0, "/few", 0.5, 200)]
    x = spark.createDataFrame(rows, "ts timestamp, path string, seconds double, status int")
    stored = logs.metric_sketches(x, k=400)
    days = {v.path: v for v in logs.metric_values(logs.merge_metrics(stored, k=400)).collect()}
    values = sorted(v[2] for v in rows if v[1] == "/a")
    for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs(sum(v <= days["/a"][name] for v in values) / len(values) - q) < 0.01
    assert days["/a"].calls == 60_000 and days["/a"].max_seconds == values[-1] and days["/a"].mean_seconds == pytest.approx(sum(values) / len(values))
    assert days["/none"].p50 is None and days["/none"].mean_seconds is None and days["/few"].p99 == 0.5
    short = x.where("ts < '2024-03-01 00:05:00' and path = '/a'")
    exact = sorted(v.seconds for v in short.collect())
    got = logs.request_metrics(short).first()
    assert [got.p50, got.p95, got.p99] == [exact[-(-len(exact) * q // 100) - 1] for q in (50, 95, 99)]


def test_encoding_by_equal_work(spark):
    """A few texts hold most characters and lie side by side: tasks of equal work and batches of like length, and the same vectors."""
    r = random.Random(17)
    sizes = [r.choice((2000, 4000)) for _ in range(400)] + [r.randint(1, 60) for _ in range(6000)]
    rows = [("k", f"c{i}", " ".join(r.choice(["a", "bc", "def"]) for _ in range(n))) for i, n in enumerate(sizes)] + [("k", "none", None), ("k", "empty", "")]
    chunks = spark.createDataFrame(rows, "kb_name string, chunk_id string, text string").coalesce(2)
    dealt = embedding.balanced(chunks, 16)
    work = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64).alias("work"), F.count(F.lit(1)).alias("n")).collect()
    all_work = sorted(x.work for x in work)
    assert len(work) == 16 and sum(x.n for x in work) == len(rows) and all_work[-1] <= 1.5 * all_work[len(all_work) // 2]
    padding = lambda df, k: df.withColumn("i", F.monotonically_increasing_id()).select(F.col("i"), F.coalesce(F.length("text"), F.lit(0)).alias("n"), (F.col("i") / k).cast("long").alias("b")).groupBy("b").agg(F.sum(F.lit(1)).alias("rows"), F.max("n").alias("most"), F.sum("n").alias("own")).agg(F.sum(F.col("rows") * F.col("most")) / F.sum("own")).first()[0]
    mixed = chunks.orderBy(F.md5("chunk_id"))
    assert padding(dealt, 32) < 1.2 < padding(mixed, 32)
    make = embedding.hashing_encoder(8)
    vectors = lambda parts: {x.chunk_id: tuple(x.embedding) for x in embedding.encode_chunks(chunks, make, 8, parts=parts).collect()}
    assert vectors(None) == vectors(16)
    assert embedding.balanced(chunks.where("false"), 4).count() == 0


@pytest.mark.parametrize("name", ["request_metrics", "daily_metrics"])
def test_quantiles_of_many_calls_are_exact(spark, tmp_path, name):
    """More calls in an hour than a sketch holds, most of them of one path, and equal latencies across ranges: the rows of SQL."""
    r = random.Random(19)
    t0 = dt.datetime(2024, 3, 1)
    kinds = ["click"] * 8 + ["error", "view"]
    rows = [(i, t0 + dt.timedelta(seconds=r.randrange(100_000)), r.randrange(50), r.choice(kinds), r.choice((5.0, round(r.lognormvariate(3, 1), 2)))) for i in range(60_000)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert_same(catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.SQL[name]).df())


def test_exact_quantiles_of_null_paths_and_latencies(spark):
    x = spark.createDataFrame([(dt.datetime(2024, 3, 1), p, s, 200) for p, s in [(None, 3.0), (None, 1.0), (None, None), ("/none", None)]], "ts timestamp, path string, seconds double, status int")
    got = {v.path: (v.calls, v.p50, v.p99) for v in logs.request_metrics(x).collect()}
    assert got == {None: (3, 1.0, 3.0), "/none": (1, None, None)}
