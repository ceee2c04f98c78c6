"""A stream over files gives what the batch job gives on the same rows."""

import datetime as dt
import random

import pytest

from millrace.operators import logs
from millrace.streaming import traffic

SCHEMA = "event_id long, ts timestamp, client string, path string, seconds double, status int"


@pytest.fixture
def stream(spark, tmp_path):
    r = random.Random(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = sorted((t0 + dt.timedelta(seconds=r.randrange(40000)), i) for i in range(600))
    rows = [(k, t, f"c{r.randrange(4)}", f"/p{r.randrange(2)}", float(k % 5) / 2, 200) for k, (t, _) in enumerate(rows)]
    for part in range(3):  # three files in order of time, read one a batch
        spark.createDataFrame(rows[part * 200 : part * 200 + 200], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(9999, t0 + dt.timedelta(days=9), "end", "/end", 0.0, 200)], SCHEMA)  # moves the watermark past all others
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(make):
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = f"out_{r.randrange(10**9)}"
        q = make(source).writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    return run, spark.createDataFrame(rows, SCHEMA)


def test_limiter(stream):
    run, batch = stream
    got = run(lambda s: traffic.limiter_stream(s, most=3, seconds=600)).where("client <> 'end'")
    want = logs.rate_limit(batch, most=3, seconds=600)
    assert {(r.event_id, r.accepted) for r in got.collect()} == {(r.event_id, r.accepted) for r in want.collect()}


def test_cache(stream):
    run, batch = stream
    got = run(lambda s: traffic.cache_stream(s.withColumnRenamed("client", "cache_key"), ttl_seconds=900)).where("cache_key <> 'end'")
    want = logs.cache_replay(batch.withColumnRenamed("client", "cache_key"), ttl_seconds=900)
    assert {(r.event_id, r.hit) for r in got.collect()} == {(r.event_id, r.hit) for r in want.collect()}


def test_metrics(stream):
    run, batch = stream
    stored = run(lambda s: traffic.metrics_stream(s)).where("path <> '/end'")
    for got, want in ((stored, logs.metric_sketches(batch)), (logs.merge_metrics(stored), logs.metric_sketches(batch, "1 day"))):
        assert sorted(map(str, logs.metric_values(got).collect())) == sorted(map(str, logs.metric_values(want).collect()))


def test_sessions(stream):
    run, batch = stream
    got = run(lambda s: traffic.session_stream(s, "client", "10 minutes")).where("client <> 'end'")
    want = logs.sessions(batch, "client", 600)
    pick = lambda df: {(r.client, r.session_start, r.n) for r in df.collect()}
    assert pick(got) == pick(want)


@pytest.fixture
def rocksdb(spark):
    for k, v in traffic.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in traffic.STATE_STORE:
        spark.conf.unset(k)


def said(s):
    return s.selectExpr("client AS session_id", "ts", "path AS role", "cast(event_id AS string) AS content")


def tails(rows, kept, ttl=None):
    """A session's last messages by plain Python; those before a pause of ttl seconds are forgotten."""
    last, when = {}, {}
    for r in sorted(rows, key=lambda r: (r.ts, r.event_id)):
        if ttl and r.client in when and (r.ts - when[r.client]).total_seconds() >= ttl:
            last[r.client] = []
        last[r.client], when[r.client] = [*last.get(r.client, []), str(r.event_id)][-kept:], r.ts
    return last


def latest(got):
    final = {}
    for r in got.collect():
        final[r.session_id] = max(final.get(r.session_id, []), [m.content for m in r.messages], key=lambda x: int(x[-1]) if x else -1)
    return final


@pytest.mark.parametrize("ttl", [86400, 200])
def test_tail(stream, rocksdb, ttl):
    run, batch = stream
    got = run(lambda s: traffic.tail_stream(said(s), kept=5, ttl_seconds=ttl)).where("session_id <> 'end'")
    assert latest(got) == tails(batch.collect(), 5, ttl)


def test_tail_goes_on_after_a_restart_and_forgets_ended_sessions(spark, tmp_path, rocksdb):
    """The query is stopped after each file and started again from its checkpoint: the tails of one run. Sessions that have ended hold no state."""
    t0, r = dt.datetime(2024, 1, 1), random.Random(2)
    files = [[(k * 100 + i, t0 + dt.timedelta(days=k, seconds=i), f"c{r.randrange(3)}", "/p", 0.0, 200) for i in range(30)] for k in range(3)]
    files.append([(999, t0 + dt.timedelta(days=9), "end", "/end", 0.0, 200)])
    sizes = []
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        q = traffic.tail_stream(said(source), kept=40, ttl_seconds=2 * 86400).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        sizes.append(q.lastProgress.stateOperators[0].numRowsTotal)
    every = spark.createDataFrame([x for f in files for x in f], SCHEMA).collect()
    assert latest(spark.read.parquet(str(tmp_path / "out"))) == tails(every, 40, 2 * 86400)
    assert max(sizes[:3]) <= 3 * (40 + 3) and sizes[-1] < sizes[0]


def test_trailing(stream):
    run, batch = stream
    got = run(lambda s: traffic.trailing_stream(s, window="20 minutes", slide="10 minutes")).where("client <> 'end'")
    assert got.groupBy().sum("n").first()[0] == 2 * batch.count()
