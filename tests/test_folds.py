"""Order-dependent steps against plain statements of their rules, on random input."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.operators import chunking, logs


def plain_pack(paragraphs, long, most, overlap):
    chunks, buf = [], ""
    for p in paragraphs:
        if buf:
            if len(buf + "\n" + p) <= most:
                buf = buf + "\n" + p
                continue
            chunks.append(buf)
            tail = buf
            if len(tail) > overlap:
                stop = tail.rfind("。", 0, len(tail) - overlap)
                tail = tail[stop + 1 :] if stop > 0 else tail[-overlap:]
            buf = tail + "\n" + p
        elif len(p) <= most:
            buf = p
        else:
            chunks += long(p)
    return chunks + ([buf] if buf else [])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab。", min_size=1, max_size=30), max_size=12), st.integers(5, 40), st.integers(1, 10))
def test_pack(paragraphs, most, overlap):
    cut = lambda p: [p[i : i + most] for i in range(0, len(p), most)]
    assert list(chunking.pack(paragraphs, cut, most, overlap, "。")) == plain_pack(paragraphs, cut, most, overlap)


def test_pack_may_exceed_the_limit_with_a_buffer():
    assert [len(c) for c in chunking.pack(["a" * 5, "b" * 50], lambda p: [p], 20, 3, "。")] == [5, 54]


def test_pack_table():
    table = "T\nh\n---\n" + "\n".join(["x" * 9] * 5)
    assert list(chunking.pack_table(table, 30)) == ["T\nh\n---\n" + "\n".join(["x" * 9] * 2)] * 2 + ["T\nh\n---\n" + "x" * 9]
    assert list(chunking.pack_table("T\nh", 30)) == [] and list(chunking.pack_table("T\nh\n---", 30)) == []


def events(spark, n=400, clients=3, span=600, seed=1):
    r = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(seconds=r.randrange(span)), f"c{r.randrange(clients) if r.random() < 0.5 else 0}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, ts timestamp, client string")


def test_rate_limit(spark):
    rows, df = events(spark)
    want, seen = {}, {}
    for i, t, c in sorted(rows, key=lambda r: (r[1], r[0])):
        recent = [x for x in seen.get(c, []) if x > t - dt.timedelta(seconds=60)]
        want[i] = len(recent) < 5
        seen[c] = recent + [t] * want[i]
    assert {r.event_id: r.accepted for r in logs.rate_limit(df, most=5).collect()} == want
    assert set(want.values()) == {True, False}


def test_rate_limit_at_the_edge(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t0 + dt.timedelta(seconds=s), "a") for i, s in enumerate((0, 59, 60))], "event_id long, ts timestamp, client string")
    assert [r.accepted for r in logs.rate_limit(df, most=1).orderBy("event_id").collect()] == [True, False, True]


def test_cache_replay(spark):
    rows, df = events(spark, seed=2)
    want, written = {}, {}
    for i, t, c in sorted(rows, key=lambda r: (r[1], r[0])):
        want[i] = c in written and (t - written[c]).total_seconds() < 20
        if not want[i]:
            written[c] = t
    got = logs.cache_replay(df.withColumnRenamed("client", "cache_key"), ttl_seconds=20)
    assert {r.event_id: r.hit for r in got.collect()} == want
    assert logs.hit_ratio(got).first().accesses == len(rows)


def test_hints_need_more_than_the_rate(spark):
    log = spark.createDataFrame([("a", "x1", i < 7) for i in range(10)] + [("b", "x2", i < 8) for i in range(10)], "intent string, query string, success boolean")
    got = logs.intent_hints(spark.createDataFrame([(1, "x3")], "query_id int, query string"), log).collect()
    assert [(r.intent, round(r.boost, 6)) for r in got] == [("b", 0.2)]  # exactly 0.7 is not enough
