"""Query logs, sessions, cache and traffic over tables; the streams are in millrace.streaming."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text
from millrace.sources.shared import shuffle_parts, stash


def micros(ts: str = "ts") -> Column:
    """Microseconds of a timestamp with or without a time zone."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def success(feedback: Column, least: float = 3.0) -> Column:
    """Whether feedback is good; null if there is none."""
    return feedback >= least


def intent_stats(log: DataFrame) -> DataFrame:
    """Queries of each intent, successes, and their rate."""
    got = log.groupBy("intent").agg(F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successes"))
    return got.withColumn("success_rate", F.col("successes") / F.col("total"))


def intent_patterns(log: DataFrame, **options) -> DataFrame:
    """Queries of each intent and pattern."""
    return log.groupBy("intent", text.query_pattern(F.col("query"), **options).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


def entity_suggest(mentions: DataFrame, prefix: str | None = None, k: int = 10) -> DataFrame:
    """The k most frequent values (type, value) of each type, those with the prefix only if one is given."""
    rows = mentions.where(F.col("value") != "")
    if prefix:
        rows = rows.where(F.startswith("value", F.lit(prefix)))
    counted = rows.groupBy("type", "value").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("type").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def intent_hints(queries: DataFrame, log: DataFrame, least: float = 0.7, most: float = 0.2, factor: float = 0.25) -> DataFrame:
    """(query_id, intent, boost) for each intent that has seen a query's pattern and succeeds more often than `least`."""
    good = intent_stats(log).where(F.col("success_rate") > least).select("intent", "success_rate")
    seen = intent_patterns(log).select("intent", "pattern").join(good, "intent")
    asked = queries.select("query_id", text.query_pattern(F.col("query")).alias("pattern"))
    return asked.join(seen, "pattern").select("query_id", "intent", F.least(F.lit(most), F.col("success_rate") * factor).alias("boost"))


def recent_history(log: DataFrame, n: int = 1000, tie: str = "event_id") -> DataFrame:
    """The latest n records."""
    return log.orderBy(F.desc("ts"), F.desc(tie)).limit(n)


def session_tail(messages: DataFrame, limit: int = 10, kept: int = 40) -> DataFrame:
    """(session_id, messages): the last 2 * limit of a session's kept messages, in order."""
    latest = W.partitionBy("session_id").orderBy(F.desc("turn"))
    own = messages.withColumn("__back", F.row_number().over(latest)).where(F.col("__back") <= min(kept, 2 * limit))
    return own.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("messages"))


def sessions(events: DataFrame, key: str = "user_id", ttl_seconds: int = 86400, tie: str = "event_id") -> DataFrame:
    """(key, session_start, session_end, n): a session ends ttl_seconds after its last write.

    Events are dealt by ranges of key and time, so a key of many events lies in many tasks. A
    task folds its events to sessions; of these only the first and the last may go on in a
    neighbour, and these few are put together by their gaps. Null keys are one key.
    """
    names = [key, "session_start", "session_end", "n", "edge"]
    ttl = ttl_seconds * 1_000_000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the session that may go on
        edge = True
        for pdf in frames:
            if not len(pdf):
                continue
            us = pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            code = pdf[key].astype(object).where(pdf[key].notna(), None)
            before = code.shift()
            new = ((code != before) & ~(code.isna() & before.isna())).to_numpy() | (np.diff(us, prepend=us[0]) >= ttl)
            new[0] = True
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(pdf))
            got = pd.DataFrame({key: pdf[key].to_numpy()[starts], "session_start": pdf["ts"].to_numpy()[starts], "session_end": pdf["ts"].to_numpy()[ends - 1], "n": ends - starts, "edge": False})
            if held is not None:
                same = held[key].iloc[0] == got[key].iloc[0] or (pd.isna(held[key].iloc[0]) and pd.isna(got[key].iloc[0]))
                gap = int((got["session_start"].iloc[0] - held["session_end"].iloc[0]) / np.timedelta64(1, "us"))
                if same and gap < ttl:
                    got.loc[0, "session_start"], got.loc[0, "n"] = held["session_start"].iloc[0], got["n"].iloc[0] + held["n"].iloc[0]
                else:
                    yield held.assign(edge=edge)[names]
                    edge = False
            if len(got) > 1:
                done = got.iloc[:-1].copy()
                done.iloc[0, 4] = edge
                edge = False
                yield done[names]
            held = got.iloc[-1:].reset_index(drop=True)
        if held is not None:
            yield held.assign(edge=True)[names]

    kind = events.schema["ts"].dataType
    schema = T.StructType([events.schema[key], T.StructField("session_start", kind), T.StructField("session_end", kind), T.StructField("n", T.LongType()), T.StructField("edge", T.BooleanType())])
    parts = max(1, int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = events.select(key, "ts", tie).repartitionByRange(parts, key, "ts", tie).sortWithinPartitions(key, "ts", tie).select(key, "ts")
    told = stash(ranged.mapInPandas(run, schema), "session-parts")
    order = W.partitionBy(key).orderBy("session_start", "session_end")  # two rows a task at most
    gap = micros("session_start") - F.lag(micros("session_end")).over(order)
    numbered = told.where("edge").withColumn("__new", F.when(gap < ttl, 0).otherwise(1)).withColumn("__session", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = numbered.groupBy(key, "__session").agg(F.min("session_start").alias("session_start"), F.max("session_end").alias("session_end"), F.sum("n").alias("n"))
    return told.where("not edge").drop("edge").unionByName(joined.drop("__session"))


def _fold(df: DataFrame, key: str, order: Sequence[str], new: T.StructField, make_step) -> DataFrame:
    """A column that depends, row by row, on the rows of a key before it. Keys are dealt to partitions and read in order, so a key's rows are never held at once; make_step() gives a function of a row's microseconds, started anew for each key."""
    names = [*df.columns, new.name]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, step = None, None
        for pdf in frames:
            out = []
            for k, t in zip(pdf[key], pdf["__us"], strict=True):
                if step is None or k != held:
                    held, step = k, make_step()
                out.append(step(t))
            yield pdf.drop(columns="__us").assign(**{new.name: out})[names]

    dealt = df.withColumn("__us", micros()).repartition(key).sortWithinPartitions(key, *order)
    return dealt.mapInPandas(run, T.StructType([*df.schema, new]))


def limiter(most: int, window_us: int):
    """Makes steps that tell whether a request is accepted: fewer than `most` accepted ones lie within the window before it. A step's memory is the list it was made with."""

    def make(accepted: list[int] | None = None):
        accepted = [] if accepted is None else accepted

        def step(t: int) -> bool:
            while accepted and accepted[0] <= t - window_us:
                accepted.pop(0)
            if len(accepted) >= most:
                return False
            accepted.append(t)
            return True

        return step

    return make


def rate_limit(requests: DataFrame, key: str = "client", most: int = 100, seconds: int = 60, tie: str = "event_id") -> DataFrame:
    """requests with accepted: rejected ones do not count against later ones."""
    return _fold(requests, key, ("ts", tie), T.StructField("accepted", T.BooleanType()), limiter(most, seconds * 1_000_000))


def trailing_requests(requests: DataFrame, key: str = "client", seconds: int = 60) -> DataFrame:
    """requests with trailing: all requests of the client in the window that ends with this one.

    Time is cut into spans of a window's length. A request looks no further back than the span
    before its own, so times also go into the next span, and a client's requests are dealt by
    span: a client with a third of all requests is as many groups as it has spans.
    """
    width = seconds * 1_000_000
    row = F.struct(*[F.col(f"`{c}`") for c in requests.columns])
    own = requests.select(F.col(f"`{key}`").alias("__key"), micros().alias("__us"), row.alias("__row"))
    span = F.floor(F.col("__us") / F.lit(width)).cast("long")
    both = own.withColumn("__span", span).unionByName(own.select("__key", "__us", F.lit(None).cast(own.schema["__row"].dataType).alias("__row"), (span + 1).alias("__span")))
    order = W.partitionBy("__key", "__span").orderBy("__us").rangeBetween(-width + 1, 0)
    return both.withColumn("__n", F.count(F.lit(1)).over(order)).where(F.col("__row").isNotNull()).select("__row.*", F.col("__n").alias("trailing"))


def cache_keys(queries: DataFrame, settings: Sequence[tuple[str, object]], extra_cols: Sequence[str] = ()) -> DataFrame:
    """queries (query, content_type, top_k[, context]) with result_key and query_key. settings: what the retrieval is set to; its signature is part of result_key."""
    signature = F.substring(F.md5(F.lit("|".join(f"{k}={v}" for k, v in settings))), 1, 8)
    parts = ["query", "content_type", "top_k", *extra_cols]
    result = F.md5(F.concat_ws("|", signature, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts]))
    plain = F.lower(text.strip(F.col("query")))
    own = F.when(F.coalesce(F.col("context"), F.lit("")) != "", F.concat_ws("|", "context", plain)).otherwise(plain) if "context" in queries.columns else plain
    return queries.withColumns({"result_key": result, "query_key": F.concat(F.lit("query:"), F.md5(own))})


def replay(ttl_us: int):
    """Makes steps that tell whether an access hits: the last write lies less than the TTL before it. Only misses write. A step's memory is the list it was made with."""

    def make(written: list[int] | None = None):
        written = [] if written is None else written

        def step(t: int) -> bool:
            if written and t - written[0] < ttl_us:
                return True
            written[:] = [t]
            return False

        return step

    return make


def cache_replay(accesses: DataFrame, key: str = "cache_key", ttl_seconds: int = 3600, tie: str = "event_id") -> DataFrame:
    """accesses with hit."""
    return _fold(accesses, key, ("ts", tie), T.StructField("hit", T.BooleanType()), replay(ttl_seconds * 1_000_000))


def hit_ratio(replayed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return replayed.groupBy(*by).agg(F.count(F.lit(1)).alias("accesses"), F.count_if("hit").alias("hits"), (F.count_if("hit") / F.count(F.lit(1))).alias("hit_ratio"))


SKETCH_K = 1024  # of latency sketches: quantiles are exact up to as many calls, beyond that their rank is off by some 0.3 % of the calls
QUANTILES = (0.5, 0.95, 0.99)


def metric_parts(slow: float = 1.0, k: int = SKETCH_K) -> list[Column]:
    """Aggregates of requests (status, seconds) that can be merged: numbers, sums, the maximum, and a sketch of the latencies. Null latencies are calls without one."""
    return [
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("seconds") > slow).alias("slow"), F.count_if(F.col("status") >= 500).alias("errors"),
        F.count("seconds").alias("timed"), F.sum("seconds").alias("total_seconds"), F.max("seconds").alias("max_seconds"), F.kll_sketch_agg_double("seconds", k).alias("latency"),
    ]


def metric_sketches(requests: DataFrame, window: str = "1 hour", slow: float = 1.0, k: int = SKETCH_K) -> DataFrame:
    """Metrics of each path in each window in the form that is stored and merged. requests: ts, path, status, seconds."""
    got = requests.groupBy(F.window("ts", window).alias("w"), "path").agg(*metric_parts(slow, k))
    return got.select(F.col("w.start").alias("window_start"), *[c for c in got.columns if c != "w"])


def merge_metrics(stored: DataFrame, window: str = "1 day", k: int = SKETCH_K) -> DataFrame:
    """Stored metrics of shorter windows as those of longer ones: no request is read again."""
    add = [F.sum(c).alias(c) for c in ("calls", "slow", "errors", "timed", "total_seconds")]
    got = stored.groupBy(F.window("window_start", window).alias("w"), "path").agg(*add, F.max("max_seconds").alias("max_seconds"), F.kll_merge_agg_double("latency", k).alias("latency"))
    return got.select(F.col("w.start").alias("window_start"), *[c for c in got.columns if c != "w"])


def latency_counts(requests: DataFrame, window: str = "1 hour") -> DataFrame:
    """(window_start, path, seconds, n): calls of each latency, the form of latencies that is stored where quantiles are to be exact. Null latencies are none."""
    got = requests.where(F.col("seconds").isNotNull()).groupBy(F.window("ts", window).alias("w"), "path", "seconds").agg(F.count(F.lit(1)).alias("n"))
    return got.select(F.col("w.start").alias("window_start"), "path", "seconds", "n")


def merge_counts(stored: DataFrame, window: str = "1 day") -> DataFrame:
    """Stored latency counts of shorter windows as those of longer ones."""
    got = stored.groupBy(F.window("window_start", window).alias("w"), "path", "seconds").agg(F.sum("n").alias("n"))
    return got.select(F.col("w.start").alias("window_start"), "path", "seconds", "n")


def _quantile_names(quantiles: Sequence[float]) -> dict[str, float]:
    return {f"p{q * 100:g}".replace(".", "_"): q for q in quantiles}


def exact_quantiles(counts: DataFrame, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """(window_start, path, p50 and so on): of n latencies in order, the one at n * q, rounded up.

    Counts (latency_counts) are dealt by ranges of window, path and latency, so a path of many
    latencies lies in many tasks. Sums of these ranges tell in which one a quantile lies, and
    only in a range are latencies counted in order.
    """
    names = _quantile_names(quantiles)
    dealt = stash(counts.repartitionByRange(shuffle_parts(counts.sparkSession), "window_start", "path", "seconds").withColumn("part", F.spark_partition_id()), "latencies")
    own = W.partitionBy("window_start", "path")
    sums = dealt.groupBy("window_start", "path", "part").agg(F.sum("n").alias("own"))  # a row a range and path
    sums = sums.withColumns({"before": F.sum("own").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("own"), "timed": F.sum("own").over(own)})
    place = lambda q: F.greatest(F.lit(1), F.ceil(F.col("timed") * F.lit(Decimal(str(q)))).cast("long"))
    wanted = sums.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), place(q).alias("place")) for n, q in names.items()])).alias("x"))
    wanted = wanted.where((F.col("x.place") > F.col("before")) & (F.col("x.place") <= F.col("before") + F.col("own")))
    wanted = wanted.select(F.col("window_start").alias("__start"), F.col("path").alias("__path"), F.col("part").alias("__part"), "x.name", (F.col("x.place") - F.col("before")).alias("place"))
    order = W.partitionBy("window_start", "path", "part").orderBy("seconds").rowsBetween(W.unboundedPreceding, 0)
    ranked = dealt.withColumn("upto", F.sum("n").over(order))
    there = F.col("window_start").eqNullSafe(F.col("__start")) & F.col("path").eqNullSafe(F.col("__path")) & (F.col("part") == F.col("__part"))
    met = ranked.join(wanted, there).where((F.col("place") <= F.col("upto")) & (F.col("place") > F.col("upto") - F.col("n")))
    return met.groupBy("window_start", "path").agg(*[F.max(F.when(F.col("name") == n, F.col("seconds"))).alias(n) for n in names])


def metric_values(stored: DataFrame, quantiles: Sequence[float] = QUANTILES, counts: DataFrame | None = None) -> DataFrame:
    """Stored metrics as figures: shares, means and quantiles (p50 and so on; null where no call has a latency). counts: the same windows' latency counts, for exact quantiles; else they come from the sketches."""
    names = _quantile_names(quantiles)
    if counts is None:
        shown = [F.when(F.col("timed") > 0, F.kll_sketch_get_quantile_double("latency", F.lit(float(q)))).alias(n) for n, q in names.items()]
    else:
        exact, shown = exact_quantiles(counts, quantiles).withColumnsRenamed({"window_start": "__start", "path": "__path"}), list(names)
        stored = stored.join(exact, F.col("window_start").eqNullSafe(F.col("__start")) & F.col("path").eqNullSafe(F.col("__path")), "left")
    return stored.select("window_start", "path", "calls", "slow", (F.col("errors") / F.col("calls")).alias("error_share"), (F.col("total_seconds") / F.col("timed")).alias("mean_seconds"), "max_seconds", *shown)


def request_metrics(requests: DataFrame, window: str = "1 hour", slow: float = 1.0, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Calls, slow calls, server errors and latency of each path in each window, quantiles exact. requests: ts, path, status, seconds."""
    return metric_values(metric_sketches(requests, window, slow), quantiles, latency_counts(requests, window))
