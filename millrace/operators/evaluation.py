"""Judge verdicts to scores, and scores to a summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What judges write, merged over all metrics (fixed values).
VERDICT = (
    "score double, reasoning string, refused boolean, claims array<struct<claim:string,supported:boolean,evidence:string>>, "
    "per_fragment array<struct<index:int,relevant:boolean,reason:string>>, key_points array<struct<point:string,covered:boolean,evidence:string>>"
)
FENCES = (r"(?s)```json\s*(.*?)\s*```", r"(?s)```\s*(.*?)\s*```")
NUMBER = r"(0?\.\d+|1\.0|1|0)"
METRICS = ("faithfulness", "answer_relevancy", "context_precision", "context_recall")
BANDS = ((0.8, "excellent"), (0.6, "good"), (0.4, "fair"))


def parse_verdict(raw: Column) -> Column:
    """The first JSON object among the whole text, a json fence, a plain fence, and what lies from the first brace to the last; null if none."""

    def parsed(x: Column) -> Column:
        x = F.regexp_replace(x, r"^\s+|\s+$", "")
        got = F.from_json(x, f"{VERDICT}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
        return F.when(x.startswith("{") & got["_bad"].isNull(), got)

    fenced = [F.when(raw.rlike(p), F.regexp_extract(raw, p, 1)) for p in FENCES]
    last = F.length(raw) - F.instr(F.reverse(raw), "}") + 1
    braces = F.when((F.instr(raw, "{") > 0) & (last > F.instr(raw, "{")), F.substr(raw, F.instr(raw, "{"), last - F.instr(raw, "{") + 1))
    return F.coalesce(*[parsed(x) for x in (raw, *fenced, braces)])


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def judge_score(raw: Column, verdict: Column | None = None) -> Column:
    """A verdict's score between 0 and 1; else the first number in the text; else 0."""
    verdict = parse_verdict(raw) if verdict is None else verdict
    number = F.regexp_extract(raw, NUMBER, 1)
    return clamp(F.coalesce(verdict["score"], F.when(number != "", number.cast("double")), F.lit(0.0)))


def verdict_ratios(verdict: Column) -> dict[str, Column]:
    """Shares of supported claims, relevant fragments and covered points; null without any."""

    def share(items: Column, flag: str) -> Column:
        return F.when(F.size(items) > 0, F.size(F.filter(items, lambda x: F.coalesce(x[flag], F.lit(False)))) / F.size(items))

    return {"faithfulness_ratio": share(verdict["claims"], "supported"), "precision_ratio": share(verdict["per_fragment"], "relevant"), "recall_ratio": share(verdict["key_points"], "covered")}


def item_scores(items: DataFrame, verdicts: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Scores of each item (item_id, group, answer, ground_truth, negative) from its verdicts (item_id, metric, raw); a negative item has the verdict `hallucination`."""
    told = verdicts.withColumn("v", parse_verdict(F.col("raw"))).select("item_id", "metric", judge_score(F.col("raw"), F.col("v")).alias("score"), F.col("v.refused").alias("refused"))
    of = lambda m: F.max(F.when(F.col("metric") == m, F.col("score")))
    wide = told.groupBy("item_id").agg(*[of(m).alias(f"__{m}") for m in metrics], of("hallucination").alias("__h"), F.max(F.when(F.col("metric") == "hallucination", F.col("refused"))).alias("__refused"))
    x = items.join(wide, "item_id", "left").withColumn("__h", F.coalesce("__h", F.lit(0.0)))
    silent, negative = F.coalesce("answer", F.lit("")) == "", F.coalesce("negative", F.lit(False))
    refused = F.coalesce(F.col("__refused"), F.col("__h") > 0.7).cast("double")
    judged = {m: F.coalesce(f"__{m}", F.lit(0.0)) for m in metrics}
    judged["context_recall"] = F.when(F.coalesce("ground_truth", F.lit("")) == "", 0.0).otherwise(judged["context_recall"])
    scored = {m: F.when(silent, 0.0).when(negative, F.lit(0.0) if m == "context_precision" else refused).otherwise(c) for m, c in judged.items()}
    hall = F.when(silent & negative, 1.0).when(~silent & negative, F.col("__h"))
    return x.select("item_id", "group", negative.alias("negative"), *[c.alias(m) for m, c in scored.items()], hall.alias("hallucination_score"))


def eval_summary(scores: DataFrame, group: str | None = None, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Means of the metrics over items that are not negative, and of the hallucination scores over negative ones, with a band, for each group."""
    own = scores.where(F.col("group") == group) if group else scores
    mean = {m: F.round(F.avg(F.when(~F.col("negative"), F.col(m))), 4) for m in metrics}
    got = own.groupBy("group").agg(F.count(F.lit(1)).alias("items"), *[c.alias(m) for m, c in mean.items()], F.round(F.avg(F.when(F.col("negative"), F.col("hallucination_score"))), 4).alias("hallucination_resistance"))
    overall = sum((F.col(m) for m in metrics), F.lit(0.0)) / len(metrics)
    band = F.lit("poor")
    for least, name in reversed(BANDS):
        band = F.when(overall >= least, name).otherwise(band)
    return got.withColumn("band", band)


def retrieval_diag(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """Mean score, best score and spread of sections of the hits of each group (query_id, group)."""
    return hits.join(groups, "query_id").groupBy("group").agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("hits"), F.avg("score").alias("mean_score"), F.max("score").alias("best_score"), F.count_distinct("section").alias("sections"))
