"""URL filter: domain rules first, then gradient-boosted trees on lexical features.

The trees see length, depth, digit ratio, entropy, parameter counts, host shape and
statistics of the host's suffixes of one, two and three labels: how many labelled URLs have
the suffix, and how often these are blocked. They are fitted on at most `max_rows` distinct
labelled URLs, chosen by a hash of the URL, half of them blocked where there are enough; a
URL labelled both ways counts as blocked. A labelled URL's own label is left out of the
rates that it is fitted with, and for half of the longest suffixes (by a hash) the fit sees
no statistics at all, so the trees learn to judge hosts that no label names as well. All of
it is DataFrame functions and DataFrame-based ML; nothing runs in Python on executors.

A rule is "host/path": it fits its host and all subdomains where the URL's path starts
with /path; of several the longest wins. Rules are a literal list of at most MAX_RULES; an
address that no rule fits gets the trees' verdict.

Null URLs and those without "://" have an empty host and path, no rule, and are judged by
the trees like any other. Labels of one class only give that class's verdict, no labels
"allow". Repeated rows are judged alike; an empty table gives an empty result. Input
columns with the names of the result's are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.sampling import below, hash_sample, key_hash
from millrace.llm._store import keep_columns, stash

MAX_RULES, MAX_ROWS = 1000, 20_000
NEW = ["host", "path", "rule", "verdict"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIXES = (1, 2, 3)  # labels of the host's suffixes that have statistics
LEXICAL = ["f_length", "f_host", "f_path", "f_depth", "f_labels", "f_hyphens", "f_digits", "f_host_digits", "f_entropy", "f_params", "f_longest"]
FEATURES = [*LEXICAL, *(f"f_{kind}{k}" for k in SUFFIXES for kind in ("count", "rate"))]
PRIOR = 2.0  # labelled URLs' weight at which a suffix's rate equals half the mean and half its own


def parts(url: Column) -> dict[str, Column]:
    """host, path and the rest of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return {
        "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "__query": F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1),
    }


def rule_of(rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits host and path, or null. rules: (rule, verdict) pairs."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules; join larger tables on the host's suffixes")
    host, path, found = F.col("host"), F.col("path"), F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, below = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(f"/{below}"))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def with_features(urls: DataFrame, url_col: str) -> DataFrame:
    """urls with host, path and the features of a URL alone."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    x = urls.withColumns(parts(F.col(url_col)))
    host, path, query, n = F.col("host"), F.col("path"), F.col("__query"), F.length(url)

    def count(text: Column, pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    def information(total: Column, letter: Column) -> Column:
        p = (n - F.length(F.replace(url, letter, F.lit("")))) / n
        return total - F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0))

    letters = F.array_distinct(F.split(url, ""))
    return x.withColumns({
        "f_length": n,
        "f_host": F.length(host),
        "f_path": F.length(path),
        "f_depth": count(path, "/[^/]"),
        "f_labels": count(host, "[^.]+"),
        "f_hyphens": count(host, "-"),
        "f_digits": F.when(n > 0, count(url, "[0-9]") / n).otherwise(F.lit(0.0)),
        "f_host_digits": count(host, "[0-9]"),
        "f_entropy": F.when(n > 0, F.aggregate(letters, F.lit(0.0), information)).otherwise(F.lit(0.0)),
        "f_params": count(query, "[^&]+"),
        "f_longest": F.coalesce(F.array_max(F.transform(F.split(host, "[.]"), lambda s: F.length(s))), F.lit(0)),
        **{f"__suffix{k}": F.substring_index(host, ".", -k) for k in SUFFIXES},
    })


class UrlModel:
    """A fitted forest with the suffixes' statistics and the share of blocked URLs, or one verdict for all."""

    def __init__(self, forest, suffixes: DataFrame | None, always: str | None, share: float = 0.5):
        self.forest, self.suffixes, self.always, self.share = forest, suffixes, always, share

    def importances(self) -> dict[str, float]:
        """How much each feature counts in the trees."""
        return dict(zip(FEATURES, map(float, self.forest.featureImportances), strict=True)) if self.forest else {}


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", max_rows: int = MAX_ROWS, trees: int = 20, depth: int = 4, seed: int = 42) -> UrlModel:
    """A model from labelled URLs (1: block, 0: allow)."""
    rows = labelled.where(F.col(f"`{label_col}`").isin(0, 1)).select(F.col(f"`{url_col}`").alias("url"), F.col(f"`{label_col}`").cast("double").alias("label"))
    # URLs are cut by their hash before equal ones meet, so that copies of one cost nothing
    known = {int(r.label): r.n for r in rows.groupBy("label").agg(F.approx_count_distinct("url").alias("n")).collect()}
    limit = {k: below(max_rows // 2, known.get(k, 0), 1.5) for k in (0, 1)}
    limit[1] = max(limit.values())  # so that a URL labelled both ways is always seen as blocked
    near = rows.where(key_hash("url") <= F.when(F.col("label") == 1, F.lit(limit[1])).otherwise(F.lit(limit[0])))
    near = stash(near.groupBy("url").agg(F.max("label").alias("label")), "near-urls")
    halves = [hash_sample(near.where(F.col("label") == k), max_rows // 2, "url", limit=limit[k]) for k in (1, 0)]
    sample = stash(with_features(reduce(DataFrame.unionByName, halves), "url").drop("url", "path", "__query"), "labelled-urls")
    n = {int(r.label): r["count"] for r in sample.groupBy("label").count().collect()}
    if len(n) < 2:
        return UrlModel(None, None, "block" if n.get(1) else "allow")
    share = n[1] / sum(n.values())
    each = [sample.groupBy(F.lit(k).alias("labels"), F.col(f"__suffix{k}").alias("suffix")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("label").alias("blocked")) for k in SUFFIXES]
    suffixes = stash(reduce(DataFrame.unionByName, each), "url-suffixes")
    weight = F.when(F.col("label") == 1, F.lit(0.5 / n[1])).otherwise(F.lit(0.5 / n[0])) * sum(n.values())
    unseen = F.pmod(F.xxhash64(F.col(f"__suffix{SUFFIXES[-1]}"), F.lit(seed)), F.lit(2)) == 0
    ready = assembled(sample, suffixes, share, F.col("label"), unseen).select("features", "label", weight.alias("weight"))
    forest = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, weightCol="weight", subsamplingRate=1.0, featureSubsetStrategy="onethird").fit(ready)
    return UrlModel(forest, suffixes, None, share)


def assembled(x: DataFrame, suffixes: DataFrame, share: float, own: Column | None = None, unseen: Column | None = None) -> DataFrame:
    """x with the feature vector. suffixes has at most a row for each labelled URL of the bounded sample and number of labels. own: label to leave out; unseen: rows whose longest suffix counts as not known."""
    for k in SUFFIXES:
        known = suffixes.where(F.col("labels") == k).select(F.col("suffix").alias(f"__suffix{k}"), F.col("n").alias("__n"), F.col("blocked").alias("__blocked"))
        x = x.join(F.broadcast(known), f"__suffix{k}", "left")
        n, blocked = F.coalesce("__n", F.lit(0.0)), F.coalesce("__blocked", F.lit(0.0))
        if own is not None:
            n, blocked = n - 1, blocked - own
        if unseen is not None and k == SUFFIXES[-1]:
            n, blocked = F.when(unseen, F.lit(0.0)).otherwise(n), F.when(unseen, F.lit(0.0)).otherwise(blocked)
        x = x.withColumns({f"f_count{k}": F.log1p(n), f"f_rate{k}": (blocked + PRIOR * share) / (n + PRIOR)}).drop("__n", "__blocked")
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x)


def judge(urls: DataFrame, rules: list[tuple[str, str]], model: UrlModel, url_col: str = "url") -> DataFrame:
    """urls with host, path, rule (null if none fits) and verdict (block or allow)."""
    urls = keep_columns(urls, NEW, url_col)
    columns = [F.col(f"`{c}`") for c in urls.columns]
    x = with_features(urls.select(F.struct(*columns).alias("__row"), F.col(f"`{url_col}`").alias("__url")), "__url").withColumn("__rule", rule_of(rules))
    if model.forest is None:
        x = x.withColumn("__verdict", F.lit(model.always))
    else:
        x = model.forest.transform(assembled(x, model.suffixes, model.share)).withColumn("__verdict", F.when(F.col("prediction") == 1, "block").otherwise("allow"))
    return x.select("__row.*", "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", "__verdict").alias("verdict"))
