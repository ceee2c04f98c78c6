"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Sizes are words. Each source has a target; targets are met in equal blocks of `block`
words. Blocks go to sources by highest quotients target / (2k - 1), then each source's
blocks go to its shards the same way by their sizes, so every shard has a whole quota.
A shard is some ROWS_PER_SHARD documents dealt by a hash of their ids; in it documents
follow one another in seeded order, and their words are cut into blocks. A quota of q
over n blocks takes each block q // n times and q % n of them, chosen by a seeded
permutation, once more. A document's words are taken as often as the blocks they lie in.

No shard holds more than its share of a source, however large the source; only tables of
a row a source and a row a shard are ranked. Quotas are found without iteration: with n
parties and S seats every party's count lies between its rounded shares of S - n/2 and
S + n/2 seats, so about 2n quotients are compared, whatever S is.

Null texts have no words and null sources are one source, last in order. Ties of
quotients go to the first source or shard in order. Documents of one id are in one shard,
ordered by size; which of equal rows takes a block makes no difference. An empty table
gives an empty result, and targets of zero where no document has words. Input columns with
the names of the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm._store import keep_columns, stash

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_SHARD, PRIME = 4096, 2147483647
NEW = ["size", "source_size", "target", "taken"]


def hex_number(text: Column) -> Column:
    """A number from the first eight hex digits of an md5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def apportion(parties: DataFrame, votes: str, seats: str, group: list[str], key: list[str]) -> DataFrame:
    """parties with `quota`: the seats of each group by Sainte-Laguë's highest quotients. seats is equal within a group."""
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    v = F.col(votes).cast("double")
    total, n = F.sum(v).over(whole), F.count(F.lit(1)).over(whole)
    share = lambda s: F.when(total > 0, v * s / total).otherwise(F.lit(0.0))
    bounded = parties.withColumns({"__low": share(F.greatest(F.col(seats) - n / 2, F.lit(0.0))), "__high": share(F.col(seats) + n / 2)})
    bounded = bounded.withColumns({"__sure": F.greatest(F.floor(F.col("__low") - 0.5), F.lit(0)), "__most": F.ceil(F.col("__high") + 0.5)})
    names = [F.col(f"`{c}`") for c in parties.columns]
    # every party keeps a row (k = its sure seats), so that one without seats is not lost
    tried = bounded.select(*names, "__sure", F.explode(F.sequence("__sure", F.greatest("__most", "__sure"))).alias("__k"))
    contested = F.col("__k") > F.col("__sure")
    first = W.partitionBy(*(group or [F.lit(0)])).orderBy(contested.cast("int").desc(), F.when(contested, v / (2 * F.col("__k") - 1)).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in key], "__k")
    sure = F.sum(F.when(~contested, F.col("__sure")).otherwise(F.lit(0))).over(whole)
    won = tried.withColumns({"__rank": F.row_number().over(first), "__left": F.col(seats) - sure})
    won = won.withColumn("__won", (contested & (v > 0) & (F.col("__rank") <= F.col("__left"))).cast("long"))
    return won.groupBy(*parties.columns).agg((F.first("__sure") + F.sum("__won")).cast("long").alias("quota"))


def targets(sources: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """(source, source_size, docs) with target: shares of `share` times all words by weight, none above `most` times its source's."""
    every = W.partitionBy(F.lit(0))
    place = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    x = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    x = x.withColumns({"all": F.sum("source_size").over(every) * F.lit(float(share)), "ratio": F.col("cap") / F.col("weight")})
    order = every.orderBy("ratio", F.col("source").asc_nulls_last())
    x = x.withColumns({
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    x = x.withColumn("level", (F.col("all") - F.col("before")) / F.col("rest"))
    free = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))
    return x.withColumn("free", F.min(free).over(every)).select("source", "source_size", "docs", F.when(F.col("free").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("free.level") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, weights: list[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 32, seed: int = 42, rows_per_shard: int = ROWS_PER_SHARD, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", keep_text: bool = True) -> DataFrame:
    """docs with size, source_size, target and taken. most: whole number of times that a word is taken at most."""
    docs = keep_columns(docs, NEW, text_col, id_col, source_col)
    own = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text_col]  # kept in a struct, so that no name of theirs meets one of ours
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    sized = docs.select(F.struct(*own).alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"))
    # words are counted once for all sums; a text that stays in the result is read once more, and moves once
    small = stash(sized.drop("doc") if keep_text else sized, "mix-sizes")
    sized = sized if keep_text else small
    sources = stash(small.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "mix-sources")
    goals = targets(sources, list(weights), share, most).withColumn("shards", F.ceil(F.col("docs") / rows_per_shard))
    seats = goals.withColumn("seats", F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block))
    quotas = stash(apportion(seats, "target", "seats", [], ["source"]).withColumnRenamed("quota", "source_quota"), "mix-quotas")
    goal = quotas.select(F.col("source").alias("goal_of"), "source_size", "target", "shards", "source_quota")
    ordered = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    shard = F.pmod(hex_number(F.concat_ws(":", F.lit(f"{seed}s"), F.col("id").cast("string"))), F.col("shards"))
    deal = lambda df: df.join(goal, F.col("source").eqNullSafe(F.col("goal_of"))).withColumns({"order": ordered, "shard": shard})
    dealt = deal(sized)
    shards = deal(small).groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_quota").alias("source_quota")).withColumn("blocks", F.ceil(F.col("words") / block))
    given = apportion(shards, "words", "source_quota", ["source"], ["shard"]).withColumn("quota", F.least("quota", F.col("blocks") * int(most)))
    given = given.select(F.col("source").alias("quota_of"), F.col("shard").alias("quota_shard"), F.col("blocks").alias("n"), "quota")
    place = W.partitionBy("source", "shard").orderBy("order", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("end", F.sum("size").over(place)).withColumn("start", F.col("end") - F.col("size"))
    full = placed.join(given, F.col("source").eqNullSafe(F.col("quota_of")) & (F.col("shard") == F.col("quota_shard")))
    start, end, n, quota = (F.col(c) for c in ("start", "end", "n", "quota"))
    offset = hex_number(F.concat_ws(":", F.lit(f"{seed}b"), F.coalesce("source", F.lit("")), F.col("shard").cast("string")))

    def words(j: Column) -> Column:
        again = (F.pmod(j * PRIME + offset, n) < F.pmod(quota, n)).cast("long")
        return (F.floor(quota / n) + again) * (F.least(end, (j + 1) * block) - F.greatest(start, j * block))

    blocks = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
    taken = F.when(F.col("size") > 0, F.aggregate(blocks, F.lit(0).cast("long"), lambda total, j: total + words(j))).otherwise(F.lit(0).cast("long"))
    return full.withColumn("taken", taken).select("doc.*", *NEW)
