"""From raw documents to a mix for training: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, mixing, simhash, substring_dedup, toxicity
from millrace.llm._store import release, stash, stashed
from millrace.llm.queries import fold, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity model rejects; it learns from labels outside the held-out third.

    Null and empty texts are scored by the model's bias and stay if that is below the
    threshold; equal rows are judged alike; without labels nothing is rejected.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id", 3) != 1)
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id.

    Null and empty texts are one group. Of rows equal in id and text one stays; a null id is
    last.
    """
    return simhash.drop_near_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur more than once; n_chars follows the text.

    Every document stays, one whose words all go with what spacing is left; null texts stay
    null and have null n_chars.
    """
    return substring_dedup.dedup_substrings(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages: those with one word in twenty hit. Null and empty texts stay."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of them; null texts have none, null sources are one source."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL cannot express fingerprints by XXH64 or the fitted model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs, others = table(spark, sf_dir, "documents"), set(stashed(spark))
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        own = stashed(spark)[-1]
        release(spark, [p for p in stashed(spark) if p not in others and p != own])  # what led to this stage's rows
    return STAGES[-1][1](spark, docs, sf_dir)
