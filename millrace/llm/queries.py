"""The registered queries of the operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, chat_format, decontaminate, html_text, language_id, mixing, quality, simhash, spelling, substring_dedup, topk, toxicity, url_filter
from millrace.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]

#: The contract's rules (fixed values): the path of each is below the first slash.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Host words whose URLs are labelled 1 for training; tables hold no URL labels (fixed values).
SEED_WORDS = ["spam", "pills", "casino", "bets", "ads", "adult", "porn", "viagra", "track", "cheap", "win"]

TOKENIZERS = "/opt/tokenizers"  # the folder of the public tokenizers' files, which only the driver reads


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str, of: int) -> Column:
    """Remainder of the crc32 of an id's digits."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def labelled_urls(pages: DataFrame) -> DataFrame:
    """(url, label) of the URLs: 1 where a word of the host is a seed word."""
    words = F.split(url_filter.parts(F.col("url"))["host"], "[^a-z0-9]+")
    return pages.where(F.col("url").isNotNull()).select("url", F.arrays_overlap(words, F.array(*[F.lit(w) for w in SEED_WORDS])).cast("int").alias("label"))


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, URL_RULES, url_filter.fit(labelled_urls(pages)))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = quality.train(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id", 3) != 1)
    return quality.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, F.col("vec_id") % 50 == 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs, fold("doc_id", 5) != 0)
    judged = language_id.identify(docs.drop("lang"), model)
    return judged.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.range(1).select(F.lit(-7).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text")) for i, role in enumerate(("user", "assistant"))])).alias("r")).select("conv_id", "r.*")
    records = chat_format.records_of(rows.unionByName(own))
    done = chat_format.format_records(records, ["system", "prompt", "response", "messages"])
    read = done.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("back"), chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said_by = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said_by.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.simhash_groups(docs).select("doc_id", "fingerprint", "component_id")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=fold("doc_id", 3) != 1)
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, alignment.load_pair(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")).select(F.col("doc_id").cast("long").alias("doc_id"), *alignment.NEW)


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages, html_text.fit(pages)).select("page_id", "url", "text", "n_chars")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the runs whose crc32 with their document's id 31 divides, one code point is deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.group_variants(docs, noise=spelling.delete_one_in(31))


QUERIES = {
    "op1_urls": op1_urls,
    "op2_quality": op2_quality,
    "op3_topk": op3_topk,
    "op4_mixing": op4_mixing,
    "op5_language": op5_language,
    "op6_decontamination": op6_decontamination,
    "op7_chat": op7_chat,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_substrings": op10_substrings,
    "op11_alignment": op11_alignment,
    "op12_html": op12_html,
    "op13_spelling": op13_spelling,
}
