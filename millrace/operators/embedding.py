"""Chunks to vectors, and vectors to the collection that search reads."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Callable[[], Encoder]:
    """A deterministic encoder without a model: signed counts of hashed words."""

    def make() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for i, t in enumerate(texts):
                for w in t.split():
                    h = zlib.crc32(w.encode())
                    out[i, h % dim] += 1.0 if h >> 16 & 1 else -1.0
            return out

        return encode

    return make


def encode_chunks(chunks: DataFrame, make_encoder: Callable[[], Encoder], dim: int, batch: int = 32, parts: int | None = None) -> DataFrame:
    """A vector row for each chunk: its metadata with defaults, no text, and a vector of unit length. The encoder is made once a task; a wrong count or dimension fails the task. parts: deal chunks to as many tasks of equal work and like lengths first, for encoders that cost more than an exchange of the texts."""
    if parts:
        chunks = balanced(chunks, parts)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for pdf in frames:
            parts = []
            texts = pdf.pop("__text").fillna("").tolist()
            for i in range(0, len(texts), batch):
                got = np.asarray(encode(texts[i : i + batch]), np.float32)
                if got.shape != (len(texts[i : i + batch]), dim):
                    raise ValueError(f"encoder gave {got.shape} for {len(texts[i : i + batch])} texts of dimension {dim}")
                parts.append(got / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-12))
            yield pdf.assign(embedding=list(np.concatenate(parts)) if parts else [])

    meta = chunks.select(*vector_columns(chunks), F.col("text").alias("__text"))
    schema = T.StructType([*[f for f in meta.schema if f.name != "__text"], T.StructField("embedding", T.ArrayType(T.FloatType()))])
    return meta.mapInPandas(run, schema)


def balanced(chunks: DataFrame, parts: int, text_col: str = "text", each: int = 64, steps: int = 8) -> DataFrame:
    """chunks in `parts` partitions of about equal work, each of texts of like length, in order of length: batches hold little padding, and no task has all long texts.

    A text's work is its characters and `each`. Work is summed for classes of lengths, `steps`
    to each doubling (at most some hundred rows); a class gets partitions by its share of the
    work, of which the last may hold the first of the next class, and its rows are dealt to them.
    """
    cost = F.coalesce(F.length(text_col), F.lit(0)) + F.lit(each)
    kind = F.floor(F.log2(cost) * steps).cast("int")
    sums = sorted((r.kind, r.cost) for r in chunks.groupBy(kind.alias("kind")).agg(F.sum(cost).alias("cost")).collect())
    total = sum(c for _, c in sums)
    if not total:
        return chunks
    done, rows = 0, []
    for k, c in sums:
        rows.append((k, done * parts / total, c * parts / total))
        done += c
    spans = chunks.sparkSession.createDataFrame(rows, "__kind int, __start double, __share double")
    number = F.xxhash64(*[F.col(f"`{c}`") for c in chunks.columns], F.monotonically_increasing_id())
    at = F.col("__start") + F.col("__share") * (F.shiftrightunsigned(number, 1) / F.lit(float(1 << 63)))
    placed = chunks.withColumn("__kind", kind).join(F.broadcast(spans), "__kind").withColumn("__part", F.least(F.floor(at), F.lit(parts - 1)).cast("int"))
    dealt = placed.withColumn("__cost", cost).repartitionById(parts, "__part").sortWithinPartitions("__cost")
    return dealt.drop("__kind", "__start", "__share", "__part", "__cost")


def vector_columns(chunks: DataFrame) -> list:
    """A chunk's metadata with defaults for what is missing."""
    default = {"page_start": 0, "page_end": 0, "section": "", "source_pdf": "", "type": "text", "table_index": 0}
    return ["kb_name", "chunk_id", *((F.coalesce(F.col(c), F.lit(v)) if c in chunks.columns else F.lit(v)).alias(c) for c, v in default.items())]


def pending_chunks(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks that have no vector yet."""
    return chunks.join(done.select("kb_name", "chunk_id"), ["kb_name", "chunk_id"], "left_anti")


def embedding_quality(vectors: DataFrame) -> DataFrame:
    """All rows, rows with a vector, and the vectors' dimensions."""
    has = F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return vectors.agg(F.count(F.lit(1)).alias("total"), F.count_if(has).alias("with_vector"), F.array_sort(F.collect_set(F.when(has, F.size("embedding")))).alias("dims"))


def backfill_text(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """vectors with their chunks' text, '' where there is none; of repeated ids the last line counts. The join sees ids and texts only."""
    last = chunks.groupBy("kb_name", "chunk_id").agg(F.max_by("text", "line").alias("text"))
    return vectors.join(last, ["kb_name", "chunk_id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def dim_gate(vectors: DataFrame) -> DataFrame:
    """Vectors of the knowledge bases whose vectors all have one dimension."""
    even = vectors.groupBy("kb_name").agg(F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).where("least = most").select("kb_name")
    return vectors.join(even, "kb_name", "left_semi")


def collection(vectors: DataFrame) -> DataFrame:
    """Vector rows with their whole text as rows of the collection."""
    return vectors.select(
        "chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("page_start"), F.lit(0)).cast("long").alias("page_start"), F.coalesce(F.col("page_end"), F.lit(0)).cast("long").alias("page_end"),
        F.coalesce("section", F.lit("")).alias("section"), F.coalesce("source_pdf", F.lit("")).alias("source_pdf"), F.coalesce("type", F.lit("text")).alias("content_type"),
        F.coalesce(F.col("table_index"), F.lit(0)).cast("long").alias("table_index"), "kb_name", "embedding",
    )


def collection_stats(rows: DataFrame) -> DataFrame:
    """Rows and dimension of each knowledge base."""
    return rows.groupBy("kb_name").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("embedding")).alias("dim"))
