"""Page files, JSON lines and the multi-collection table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = "page_num int, source_pdf string, text string, char_count int, type string, table_index int, row_count int, col_count int, section string"
CHUNK = "chunk_id string, text string, type string, page_start int, page_end int, section string, source_pdf string, char_count int, table_index int"
BAD = "_bad"


def read_pages(spark: SparkSession, path: str, schema: str = PAGE) -> DataFrame:
    """Files that hold one JSON array of pages each. `seq` is a page's place in its file."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"array<struct<{_fields(schema)}>>").alias("pages"))
    return whole.select(F.posexplode("pages").alias("seq", "page")).select("seq", "page.*")


def _fields(schema: str) -> str:
    return ", ".join(f"{name}:{kind}" for name, kind in (f.split(" ", 1) for f in schema.split(", ")))


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Lines (value and any others) with status blank, bad or good and `record`, null unless good."""
    parsed = F.from_json("value", f"{schema}, {BAD} string", {"columnNameOfCorruptRecord": BAD})
    blank = F.trim(F.regexp_replace("value", r"\s", "")) == ""
    x = lines.withColumn("__r", parsed)
    good = F.col("__r").isNotNull() & F.col(f"__r.{BAD}").isNull() & F.trim("value").startswith("{")
    status = F.when(blank | F.col("value").isNull(), "blank").when(good, "good").otherwise("bad")
    fields = T.StructType.fromDDL(schema).names
    return x.withColumns({"status": status, "record": F.when(status == "good", F.struct(*[F.col(f"__r.{f}") for f in fields]))}).drop("__r")


def read_jsonl(spark: SparkSession, path: str, schema: str = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Records of JSON lines, and the counts of good, bad and blank lines."""
    lines = parse_lines(spark.read.text(path), schema)
    return lines.where("status = 'good'").select("record.*"), lines.groupBy("status").count()


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line, nulls left out."""
    df.write.mode(mode).json(path)


def write_collection(rows: DataFrame, path: str, mode: str = "append") -> None:
    """The collection as Parquet by knowledge base. append adds; replace rewrites the knowledge bases that rows have and leaves the others; rebuild starts anew."""
    if mode not in ("append", "replace", "rebuild"):
        raise ValueError(f"mode {mode!r}")
    out = rows.write.partitionBy("kb_name")
    if mode == "append":
        out.mode("append").parquet(path)
    else:
        out.mode("overwrite").option("partitionOverwriteMode", "dynamic" if mode == "replace" else "static").parquet(path)


def read_collection(spark: SparkSession, path: str, kb_name: str | None = None) -> DataFrame:
    """The collection, or one knowledge base: other partitions are not read."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("kb_name") == kb_name) if kb_name else rows
