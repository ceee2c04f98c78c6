"""Sections to overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import rules, text
from millrace.sources.shared import stash

CHUNKS = "kb_name string, source_pdf string, run int, is_table int, table_seq int, pos int, text string, type string, page_start int, page_end int, section string, char_count int, table_index int, number bigint"


def section_runs(pages: DataFrame, unknown: str = rules.UNKNOWN_SECTION) -> DataFrame:
    """pages with `run`: consecutive blocks of a document with the same section have one number; null is `unknown`."""
    own = W.partitionBy("kb_name", "source_pdf").orderBy("page_num", "seq")
    named = pages.withColumn("section", F.when(F.coalesce(F.col("section"), F.lit("")) == "", unknown).otherwise(F.col("section")))
    new = F.when(F.col("section").eqNullSafe(F.lag("section").over(own)), 0).otherwise(1)
    return named.withColumn("__new", new).withColumn("run", F.sum("__new").over(own.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__new")


def run_ranges(runs: DataFrame) -> DataFrame:
    """For each run: section, blocks, and first and last text page."""
    place = F.struct("page_num", "seq")
    is_text = F.col("type") == "text"
    return runs.groupBy("kb_name", "source_pdf", "run").agg(
        F.first("section").alias("section"), F.count(F.lit(1)).alias("blocks"),
        F.min(F.when(is_text, place))["page_num"].alias("page_start"), F.max(F.when(is_text, place))["page_num"].alias("page_end"),
    )


def pack(paragraphs: list[str], long: Callable[[str], list[str]], max_chars: int, overlap: int, stop: str) -> Iterator[str]:
    """Paragraphs gathered up to max_chars; the next chunk begins with the end of the one before. What a chunk begins with depends on all before it, so this is a fold."""
    held = ""
    for p in paragraphs:
        if not held:
            if len(p) <= max_chars:
                held = p
            else:
                yield from long(p)
        elif len(held) + 1 + len(p) <= max_chars:
            held = f"{held}\n{p}"
        else:
            yield held
            tail = held
            if len(held) > overlap:
                at = held.rfind(stop, 0, len(held) - overlap)
                tail = held[at + 1 :] if at > 0 else held[len(held) - overlap :]
            held = f"{tail}\n{p}"
    if held:
        yield held


def pack_table(table: str, max_chars: int) -> Iterator[str]:
    """A markdown table cut between rows, each piece with the three lines on top."""
    lines = table.split("\n")
    head, held = "\n".join(lines[:3]), ""
    if len(lines) < 3:
        return
    for line in lines[3:]:
        if held and len(head) + len(held) + 1 + len(line) > max_chars:
            yield head + held
            held = ""
        held += "\n" + line
    if held:
        yield head + held


def build_chunks(pages: DataFrame, max_chars: int = rules.CHUNK_CHARS, overlap: int = rules.OVERLAP_CHARS, table_chars: int = rules.TABLE_CHARS, ends: str = rules.SENTENCE_ENDS, stop: str = rules.FULL_STOP, numbered_by: str = "kb_name", **merging) -> DataFrame:
    """Chunks of pages (kb_name, source_pdf, page_num, seq, type, text, section[, table_index]).

    One shuffle brings a document's blocks together, in order; runs, paragraphs and packing
    are taken from that partition. Ids count through numbered_by: source_pdf, where the fold
    counts as it goes, or kb_name, where a document's numbers begin after those of the
    documents before it. For that the chunks are made twice, once to be counted; of a
    knowledge base one task sees its documents' counts, never their texts.
    """
    if "table_index" not in pages.columns:
        pages = pages.withColumn("table_index", F.lit(None).cast("int"))
    runs = section_runs(pages)
    is_text = F.col("type") == "text"
    merged = runs.withColumn("paragraphs", F.when(is_text, text.paragraphs(text.merge_lines(F.col("text"), **merging))))
    merged = merged.withColumn("long", F.transform("paragraphs", lambda p: F.when(F.length(p) > max_chars, text.split_long(p, max_chars, ends))))
    merged = merged.select("kb_name", "source_pdf", "page_num", "seq", "run", "type", "section", F.when(~is_text, F.col("text")).alias("table"), "paragraphs", "long", F.col("table_index").cast("int").alias("table_index"))

    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def run_chunks(blocks: list) -> Iterator[tuple]:
        first = blocks[0]
        key = (first.kb_name, first.source_pdf, int(first.run))
        texts, tables = [b for b in blocks if b.type == "text"], [b for b in blocks if b.type == "table"]
        if texts:
            long = {p: list(c) for b in texts for p, c in zip(b.paragraphs, b.long, strict=True) if c is not None}
            found = pack([p for b in texts for p in b.paragraphs], long.__getitem__, max_chars, overlap, stop)
            for i, t in enumerate(found):
                yield *key, 0, 0, i, t, "text", int(texts[0].page_num), int(texts[-1].page_num), first.section, len(t), None
        for k, b in enumerate(tables):
            index = 1 if pd.isna(b.table_index) else int(b.table_index)
            for i, t in enumerate(pack_table(b.table, table_chars)):
                yield *key, 1, k, i, t, "table", int(b.page_num), int(b.page_num), first.section, len(t), index

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"table_index": "Int32"})

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks come in order, so a run is done where the next one starts; only its own blocks are held."""
        held: list = []
        document, number = None, 0

        def numbered() -> list[tuple]:
            nonlocal document, number
            if document != (held[0].kb_name, held[0].source_pdf):
                document, number = (held[0].kb_name, held[0].source_pdf), 0
            rows = [(*r, number + i) for i, r in enumerate(run_chunks(held))]
            number += len(rows)
            return rows

        for pdf in frames:
            out: list[tuple] = []
            for b in pdf.itertuples(index=False):
                if held and (b.kb_name, b.source_pdf, b.run) != (held[0].kb_name, held[0].source_pdf, held[0].run):
                    out += numbered()
                    held = []
                held.append(b)
            yield frame(out)
        if held:
            yield frame(numbered())

    ordered = merged.repartition("kb_name", "source_pdf").sortWithinPartitions("kb_name", "source_pdf", "page_num", "seq")
    chunks = ordered.mapInPandas(fold, CHUNKS)
    if numbered_by == "kb_name":
        counts = chunks.groupBy("kb_name", "source_pdf").agg(F.count(F.lit(1)).alias("own"))
        earlier = W.partitionBy("kb_name").orderBy("source_pdf").rowsBetween(W.unboundedPreceding, -1)
        starts = counts.select(F.col("kb_name").alias("__kb"), F.col("source_pdf").alias("__source"), F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("__before"))
        chunks = chunks.join(starts, F.col("kb_name").eqNullSafe(F.col("__kb")) & F.col("source_pdf").eqNullSafe(F.col("__source"))).withColumn("number", F.col("number") + F.col("__before"))
    elif numbered_by != "source_pdf":
        raise ValueError(f"ids count through kb_name or source_pdf, not {numbered_by}")
    return chunks.withColumn("chunk_id", F.format_string("chunk_%04d", "number")).select("kb_name", "chunk_id", "text", "type", "page_start", "page_end", "section", "source_pdf", "char_count", "table_index", "run", "pos")


def chunk_quality(chunks: DataFrame) -> DataFrame:
    """Counts and lengths of each knowledge base's chunks."""
    return chunks.groupBy("kb_name").agg(F.count(F.lit(1)).alias("chunks"), F.sum("char_count").alias("total_chars"), F.avg("char_count").alias("avg_chars"), F.min("char_count").alias("min_chars"), F.max("char_count").alias("max_chars"))


def chunk_sections(chunks: DataFrame, unknown: str = rules.UNKNOWN_SECTION) -> DataFrame:
    """Chunks of each section and their share of the knowledge base, in percent."""
    named = chunks.withColumn("section", F.when(F.coalesce(F.col("section"), F.lit("")) == "", unknown).otherwise(F.col("section")))
    counted = named.groupBy("kb_name", "section").agg(F.count(F.lit(1)).alias("chunks"))
    return counted.withColumn("percent", F.round(F.col("chunks") * 100.0 / F.sum("chunks").over(W.partitionBy("kb_name")), 1))


def overlap_pairs(chunks: DataFrame, chars: int = rules.OVERLAP_CHARS, order: tuple[str, ...] = ("chunk_id",), by: tuple[str, ...] = ("kb_name",)) -> DataFrame:
    """Neighbouring chunks of one section of which the second holds the first's last `chars` characters, for each value of `by`.

    Chunks are dealt by ranges of `by` and `order`, so a knowledge base lies in many tasks. A
    task counts its own neighbours; its first and last chunk meet those of the tasks beside
    it, two rows a task.
    """
    tail = text.strip(F.substr("text", F.greatest(F.length("text") - chars + 1, F.lit(1))))
    parts = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = chunks.select(*by, *order, "section", "text", tail.alias("__tail")).repartitionByRange(parts, *by, *order).sortWithinPartitions(*by, *order).select(*by, "section", "text", "__tail")
    kinds = [chunks.schema[c] for c in by]
    schema = T.StructType([*kinds, *T._parse_datatype_string("section string, text string, __tail string, part int, last boolean, pairs long").fields])
    names = schema.names
    none = {"section": None, "text": None, "__tail": None, "part": None, "last": None, "pairs": 0}

    def paired(before, after) -> bool:
        """(section, tail) and (section, text)."""
        return before[1] is not None and after[1] is not None and before[0] == after[0] and before[1] in after[1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held = TaskContext.get().partitionId(), None
        for pdf in frames:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            counts: dict = {}
            for *own, section, said, end in pdf.itertuples(index=False, name=None):
                key = tuple(own)
                if held is None:
                    yield pd.DataFrame([{**dict(zip(by, key, strict=True)), **none, "section": section, "text": said, "part": part, "last": False}])[names]
                counts[key] = counts.get(key, 0) + (held is not None and held[0] == key and paired(held[1:], (section, said)))
                held = (key, section, end)
            yield pd.DataFrame([{**dict(zip(by, k, strict=True)), **none, "pairs": n} for k, n in counts.items()], columns=names)
        if held is not None:
            yield pd.DataFrame([{**dict(zip(by, held[0], strict=True)), **none, "section": held[1], "__tail": held[2], "part": part, "last": True}])[names]

    told = stash(ranged.mapInPandas(run, schema), "overlap-parts")
    beside = W.partitionBy(*by).orderBy("part", "last")
    first = (~F.col("last")) & F.lag("last").over(beside) & F.lag("section").over(beside).eqNullSafe(F.col("section"))
    met = told.where("part is not null").withColumn("pairs", F.when(first & F.contains(F.col("text"), F.lag("__tail").over(beside)), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return told.where("part is null").select(*by, "pairs").unionByName(met.select(*by, "pairs")).groupBy(*by).agg(F.sum("pairs").alias("overlap_pairs"))
