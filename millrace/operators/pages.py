"""From parsed page records to sectioned pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import rules, text

#: Fields of a block's content that hold text, in the order they are read (fixed values).
CONTENT_FIELDS = ("content", "paragraph_content", "title_content", "item_content")

#: The field of a block's content whose items hold text in their item_content (fixed values).
LIST_FIELD, ITEM_FIELD = "list_items", "item_content"
DEPTH = 100  # of objects and arrays inside each other


def nested_text(content: Column, depth: int = DEPTH) -> Column:
    """All text of a block's content, a JSON string, in the order of CONTENT_FIELDS, joined by spaces; '' for what is no JSON.

    The content is a list of one VARIANT; each step puts what an object's fields or an array
    hold in its place, so texts stay in order, until only texts are left. Content that is
    nested deeper than `depth` is an error, which says so.
    """
    variants = "array<variant>"
    texts = "array<struct<text:string,more:variant>>"

    def node(v: Column) -> Column:
        told = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
        return F.struct(told.alias("text"), F.when(told.isNull(), v).alias("more"))

    def inside(x: Column) -> Column:
        items = F.try_variant_get(x["more"], "$", variants)
        own = F.try_variant_get(x["more"], "$", "map<string,variant>")
        listed = F.transform(F.coalesce(F.try_variant_get(F.try_element_at(own, F.lit(LIST_FIELD)), "$", variants), F.array().cast(variants)), lambda i: F.try_variant_get(i, f"$.{ITEM_FIELD}", "variant"))
        fields = F.concat(F.array(*[F.try_element_at(own, F.lit(f)) for f in CONTENT_FIELDS]), listed)
        held = F.filter(F.coalesce(items, F.when(own.isNotNull(), fields), F.array().cast(variants)), lambda v: v.isNotNull())
        return F.when(x["text"].isNotNull(), F.array(x)).otherwise(F.transform(held, node))

    root = F.try_parse_json(content)
    got = F.when(root.isNotNull(), F.array(node(root))).otherwise(F.array().cast(texts))
    unread = lambda held: F.exists(held, lambda x: x["text"].isNull())

    def step(held: Column, _: Column) -> Column:
        return F.when(unread(held), F.flatten(F.transform(held, inside))).otherwise(held).cast(texts)

    def said(held: Column) -> Column:
        joined = text.strip(F.array_join(F.filter(F.transform(held, lambda x: x["text"]), lambda t: t != ""), " "))
        return F.when(~unread(held), joined).otherwise(F.raise_error(F.lit(f"content nested deeper than {depth}: raise depth")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), got.cast(texts), step, said)


def layout_blocks(docs: DataFrame) -> DataFrame:
    """One row per block of (kb_name, source_pdf, pages: array of pages, each an array of {type, content}), with its page number and place."""
    pages = docs.select("kb_name", "source_pdf", F.posexplode("pages").alias("page", "blocks"))
    return pages.select("kb_name", "source_pdf", (F.col("page") + 1).alias("page_num"), F.posexplode("blocks").alias("pos", "block")).select("kb_name", "source_pdf", "page_num", "pos", F.col("block.type").alias("type"), F.col("block.content").alias("content"))


def layout_pages(docs: DataFrame) -> DataFrame:
    """One text row per page that has text: discarded and skipped blocks left out, tables as their html, the rest as nested text, joined by newlines."""
    blocks = layout_blocks(docs).where(~F.col("type").isin(*rules.DISCARDED_BLOCKS, *rules.SKIPPED_BLOCKS))
    told = blocks.withColumn("text", F.when(F.col("type") == "table", F.get_json_object("content", "$.html")).otherwise(nested_text(F.col("content")))).where(F.coalesce(F.col("text"), F.lit("")) != "")
    pages = told.groupBy("kb_name", "source_pdf", "page_num").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("blocks"))
    joined = F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")
    return pages.select("kb_name", "source_pdf", "page_num", F.lit("text").alias("type"), joined.alias("text"), F.length(joined).alias("char_count"))


def layout_stats(docs: DataFrame) -> DataFrame:
    """Pages, blocks and discarded blocks of each document. Pages count even if empty."""
    pages = docs.select("kb_name", "source_pdf", F.size("pages").cast("long").alias("pages"), F.flatten(F.transform("pages", lambda p: F.transform(p, lambda b: b["type"]))).alias("types"))
    return pages.select("kb_name", "source_pdf", "pages", F.size("types").cast("long").alias("blocks"), F.size(F.filter("types", lambda t: t.isin(*rules.DISCARDED_BLOCKS))).cast("long").alias("discarded"))


def table_pages(cells: DataFrame) -> DataFrame:
    """Table rows (kb_name, source_pdf, page_num, table_index from 0, cells) as page records of type table."""
    shown = cells.withColumn("text", text.table_markdown(F.col("cells"), F.col("table_index")))
    return shown.select(
        "kb_name", "source_pdf", "page_num", F.lit("table").alias("type"), (F.col("table_index") + 1).alias("table_index"), "text",
        F.size("cells").alias("row_count"), F.coalesce(F.size(F.try_element_at("cells", F.lit(1))), F.lit(0)).alias("col_count"), F.length("text").alias("char_count"),
    )


def pages_of_lines(docs: DataFrame, kb: Column, source: Column, lines: int = 10) -> DataFrame:
    """Plain texts as page records of `lines` lines each."""
    split = docs.select(kb.alias("kb_name"), source.alias("source_pdf"), F.split("text", "\n").alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines"), F.lit(lines))
    pages = split.select("kb_name", "source_pdf", F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("lines", i, F.lit(lines)), "\n"))).alias("page", "text"))
    return pages.select("kb_name", "source_pdf", (F.col("page") + 1).alias("page_num"), F.lit(0).alias("seq"), F.lit("text").alias("type"), "text", F.length("text").alias("char_count"))


def fill_sections(pages: DataFrame) -> DataFrame:
    """The last section seen in a document, carried on over its blocks in order; blocks before the first stay null."""
    own = W.partitionBy("kb_name", "source_pdf").orderBy("page_num", "seq").rowsBetween(W.unboundedPreceding, 0)
    return pages.withColumn("section", F.last("section", ignorenulls=True).over(own))


def parse_quality(pages: DataFrame, min_blocks: int = 10, max_empty: float = 0.1) -> DataFrame:
    """Counts of a knowledge base's blocks, with flags for too few and for too many empty ones."""
    empty = F.coalesce(text.strip(F.col("text")), F.lit("")) == ""
    got = pages.groupBy("kb_name").agg(F.count(F.lit(1)).alias("blocks"), F.sum("char_count").alias("total_chars"), F.avg("char_count").alias("avg_chars"), F.count_distinct(F.when(F.col("section") != "", F.col("section"))).alias("sections"), F.count_if(empty).alias("empty"))
    ratio = F.col("empty") / F.col("blocks")
    return got.withColumns({"too_few": F.col("blocks") < min_blocks, "empty_ratio": ratio, "too_empty": ratio > max_empty})


def section_pages(pages: DataFrame) -> DataFrame:
    """Blocks of each section of a knowledge base; those without one are left out."""
    return pages.where(F.coalesce(F.col("section"), F.lit("")) != "").groupBy("kb_name", "section").agg(F.count(F.lit(1)).alias("blocks"))
