"""Whole chunking of small page sets, worked out by hand."""

from pyspark.sql import functions as F

from millrace.operators import chunking, pages

SCHEMA = "kb_name string, source_pdf string, page_num int, seq int, type string, text string, section string, table_index int"


def chunks(spark, rows, **options):
    got = chunking.build_chunks(spark.createDataFrame(rows, SCHEMA), **options)
    return [(r.kb_name, r.chunk_id, r.text, r.type, r.page_start, r.page_end, r.section, r.char_count) for r in got.orderBy("kb_name", "chunk_id").collect()]


def test_runs_tables_and_numbers(spark):
    a, b = "甲" * 12, "乙" * 12
    rows = [
        ("k", "s", 1, 0, "text", a, "一", None),
        ("k", "s", 1, 1, "table", "[表格 1]\nh\n---\nr1", "一", 3),
        ("k", "s", 2, 0, "text", b, "一", None),
        ("k", "s", 3, 0, "text", a, None, None),
        ("k", "s", 4, 0, "text", b, "一", None),
        ("k2", "s", 1, 0, "table", "[表格 1]\nh\n---", "一", None),
        ("k2", "t", 1, 0, "text", "短", "一", None),
        ("k2", "u", 1, 0, "text", a, "", None),
    ]
    assert chunks(spark, rows) == [
        ("k", "chunk_0000", f"{a}\n{b}", "text", 1, 2, "一", 25),  # text of the run goes before its tables
        ("k", "chunk_0001", "[表格 1]\nh\n---\nr1", "table", 1, 1, "一", 15),
        ("k", "chunk_0002", a, "text", 3, 3, "未知", 12),
        ("k", "chunk_0003", b, "text", 4, 4, "一", 12),  # the same section later is a run of its own
        ("k2", "chunk_0000", a, "text", 1, 1, "未知", 12),  # numbers start anew; short paragraphs and empty tables give nothing
    ]


def test_long_paragraph_with_and_without_a_buffer(spark):
    long = "丙" * 20 + "。" + "丁" * 20 + "。"
    alone = chunks(spark, [("k", "s", 1, 0, "text", long, "一", None)], max_chars=30)
    assert [c[2] for c in alone] == ["丙" * 20 + "。", "丁" * 20 + "。"]
    after = chunks(spark, [("k", "s", 1, 0, "text", f"{'甲' * 12}\n\n{long}", "一", None)], max_chars=30, overlap=5)
    assert [c[2] for c in after] == ["甲" * 12, "甲" * 5 + "\n" + long]  # met with a buffer it stays whole


def test_overlap_begins_after_a_full_stop(spark):
    text = "\n\n".join(["一二三四五六七八九。" + "十" * 10, "百" * 20])
    got = chunks(spark, [("k", "s", 1, 0, "text", text, "一", None)], max_chars=25, overlap=8)
    assert [c[2] for c in got] == ["一二三四五六七八九。" + "十" * 10, "十" * 10 + "\n" + "百" * 20]


def test_overlap_pairs(spark):
    rows = [("k", "chunk_0000", "abc def", "x"), ("k", "chunk_0001", "def ghi", "x"), ("k", "chunk_0002", "ghi", "y")]
    df = spark.createDataFrame(rows, "kb_name string, chunk_id string, text string, section string")
    assert chunking.overlap_pairs(df, 3).first().overlap_pairs == 1


def test_sections_reach_layout_pages(spark):
    doc = spark.createDataFrame([("k", "s", [[("title", '{"content": "第一节 释义"}')], [("text", '{"content": "正文正文"}')]])], "kb_name string, source_pdf string, pages array<array<struct<type:string,content:string>>>")
    from millrace.functions import text

    found = pages.layout_pages(doc).withColumns({"seq": F.lit(0), "section": text.guess_section(F.col("text"))})
    assert [r.section for r in pages.fill_sections(found).orderBy("page_num").collect()] == ["第一节 释义"] * 2


def test_numbers_go_on_through_a_knowledge_base_or_start_with_each_document(spark):
    rows = [(kb, s, p, 0, "text", f"{c}" * 12, c, None) for kb, s, p, c in (("k", "t", 1, "甲"), ("k", "s", 1, "乙"), ("k", "s", 2, "丙"), ("k", None, 1, "丁"), (None, "s", 1, "戊"))]
    ids = lambda by: {(r.kb_name, r.source_pdf, r.text[0]): r.chunk_id for r in chunking.build_chunks(spark.createDataFrame(rows, SCHEMA), numbered_by=by).collect()}
    want = {("k", None, "丁"): (0, 0), ("k", "s", "乙"): (1, 0), ("k", "s", "丙"): (2, 1), ("k", "t", "甲"): (3, 0), (None, "s", "戊"): (0, 0)}
    assert ids("kb_name") == {k: f"chunk_{a:04d}" for k, (a, _) in want.items()}
    assert ids("source_pdf") == {k: f"chunk_{b:04d}" for k, (_, b) in want.items()}
