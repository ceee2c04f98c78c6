"""Rules on small Chinese texts, with results worked out by hand."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import evaluation, search, understanding


def value(spark, column, **columns):
    kinds = ", ".join(f"{k} string" for k in columns)
    return spark.createDataFrame([tuple(columns.values())], kinds).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("第一节 释义\n正文", "第一节 释义"),
        ("1-1-1\n第二章  概览 其他", "第二章  概览"),
        ("正文很长很长\n重大事项提示", "重大事项提示"),
        ("x" * 28 + "释义", None),  # 30 characters: too long for a heading
        ("x" * 27 + "释义", "释义"),
        ("\n".join(["a"] * 10 + ["第一节 释义"]), None),  # line 11
        ("", None),
    ],
)
def test_guess_section(spark, given, want):
    assert value(spark, text.guess_section(F.col("t")), t=given) == want


def test_guess_section_skips_headers(spark):
    assert value(spark, text.guess_section(F.col("t"), header_words=["公司名"]), t="公司名 第一节 释义\n第二节 概览") == "第二节 概览"


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ("前半句\n后半句", "前半句后半句"),
        ("一句。\n" + "长" * 30, "一句。\n\n" + "长" * 30),
        ("一句。\n" + "短" * 29, "一句。" + "短" * 29),
        ("一段\n\n二段", "一段\n\n二段"),
        ("甲\n1-1-12\n1234\n乙", "甲乙"),
        ("甲\n12345\n乙", "甲12345乙"),
        ("甲\n\n12\n乙", "甲\n\n乙"),  # the blank line counts although the kept line comes later
        ("", ""),
    ],
)
def test_merge_lines(spark, given, want):
    assert value(spark, text.merge_lines(F.col("t")), t=given) == want


def test_merge_lines_header_length(spark):
    for n, kept in ((59, False), (60, True)):
        line = "头" + "x" * (n - 1)
        assert (line in value(spark, text.merge_lines(F.col("t"), header_words=["头"]), t=f"甲\n{line}")) is kept


def test_split_long(spark):
    given = "一" * 10 + "。" + "二" * 9 + "。" + "三" * 25 + "。" + "四" * 16 + "。"
    # 11 characters with the mark; ten are dropped; 25 are cut at 20 without their mark, and the five left dropped; 16 = 0.8 * 20 lose their mark
    assert value(spark, text.split_long(F.col("t"), 20), t=given) == ["一" * 10 + "。", "三" * 20, "四" * 16]


def test_tokens(spark):
    assert value(spark, text.tokens(F.col("t")), t="公司财务, a IPO2023 é的了") == ["公司", "司财", "财务", "IPO2023", "的了"]
    assert value(spark, text.tokens(F.col("t")), t="的 了 在") == []


def test_table_markdown(spark):
    cells = spark.createDataFrame([([["项目", None], [" 收入 ", "1"], [None, " "]], 0), ([], 1)], "cells array<array<string>>, i int")
    got = [r.v for r in cells.select(text.table_markdown(F.col("cells"), F.col("i")).alias("v")).collect()]
    assert got == ["[表格 1]\n项目 | \n--- | ---\n收入 | 1", ""]


def test_query_pattern(spark):
    assert value(spark, text.query_pattern(F.col("t")), t="公司的2023年营收是多少") == "公司[NUM]年营收多少"
    assert value(spark, text.query_pattern(F.col("t"), time_first=True), t="2023年12月") == "[TIME][TIME]"


@pytest.mark.parametrize(
    ("given", "want"),
    [("你好！", ("unclear", 0.3)), ("你好", ("greeting", 0.95)), ("公司净利润是多少", ("financial", 0.8)), ("公司面临哪些经营风险", ("risk", 0.8)), ("天气", ("unclear", 0.3))],
)
def test_intent(spark, given, want):
    assert tuple(value(spark, understanding.intent(F.col("q")), q=given)) == want


def test_normalize_time(spark):
    got = value(spark, understanding.normalize_time(F.col("q"), F.lit("2026-03-01").cast("date")), q="去年和前年，近期、上期")
    assert got == "2025年和2024年，最近、上一期"


@pytest.mark.parametrize(
    ("given", "intent", "want"),
    [
        ("对比甲乙公司 丙丁集团 营收", "comparison", ["对比甲乙公司的营收", "丙丁集团的营收"]),
        ("募集资金用途和发行股数多少", "business", ["募集资金用途", "发行股数多少"]),
        ("它的技术标准是什么", "business", ["它的技术标准是什么", "它的参与制定的技术标准是什么", "它的参与制定的行业技术标准是什么"]),
        ("销售部由哪些部门构成", "business", ["销售部由哪些部门构成", "销售部由哪些部门构成 下设", "销售部由哪些组织结构构成"]),
        ("公司的注册资本", "business", ["母公司（发行人）的注册资本", "公司的注册资本"]),
        ("注册资本多少", "business", ["母公司（发行人）注册资本多少", "注册资本多少"]),
        ("发行人注册资本", "business", ["发行人注册资本"]),
    ],
)
def test_decompose(spark, given, intent, want):
    assert value(spark, understanding.decompose(F.col("q"), F.lit(intent)), q=given) == want


def test_entities(spark):
    df = spark.createDataFrame([("华为公司2023年收入5亿元，增长10%",)], "query string")
    got = [(e.text, e.type, e.start, e.end) for e in understanding.entities(df).first().entities]
    assert got == [("华为公司", "COMPANY", 0, 4), ("2023年", "TIME", 4, 9), ("5亿元", "MONEY", 11, 14), ("10%", "PERCENT", 17, 20)]


def test_section_route(spark):
    q = F.col("q")
    assert value(spark, understanding.section_route(q, F.lit("business")), q="主要供应商") == ["第六节 业务与技术"]
    assert value(spark, understanding.section_route(q, F.lit("legal")), q="诉讼") == ["第五节 发行人基本情况", "第七节 公司治理与独立性", "重大事项提示"]
    assert value(spark, understanding.section_route(q, F.lit("business")), q="介绍一下供应商") is None
    assert value(spark, understanding.section_route_all(q, F.lit("x")), q="供应商与总股本") == ["第六节 业务与技术", "第三节 本次发行概况", "第五节 发行人基本情况"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"score": 1.4}', 1.0), ('x ```json\n{"score": 0.3}\n``` y', 0.3), ('says {"score": -1} ok', 0.0), ("0.8", 0.8), ("nothing", 0.0), ("about .75", 0.75), ('{"score": broken', 0.0)],
)
def test_judge_score(spark, raw, want):
    assert value(spark, evaluation.judge_score(F.col("r")), r=raw) == want


def test_bm25_repeats_and_ties(spark):
    docs = spark.createDataFrame([(2, "aa bb"), (1, "aa bb"), (3, "cc dd")], "id long, text string")
    queries = spark.createDataFrame([(1, "aa"), (2, "aa aa"), (3, "的")], "query_id long, text string")
    got = search.bm25_topk(queries, docs, 5).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert got[2].score == pytest.approx(2 * got[0].score)


def test_score_filter_keeps_first(spark):
    hits = spark.createDataFrame([(1, 1, 0.1, 1), (1, 2, None, 2), (2, 1, 0.5, 1), (2, 2, 0.2, 2), (2, 3, 0.1, 3)], "query_id int, id int, score double, rank int")
    got = sorted((r.query_id, r.id) for r in search.score_filter(hits, 0.2, 5).collect())
    assert got == [(1, 1), (2, 1), (2, 2)]
    assert search.score_filter(hits, 0, 1).count() == 5


def test_failing_reranker_keeps_order(spark):
    hits = spark.createDataFrame([(1, 1, "q", "t", 0.1, 1), (1, 2, "q", "t", 0.9, 2)], "query_id int, id int, query string, text string, score double, rank int")

    def broken(pairs):
        raise RuntimeError

    for scorer in (None, broken):
        got = search.rerank(hits, scorer, 5).orderBy("new_rank").collect()
        assert [(r.id, r.original_rank) for r in got] == [(2, 2), (1, 1)]


def test_bm25_with_a_segmenter(spark):
    @F.pandas_udf("array<string>")
    def words(x: pd.Series) -> pd.Series:
        return x.map(lambda t: [w for w in ("公司", "财务") if w in t])

    docs = spark.createDataFrame([(1, "公司的财务"), (2, "公司")], "id long, text string")
    got = search.bm25_topk(spark.createDataFrame([(1, "财务")], "query_id long, text string"), docs, 5, tokenize=words)
    assert [(r.id, r.rank) for r in got.collect()] == [(1, 1)]


def test_strip_takes_all_white_space_at_the_ends_alone(spark):
    texts = ["", " ", "\t\n\x0b\f\r a \n b \r\n", "a", None, "　a　"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.strip(F.col("t")).alias("s"))
    assert [r.s for r in got.orderBy("i").collect()] == ["", "", "a \n b", "a", None, "　a　"]
