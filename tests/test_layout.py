"""Nested block content read in the JVM, against a plain walk."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import pages


def walk(x):
    """Texts of a block's content in order: a text, each of a list, or an object's fields and its listed items' content."""
    if isinstance(x, str):
        return [x]
    if isinstance(x, list):
        return [t for v in x for t in walk(v)]
    if not isinstance(x, dict):
        return []
    listed = x.get(pages.LIST_FIELD)
    items = [i.get(pages.ITEM_FIELD) for i in listed if isinstance(i, dict)] if isinstance(listed, list) else []
    return [t for v in (*(x.get(f) for f in pages.CONTENT_FIELDS), *items) for t in walk(v)]


def content(r, depth):
    kind = r.random()
    if depth == 0 or kind < 0.2:
        return r.choice(["a", " b ", "", "中 文", 3, None, True, 1.5, 'q"uo\\te\n'])
    if kind < 0.5:
        return [content(r, depth - 1) for _ in range(r.randint(0, 4))]
    out = {f: content(r, depth - 1) for f in (*pages.CONTENT_FIELDS, "other") if r.random() < 0.4}
    if r.random() < 0.4:
        out[pages.LIST_FIELD] = r.choice([[{pages.ITEM_FIELD: content(r, depth - 1)}, "no", {"x": 1}], None, "text", []])
    return out


def test_random_content(spark):
    r = random.Random(21)
    made = [content(r, r.choice((0, 1, 2, 6, 9))) for _ in range(400)]
    made += [json.loads('{"content":[' * 20 + '"deep"' + "]}" * 20)]
    rows = [(i, json.dumps(c, ensure_ascii=bool(i % 2))) for i, c in enumerate(made)]
    df = spark.createDataFrame(rows, "id int, content string")
    got = {x.id: x.t for x in df.select("id", pages.nested_text(F.col("content")).alias("t")).collect()}
    assert got == {i: " ".join(t for t in walk(c) if t).strip(" \t\n\x0b\f\r") for i, c in enumerate(made)} and got[400] == "deep"


def test_what_is_no_json(spark):
    df = spark.createDataFrame([(0, None), (1, ""), (2, "{oops"), (3, '"x"'), (4, "7")], "id int, content string")
    assert {x.id: x.t for x in df.select("id", pages.nested_text(F.col("content")).alias("t")).collect()} == {0: "", 1: "", 2: "", 3: "x", 4: ""}


def test_too_deep_is_an_error(spark):
    df = spark.createDataFrame([('{"content":' * 30 + '"x"' + "}" * 30,)], "content string")
    assert df.select(pages.nested_text(F.col("content"), 30).alias("t")).first().t == "x"
    with pytest.raises(Exception, match="raise depth"):
        df.select(pages.nested_text(F.col("content"), 29).alias("t")).collect()


def test_pages_need_no_python(spark):
    docs = spark.createDataFrame([("k", "d", [[("text", '{"content":"a"}')]])], "kb_name string, source_pdf string, pages array<array<struct<type:string,content:string>>>")
    plan = pages.layout_pages(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and [r.text for r in pages.layout_pages(docs).collect()] == ["a"]
