"""Segmentation against all paths, and a dictionary learnt from a corpus."""

import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions import segment, text
from millrace.operators import lexical


def paths(run, longest):
    if not run:
        yield []
    for k in range(1, min(longest, len(run)) + 1):
        for rest in paths(run[k:], longest):
            yield [run[:k], *rest]


def test_best_of_all_paths():
    r = random.Random(4)
    for _ in range(200):
        counts = {"".join(r.choice("中国人民") for _ in range(r.randint(1, 3))): r.randint(1, 50) for _ in range(12)}
        words, run = segment.Words(counts), "".join(r.choice("中国人民大") for _ in range(r.randint(1, 8)))
        cost = lambda p, w=words: sum(w.cost.get(x, w.unknown if len(x) == 1 else -math.inf) for x in p)
        got = words.split(run)
        assert "".join(got) == run and cost(got) == pytest.approx(max(map(cost, paths(run, words.longest))))


def test_tokens_of_mixed_texts(spark):
    words = spark.createDataFrame([("公司", 50), ("收入", 40), ("公司收入", 1), ("的", 90), ("高", 3), ("增长", 20)], "word string, n long")
    rows = spark.createDataFrame(list(enumerate(["公司收入的增长2023年 growth Rate x", "", None, "é 很高高", "公司"])), "id int, text string")
    got = {r.id: r.w for r in rows.select("id", segment.segmenter(words)(F.col("text")).alias("w")).collect()}
    assert got == {0: ["公司", "收入", "增长", "2023", "growth", "Rate"], 1: [], 2: None, 3: [], 4: ["公司"]}


def test_without_cjk_it_gives_the_plain_tokens(spark, data):
    words = spark.createDataFrame([("公司", 50)], "word string, n long")
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(50)
    got = docs.select(segment.segmenter(words)(F.col("text")).alias("a"), text.tokens(F.col("text")).alias("b"))
    assert got.where("a <> b").count() == 0


def test_learnt_words(spark):
    """Words that occur together more often than by chance, and no others; hot sequences are rows like any."""
    r = random.Random(5)
    real = ["蝴蝶", "葡萄", "徘徊", "巧克力"]
    single = list("的是了在有我他这中大来上国")
    rows = [(i, "".join(r.choice(real) if r.random() < 0.4 else r.choice(single) for _ in range(40))) for i in range(200)] + [(999, None), (1000, "latin only")]
    docs = spark.createDataFrame(rows, "id int, text string")
    learnt = {x.word: x.n for x in segment.learn_words(docs).collect()}
    assert set(real) <= set(learnt) and learnt["蝴蝶"] == sum((t or "").count("蝴蝶") for _, t in rows)
    assert not {w for w in learnt if len(w) == 2 and w[0] in single and w[1] in single}
    cut = segment.segmenter(segment.learn_words(docs), ())
    assert spark.createDataFrame([("我在葡萄上徘徊",)], "text string").select(cut(F.col("text")).alias("w")).first().w == ["葡萄", "徘徊"]
    asked = spark.createDataFrame([(1, "蝴蝶")], "query_id long, text string")
    hits = lexical.bm25_topk(asked, docs.select(F.col("id").cast("long").alias("id"), "text"), 3, tokenize=cut)
    assert hits.count() == 3 and segment.learn_words(docs.where("false")).count() == 0


def test_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(segment, "MAX_WORDS", 2)
    with pytest.raises(ValueError):
        segment.segmenter(spark.createDataFrame([("一", 1), ("二", 1), ("三", 1)], "word string, n long"))


def test_sequences_are_counted_as_numbers(monkeypatch):
    """Every sequence of a text's runs, none across a gap, however little a task holds; a frequent one is a row and not one an occurrence."""
    r = random.Random(8)
    texts = [None, "", "latin", *["".join(r.choice("一中国龥人ab，\n") for _ in range(r.randint(0, 60))) for _ in range(200)]]
    want = Counter(run[i : i + k] for t in texts if t for run in segment.CJK_RUN.findall(t) for k in range(1, 5) for i in range(len(run) - k + 1))
    for chunk, held in ((1 << 21, 1 << 21), (50, 1 << 21), (50, 40)):
        monkeypatch.setattr(segment, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(segment, "HELD_CODES", held)
        got, rows = Counter(), 0
        for f in segment._counted(4)(iter([pd.DataFrame({"text": texts[:90]}), pd.DataFrame({"text": texts[90:]})])):
            rows += len(f)
            got.update(dict(zip(f["word"], f["n"].tolist(), strict=True)))
        assert got == want and rows < sum(want.values()) / (5 if held > 40 else 1)


def test_sequences_are_counted_once(spark, monkeypatch):
    """The counts are written and read back for the total, the words and their parts."""
    named = []
    monkeypatch.setattr(segment, "stash", lambda df, name: named.append(name) or df.localCheckpoint())
    docs = spark.createDataFrame([(1, "蝴蝶的蝴蝶" * 9)], "id int, text string")
    assert {x.word for x in segment.learn_words(docs).collect()} >= {"蝴", "蝶", "的"} and named == ["sequences"]
