"""Registered queries over whole texts and tables, where a shorter input gives other rows."""

import math
import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import phrases
from millrace.operators import embedding, lexical, search, understanding
from millrace.plans import catalog, latin, retrieve
from tests.compare import assert_same


@pytest.fixture
def small(spark, tmp_path):
    """Documents whose likeness lies beyond the first 80 characters, and vectors that tell nothing."""
    opening = "opening " * 12
    docs = [(0, opening + "zanzibar quagga"), (601, "zanzibar quagga"), (603, "other words"), (700, "unrelated")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 0.0], 0) for i in (0, 700)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["rrf_fuse", "hybrid_topk"])
def test_fusion_sees_all_documents_and_whole_questions(spark, small, name):
    got = {(r.query_id, r.id) for r in catalog.QUERIES[name](spark, small).collect()}
    assert (0, 601) in got  # an id of at least 500 that three does not divide, alike beyond the first 80 characters


def test_collection_keeps_long_texts(spark):
    rows = spark.createDataFrame([("a", "c", "x" * 20000 + "tail", [1.0])], "kb_name string, chunk_id string, text string, embedding array<float>")
    none = ("page_start", "page_end", "section", "source_pdf", "type", "table_index")
    rows = rows.selectExpr("*", *[f"CAST(NULL AS {'string' if c in ('section', 'source_pdf', 'type') else 'int'}) AS {c}" for c in none])
    assert embedding.collection(rows).first().text == "x" * 20000 + "tail"


@pytest.mark.parametrize("block", [200_000, 5])
def test_aliases_in_one_and_in_many_automata(spark, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_CHARS", block)
    aliases = spark.createDataFrame([("a", "华为"), ("b", "华为公司"), ("c", "-x y"), ("b2", "net"), ("a2", "net"), ("d", ""), (None, "华为公司收")], "kb_name string, alias string")
    asked = ["请问华为公司收入", "华为收入", "q-x yz", "internet", "对比华为", "", None, "none", "华为收入"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = [r.kb_name for r in understanding.resolve_kb(queries, aliases, comparison="对比").orderBy("query_id").collect()]
    assert got == ["b", "a", "c", "a2", None, None, None, None, "a"]
    assert {r.kb_name for r in understanding.resolve_kb(queries, aliases.where("false")).collect()} == {None}


def test_automaton_finds_what_contains_finds():
    r = random.Random(6)
    word = lambda n: "".join(r.choice("ab中") for _ in range(n))
    for _ in range(300):
        known = [word(r.randint(0, 5)) for _ in range(r.randint(0, 12))]
        said = word(r.randint(0, 30))
        assert set(phrases.Automaton(known).found(said)) == {i for i, k in enumerate(known) if k and k in said}


def test_thousands_of_aliases(spark):
    """Five thousand aliases in seconds, each question read once."""
    r = random.Random(7)
    names = sorted({"".join(r.choice("abcdefghij") for _ in range(r.randint(4, 9))) for _ in range(5000)})
    aliases = spark.createDataFrame([(f"kb{i % 97}", a) for i, a in enumerate(names)], "kb_name string, alias string")
    asked = [" ".join("".join(r.choice("abcdefghij") for _ in range(9)) for _ in range(15)) for _ in range(280)] + [f"about {a} now" for a in names[::50]]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string").cache()
    queries.count()
    began = time.time()
    got = {x.query_id: x.kb_name for x in understanding.resolve_kb(queries, aliases).collect()}
    took = time.time() - began
    kb = {a: f"kb{i % 97}" for i, a in enumerate(names)}
    for i, q in enumerate(asked):
        hits = [a for a in names if a in q]
        assert got[i] == (min(hits, key=lambda a: (-len(a), kb[a])) and kb[min(hits, key=lambda a: (-len(a), kb[a]))] if hits else None)
    assert took < 10, took


@pytest.mark.parametrize("block", [200_000, 3])
def test_section_tables_route_as_expressions(spark, data, monkeypatch, block):
    monkeypatch.setattr(phrases, "BLOCK_CHARS", block)
    asked = catalog.questions(spark, data).withColumn("intent", catalog.INTENT(F.col("query"))["intent"])
    keywords = spark.createDataFrame([(i, k, list(s)) for i, (k, s) in enumerate(latin.KEYWORDS.items())], "ord int, keyword string, sections array<string>")
    intents = spark.createDataFrame([(k, list(s)) for k, s in latin.BY_INTENT.items()], "intent string, sections array<string>")
    pairs = lambda df: {(r.query_id, None if r.sections is None else tuple(r.sections)) for r in df.collect()}
    one = asked.withColumn("sections", understanding.section_route(F.col("query"), F.col("intent"), latin.KEYWORDS, latin.BY_INTENT, latin.UNROUTED))
    assert pairs(understanding.section_routes(asked, keywords, intents, unrouted=latin.UNROUTED)) == pairs(one)
    every = asked.withColumn("sections", understanding.section_route_all(F.col("query"), F.col("intent"), latin.KEYWORDS, latin.BY_INTENT))
    assert pairs(understanding.section_routes(asked, keywords, intents, every=True)) == pairs(every)


def test_history_ends_before_the_question(spark):
    questions = spark.createDataFrame([(1, 9, 0, "q0"), (2, 9, 4, "q4")], "query_id int, session_id int, turn int, query string")
    history = spark.createDataFrame([(9, t, "user", f"q{t}") for t in (4, 3, 2, 1, 0, 5)], "session_id int, turn int, role string, content string")
    hits = spark.createDataFrame([], "query_id int, rank int, text string")
    got = {r.query_id: [m.content for m in r.messages] for r in search.prompt_messages(questions, hits, history, "s", before="turn").collect()}
    assert got == {1: ["s", "q0"], 2: ["s", "q0", "q1", "q2", "q3", "q4"]}


def test_vectors_that_take_no_part(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, None), (2, [1.0, None]), (3, [2.0, 1.0]), (4, [1.0]), (5, [3.0])], "id long, embedding array<float>")
    got = search.vector_topk(rows.withColumnRenamed("id", "query_id"), rows, 5).collect()
    assert {(r.query_id, r.id) for r in got} == {(a, b) for g in ((0, 3), (4, 5)) for a in g for b in g}


def test_rerank_says_what_was_not_scored(spark):
    hits = spark.createDataFrame([(1, 7, "q", "t", 0.5, 1)], "query_id long, id long, query string, text string, score double, rank int")

    def broken(pairs):
        raise RuntimeError("no model")

    assert [(r.relevance, r.scored) for r in search.rerank(hits, broken).collect()] == [(0.5, False)]
    assert [r.scored for r in search.rerank(hits, search.token_overlap).collect()] == [True]


def test_answers_from_questions(spark):
    """A question that needs clarification gets nothing; a routed one only its sections."""
    corpus = spark.createDataFrame([(1, "收入 是 很 高 的 情况", [1.0, 0.0], 3, "甲", "text", "k"), (2, "收入 情况", [0.9, 0.1], 4, "乙", "table", "k")], "id long, text string, embedding array<double>, page_start int, section string, content_type string, kb_name string")
    asked = spark.createDataFrame([(10, 1, 0, "k公司2023年收入情况是什么"), (11, 2, 0, "嗯嗯")], "query_id long, session_id long, turn int, query string")
    aliases = spark.createDataFrame([("k", "k公司")], "kb_name string, alias string")
    encode = lambda q: F.array(F.lit(1.0), F.length(q) * 0.0)
    got = retrieve.answer_sources(asked, aliases, F.lit("2024-05-01").cast("date"), corpus, encode, search.token_overlap, routing={"keywords": {"收入": ["乙"]}, "by_intent": {}}).collect()
    assert [(r.query_id, r.id, r.section, r.content_type, r.page) for r in got] == [(10, 2, "乙", "table", 4)]


def clustered(spark):
    r = np.random.default_rng(4)
    centre = r.normal(size=(60, 24))
    v = np.repeat(centre, 60, axis=0) + r.normal(size=(3600, 24)) * 0.2
    return spark.createDataFrame([(i, x.tolist(), f"k{i % 3}", f"s{i % 5}") for i, x in enumerate(v)], "id long, embedding array<float>, kb_name string, section string")


def test_stored_cells(spark, tmp_path):
    """Vectors in clusters: 16 of 128 cells find nine of ten, other cells' files are not read, and rows added later are found without another fit."""
    rows = clustered(spark)
    asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")
    pick = lambda df: {(x.query_id, x.id) for x in df.collect()}
    index = search.build_vector_index(rows.where("id % 2 = 0"), f"{tmp_path}/index")
    before = index.centres(spark)
    search.add_vectors(rows.where("id % 2 = 1"), index)
    assert (index.centres(spark) == before).all() and index.rows(spark).count() == 3600
    exact = pick(search.vector_topk(asked, rows, 10))
    assert len(exact & pick(search.ivf_ask(index, asked, 10))) >= 0.9 * len(exact)
    assert pick(search.ivf_ask(index, asked, 10, probes=128)) == exact
    one = asked.where("query_id = 500")
    scan = search.ivf_ask(index, one, 10)._jdf.queryExecution().optimizedPlan().toString()
    cells = search.nearest_cells(np.array([r.embedding for r in one.collect()]), before, 16)
    assert cells.sum() == 16
    read = index.rows(spark).where(F.col("cell").isin(np.flatnonzero(cells[0]).tolist()))
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(read) <= files(index.rows(spark)) / 4 and "cell" in scan
    filtered = asked.withColumns({"kb_name": F.lit("k1"), "section": F.when(F.col("query_id") % 200 == 0, F.array(F.lit("s0"), F.lit("s3")))})
    assert pick(search.ivf_ask(index, filtered, 10, probes=128, scope=("kb_name", "section"))) == pick(search.vector_topk(filtered, rows, 10, ("kb_name", "section")))


def test_filters_hold_before_ranking(spark):
    """Each query's own knowledge base and sections: all its k rows come from these, however far down they rank among all."""
    rows = clustered(spark)
    asked = rows.where("id % 300 = 0").select(F.col("id").alias("query_id"), "embedding", F.when(F.col("id") % 900 != 0, F.concat(F.lit("k"), (F.col("id") % 2).cast("string"))).alias("kb_name"), F.when(F.col("id") % 600 == 0, F.array(F.lit("s4"), F.lit(None))).alias("section"))
    got: dict = {}
    for r in search.vector_topk(asked, rows, 7, ("kb_name", "section")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id))
    data = [(r.id, np.array(r.embedding), r.kb_name, r.section) for r in rows.collect()]
    for q in asked.collect():
        own = [(-float(np.dot(v, np.array(q.embedding))), i) for i, v, kb, s in data if q.kb_name in (None, kb) and (q.section is None or s in q.section)]
        assert [i for _, i in sorted(got[q.query_id])] == [i for _, i in sorted(own)[:7]]


def brute_bm25(docs, queries, k):
    """docs: (id, words, kb, section); queries: (id, words, kb, sections)."""
    n, avgdl = len(docs), sum(len(d[1]) for d in docs) / len(docs)
    out = set()
    for q, words, kb, sections in queries:
        scored = []
        for i, own, a, b in docs:
            if (kb is None or a == kb) and (sections is None or b in sections):
                s = sum(math.log((n - df + 0.5) / (df + 0.5) + 1) * own.count(w) * 2.5 / (own.count(w) + 1.5 * (0.25 + 0.75 * len(own) / avgdl)) for w in words if (df := sum(w in d[1] for d in docs)) and w in own)
                if round(s, 9) > 0:
                    scored.append((-round(s, 9), i))
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_stored_postings(spark, tmp_path, monkeypatch, small):
    """An index in parts, small segments and blocks of questions: the rows of brute force, with each question's own filters."""
    if small:
        monkeypatch.setattr(lexical, "SEGMENT_DOCS", 7)
        monkeypatch.setattr(lexical, "BLOCK_QUERIES", 3)
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)]
    said = lambda: [r.choice(vocabulary[: r.choice((3, 40))]) for _ in range(r.randint(0, 30))]
    docs = [(i, said(), f"k{i % 3}", r.choice(["s1", "s2", None])) for i in range(120)]
    queries = [(1000 + i, said() + ["unknown"], r.choice([None, "k0", "k2"]), r.choice([None, ["s1"], ["s1", "s2"], []])) for i in range(14)]
    rows = spark.createDataFrame([(i, " ".join(w), k, s) for i, w, k, s in docs] + [(500, None, "k0", "s1")], "id long, text string, kb_name string, section string")
    asked = spark.createDataFrame([(i, " ".join(w), k, s) for i, w, k, s in queries], "query_id long, text string, kb_name string, section array<string>")
    index = lexical.add_documents(rows.where("id % 4 <> 1").repartition(3), f"{tmp_path}/index", scope=("kb_name", "section"))
    lexical.add_documents(rows.where("id % 4 = 1"), index.path, scope=("kb_name", "section"))
    want = brute_bm25([*docs, (500, [], "k0", "s1")], queries, 6)
    got = lexical.bm25_ask(index, asked, 6)
    assert {(x.query_id, x.id, x["rank"]) for x in got.collect()} == want
    free = [(q, w, None, None) for q, w, _, _ in queries]
    assert {(x.query_id, x.id, x["rank"]) for x in lexical.bm25_topk(asked.drop("kb_name", "section"), rows, 6).collect()} == brute_bm25([*docs, (500, [], "k0", "s1")], free, 6)
    assert lexical.bm25_ask(index, asked.where("false"), 6).count() == 0


def test_postings_that_are_not_asked_for_are_not_read(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"common word{i} other{i % 7}") for i in range(400)], "id long, text string")
    index = lexical.add_documents(rows, f"{tmp_path}/index")
    one = spark.createDataFrame([(1, "word17")], "query_id long, text string")
    got = lexical.bm25_ask(index, one, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and plan.count("Scan parquet") == 1
    assert [x.id for x in got.collect()] == [17]
    bucket = one.select(lexical.bucket_of(F.lit("word17")).alias("b")).first().b
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(index.rows(spark).where(F.col("bucket").isin(bucket, lexical.BUCKETS))) <= files(index.rows(spark)) / 8


def test_bounds_skip_segments():
    """Once a task has k good scores, segments whose best possible score is lower are not searched."""
    import pyarrow as pa

    block = pa.table({"query_id": pa.array([1]), "term": pa.array(["t"]), "weight": pa.array([1.0])})
    questions, found = lexical._Questions(block, {}), lexical._Found(1, 2)
    segment = lambda ids, tf: [{"term": lexical.OWN, "docs": np.full(len(ids), 10, np.int32).tobytes(), "id": pa.array(ids)}, {"term": "t", "docs": np.arange(len(ids), dtype=np.int32).tobytes(), "tfs": np.array(tf, np.int32).tobytes(), "most": max(tf), "shortest": 10}]
    searched = [lexical.search_segment(questions, found, segment(ids, tf), [], 1.5, 0.75, 10.0) for ids, tf in (([5, 6, 7], [3, 9, 8]), ([1, 2], [2, 1]), ([3, 4], [8, 1]))]
    assert searched == [1, 0, 1]
    rows = sorted((-s, i) for q, ids, score in found.rows for i, s in zip(ids.to_pylist(), score.tolist(), strict=True))
    assert [i for _, i in rows[:3]] == [6, 3, 7]  # 3 and 7 tie, and the smaller goes before


def test_clarification_says_what_is_asked(spark):
    asked = [(1, 1, 0, "嗯嗯"), (2, 2, 0, "营业收入是多少"), (3, 3, 0, "武汉公司2023年营收多少"), (4, 3, 1, "它2023年营收多少"), (5, 4, 0, "公司2023年营收多少"), (6, 5, 0, "k公司2023年营收多少")]
    queries = spark.createDataFrame(asked, "query_id long, session_id long, turn int, query string")
    aliases = spark.createDataFrame([("k", "k公司")], "kb_name string, alias string")
    got = {r.query_id: (r.clarification, r.clarification_prompt) for r in understanding.understand(queries, aliases, F.lit("2024-05-01").cast("date"), bases=["甲", "乙"]).collect()}
    assert got[1][0] == "unclear" and got[1][1].startswith("抱歉，我没有理解")
    assert got[2] == ("time", "您想了解哪个时间段的财务数据？比如2023年或2024年。")
    assert got[4] == ("pronoun", "您指的是武汉公司吗？")
    assert got[5] == ("company", '请问您指的是哪家公司？当前可查询以下知识库："甲"、"乙"。您可以直接说公司全称或简称。')
    assert got[6] == (None, None)


@pytest.mark.parametrize("name", ["intent", "clarify", "understand"])
def test_intents_of_accented_and_capital_texts(spark, tmp_path, name):
    """A greeting's word may end before an accented letter, and capitals beyond ASCII are letters like any: the rows of SQL."""
    said = ["Laèêèoi. Une de éoieux tionoi de queaiou", "Lañllboó. La esas esgara rros ciónesí qu", "INFORMACIÓN", "der_x. a", "der x. a", "laten. th", "VERſ the"]
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(said)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert_same(catalog.QUERIES[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.SQL[name]).df())


def test_histories_and_contexts_are_sent_once(spark):
    """Contexts and turns meet by session in one exchange; what a question takes from them is sent nowhere."""
    questions = spark.createDataFrame([(i, 9, i, f"q{i}") for i in range(4)], "query_id int, session_id int, turn int, query string")
    history = spark.createDataFrame([(9, t, "user", f"q{t}") for t in range(4)], "session_id int, turn int, role string, content string")
    hits = spark.createDataFrame([(2, 9, 2, 2, "second"), (2, 9, 2, 1, "first"), (3, 9, 3, 1, "other")], "query_id int, session_id int, turn int, rank int, text string")
    for before, own in (("turn", hits), ("turn", hits.drop("session_id", "turn")), (None, hits)):
        got = search.prompt_messages(questions, own, history, "s", before=before)
        heads = {r.query_id: [m.content for m in r.messages] for r in got.collect()}
        past = lambda i: [f"q{t}" for t in range(i if before else 4)]  # noqa: B023, E731
        assert heads == {i: [h, *past(i), f"q{i}"] for i, h in enumerate(("s", "s", "s\n\nfirst\n\nsecond", "s\n\nother"))}
        if own is hits:
            plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
            assert plan.count("Exchange") == 1, plan


def test_many_questions_share_a_segment():
    """Frequent terms by matrix product, rare ones by postings: the scores of brute force, and k rows a question."""
    import pyarrow as pa

    r = random.Random(23)
    docs = [[r.choice(["a", "b", "c", *map(str, range(300))]) for _ in range(r.randint(1, 40))] for _ in range(500)]
    terms = sorted({t for d in docs for t in d})
    weights = [(q, t, r.random()) for q in range(40) for t in r.sample(terms, 30)]
    block = pa.table({"query_id": [x[0] for x in weights], "term": [x[1] for x in weights], "weight": [x[2] for x in weights]})
    questions, found = lexical._Questions(block, {}), lexical._Found(40, 5)
    size = np.array([len(d) for d in docs], np.int32)
    post = {t: [(i, d.count(t)) for i, d in enumerate(docs) if t in d] for t in terms}
    rows = [{"term": t, "docs": np.array([i for i, _ in p], np.int32).tobytes(), "tfs": np.array([n for _, n in p], np.int32).tobytes(), "most": max(n for _, n in p), "shortest": int(min(size[i] for i, _ in p))} for t, p in post.items()]
    assert sum(len(p) >= lexical.DENSE * 500 for p in post.values()) > 3
    lexical.search_segment(questions, found, [{"term": lexical.OWN, "docs": size.tobytes(), "id": pa.array(range(1000, 1500))}, *rows], [], 1.5, 0.75, float(size.mean()))
    scores = np.zeros((40, 500))
    for q, t, w in weights:
        for i, n in post[t]:
            scores[q, i] += w * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * size[i] / size.mean()))
    got = {(int(questions.ids[int(q)].as_py()), i) for own, ids, _ in found.rows for q, i in zip(own, ids.to_pylist(), strict=True)}
    assert len(found.rows) == 1 and got == {(q, 1000 + i) for q in range(40) for i in sorted(range(500), key=lambda i: (-round(scores[q, i], 9), i))[:5]}


def test_a_task_keeps_k_rows_a_query():
    """However many batches a task reads; ties go to the smaller id."""
    r = np.random.default_rng(3)
    score, ids = r.integers(0, 50, (3000, 7)).astype(float), r.permutation(3000)
    best = search._Best(7, 4)
    for a in range(0, 3000, 100):
        best.add(ids[a : a + 100], np.arange(7), score[a : a + 100])
    query, own, _ = best.cut()
    assert [own[query == q].tolist() for q in range(7)] == [ids[np.lexsort((ids, -score[:, q]))[:4]].tolist() for q in range(7)]


def test_products_are_dealt_to_tasks(spark):
    """A corpus in one file is not one task's."""
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, embedding array<float>").coalesce(1)
    plan = search.vector_topk(rows.where("id < 3").withColumnRenamed("id", "query_id"), rows, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan, plan


def test_clarification_knows_history_and_entities(spark, tmp_path):
    """Times, companies and knowledge bases are those of the texts and of the session before, not a turn's or a session's number: the rows of SQL."""
    said = [(0, 0, "the end 7 ment"), (1, 0, "the sums and 7"), (1, 1, "thus it is and 2019"), (2, 0, "Kelton and 2019"), (2, 1, "thus it is and 2019"), (3, 0, "North 12 of th"), (3, 1, "Then 2019 and"), (3, 2, "ofth 12 of th"), (4, 5, "ofth 12 of th"), (6, 0, "ofth 12 of th")]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in said], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = catalog.QUERIES["clarify"](spark, str(tmp_path)).toPandas()
    assert_same(got, con.execute(catalog.SQL["clarify"]).df())
    reasons = dict(zip(got["query_id"], got["reason"], strict=True))
    assert reasons[1000] == "time" and reasons[2001] == "pronoun" and reasons[1001] != "pronoun"  # one digit is no time; a company was named; none was
    assert reasons[3000] == "company" and reasons[4005] == "company" and reasons[6000] == "company"  # whatever the turn and session
    assert reasons[3002] is None  # the session's knowledge base is known


@pytest.mark.parametrize("blocks", [1, 4])
def test_postings_cross_the_network_once_for_all_blocks(spark, tmp_path, monkeypatch, blocks):
    """However many blocks of questions there are, one exchange of postings by segment, to a few tasks a core, and the rows of one block."""
    r = random.Random(4)
    docs = [(i, " ".join(f"w{r.randint(1, 60)}" for _ in range(r.randint(1, 40)))) for i in range(200)]
    rows = spark.createDataFrame(docs, "id long, text string")
    asked = rows.where("id % 5 = 0").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", 30)
    index = lexical.add_documents(rows, f"{tmp_path}/index")
    want = {tuple(x) for x in lexical.bm25_ask(index, asked, 4).collect()}
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 40 // blocks)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = lexical.bm25_ask(index, asked, 4)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert {tuple(x) for x in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    sent = [int(x) for x in re.findall(r"hashpartitioning\(segment#\d+, (\d+)\)", plan)]
    assert len(sent) == 1 or blocks > 1 and "InMemoryTableScan" in plan and len({*sent}) == 1, plan
    assert max(sent) <= 4 * spark.sparkContext.defaultParallelism


def test_groups_of_like_documents_and_single_candidates_give_the_scores_of_brute_force():
    """Two languages in one segment, and a second segment that few documents of can reach the k-th score: the k best of all, in double precision."""
    import pyarrow as pa

    r = random.Random(31)
    said = lambda i, n: [f"{'xy'[i % 2]}{min(int(r.expovariate(0.02)), 400)}" for _ in range(n)]
    docs = [said(i, r.randint(1, 60)) for i in range(1200)]
    size = np.array([len(d) for d in docs], np.int32)
    weights = [(q, t, 0.2 + r.random()) for q in range(60) for t in sorted({*said(q, 30)})]
    block = pa.table({"query_id": [x[0] for x in weights], "term": [x[1] for x in weights], "weight": [x[2] for x in weights]})
    questions, found = lexical._Questions(block, {}), lexical._Found(60, 4)
    scores, kept = np.zeros((60, 1200)), set()
    for low in (0, 600):
        post: dict = {}
        for i in range(low, low + 600):
            for t in {*docs[i]}:
                post.setdefault(t, []).append((i - low, docs[i].count(t)))
        own = size[low : low + 600]
        rows = [{"term": t, "docs": np.array([i for i, _ in p], np.int32).tobytes(), "tfs": np.array([n for _, n in p], np.int32).tobytes()} for t, p in post.items()]
        lexical.search_segment(questions, found, [{"term": lexical.OWN, "docs": own.tobytes(), "id": pa.array(range(low, low + 600))}, *rows], [], 1.5, 0.75, float(size.mean()))
        for q, t, w in weights:
            for i, n in post.get(t, ()):
                scores[q, low + i] += w * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * own[i] / size.mean()))
    for own_q, ids, got in found.best():
        kept |= {(int(questions.ids[int(q)].as_py()), i, x) for q, i, x in zip(own_q, ids.to_pylist(), got.tolist(), strict=True)}
    for q in range(60):
        want = sorted(range(1200), key=lambda i: (-round(scores[q, i], 9), i))[:4]
        mine = sorted(((-x, i) for o, i, x in kept if o == q))[:4]
        assert [i for _, i in mine] == want and np.allclose([-x for x, _ in mine], scores[q, want], atol=2e-9)


def test_rows_go_to_many_questions(spark, monkeypatch):
    """Where questions are many, each meets the rows once, in a few blocks, whatever the number of tasks: the k best within its own knowledge base and sections."""
    r = np.random.default_rng(8)
    x = r.integers(-3, 4, (300, 3)).astype(float)
    corpus = spark.createDataFrame([(i, x[i].tolist() if i % 50 else None, f"k{i % 3}", f"s{i % 2}" if i % 7 else None) for i in range(300)], "id long, embedding array<double>, kb_name string, section string")
    q = r.integers(-3, 4, (200, 3)).astype(float)
    scope = lambda i: (None if i % 4 == 0 else f"k{i % 3}", (None, ["s0"], ["s0", "s1"], [])[i % 4 if i % 5 else 0])
    asked = spark.createDataFrame([(i, q[i].tolist(), *scope(i)) for i in range(200)], "query_id long, embedding array<double>, kb_name string, section array<string>")
    monkeypatch.setattr(search, "MANY", 1)
    monkeypatch.setattr(search, "PIECE", 20)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        met = search.vector_topk(asked, corpus, 4, ("kb_name", "section"))
        plan = met._jdf.queryExecution().executedPlan().toString()
        got = {(h.query_id, h.id, h["rank"]) for h in met.collect()}
        listed = asked.withColumn("kb_name", F.when(F.col("kb_name").isNotNull(), F.array("kb_name")))
        assert {(h.query_id, h.id, h["rank"]) for h in search._rows_sent(listed, corpus.where("id % 50 <> 0"), 4, ("kb_name", "section"), 3).collect()} == got
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "hashpartitioning(id" not in plan and plan.count("MapInPandas") == 1, plan
    for i in range(200):
        kb, sections = scope(i)
        fits = [j for j in range(300) if j % 50 and kb in (None, f"k{j % 3}") and (sections is None or (j % 7 and f"s{j % 2}" in sections))]
        want = sorted(fits, key=lambda j: (-float(x[j] @ q[i]), j))[:4]
        assert {(h, rank) for o, h, rank in got if o == i} == {(j, p + 1) for p, j in enumerate(want)}, i


def test_documents_of_equal_scope_share_segments(spark, tmp_path):
    """A question with filters meets few segments: documents are sorted by what questions filter by before they are cut."""
    rows = spark.createDataFrame([(i, f"word{i}", f"k{i % 4}") for i in range(400)], "id long, text string, kb_name string").repartition(4)
    index = lexical.add_documents(rows, f"{tmp_path}/index", scope=("kb_name",))
    held = [len({*r.kb_name}) for r in index.rows(spark).where(F.col("bucket") == lexical.BUCKETS).select("kb_name").collect()]
    assert sum(held) <= len(held) + 4, held
