"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat_format, decontaminate, language_id, mixing, quality, simhash, substring_dedup, topk, toxicity, url_filter
from tests.llm import brute

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
TEXTS = [None, "", "   \n", "one", "A b C", PASSAGE, f"x {PASSAGE} y", LONG, LONG, "a " * 5000, "é ü ß", "A b C", "!!! ???"]
#: Columns that clash with the results' names, in another case too.
CLASH = "n_words string, Score double, component_id int, taken string, lang_pred string, contaminated string, turns string, verdict int, n int, shard string, quota int, part int, root string"


def frame(spark, texts=TEXTS, clash=False):
    rows = [(i, t, ["s1", None, "s2"][i % 3]) + ((None,) * 13 if clash else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string" + (", " + CLASH if clash else ""))


def toxic_model():
    return toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), -1.0)


def operators(spark):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (None, "one"), (3, "")], "item_id long, text string")
    lang = language_id.Model({})
    return {
        "substrings": lambda df: substring_dedup.dedup_substrings(df),
        "contamination": lambda df: decontaminate.contamination(df, items),
        "drop_contaminated": lambda df: decontaminate.drop_contaminated(df, items),
        "simhash": lambda df: simhash.simhash_groups(df),
        "drop_near": lambda df: simhash.drop_near_copies(df),
        "mix": lambda df: mixing.mix(df),
        "toxicity": lambda df: toxicity.score(df, toxic_model()),
        "drop_toxic": lambda df: toxicity.drop_toxic(df, toxic_model()),
        "quality": lambda df: quality.score(df, quality.Model(0.5, None, None, None, None)),
        "language": lambda df: language_id.identify(df, lang),
        "urls": lambda df: url_filter.judge(df, [("net/", "block")], url_filter.UrlModel(None, None, "allow"), "text"),
    }


NAMES = "substrings contamination drop_contaminated simhash drop_near mix toxicity drop_toxic quality language urls".split()


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, name):
    run = operators(spark)[name]
    plain, clash = run(frame(spark)), run(frame(spark, clash=True))
    assert len({c.lower() for c in clash.columns}) == len(clash.columns)
    if not name.startswith("drop"):
        assert plain.count() == clash.count() == len(TEXTS)
    assert set(plain.columns) <= {*clash.columns, "score"}


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", [n for n in NAMES if n not in ("drop_near", "drop_toxic", "drop_contaminated")])
def test_repeated_rows_stay(spark, name):
    df = frame(spark, ["a b c", "d"])
    assert operators(spark)[name](df.unionByName(df)).count() == 4


def test_substrings_against_brute_force(spark):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(frame(spark)).collect()}
    assert got == brute.substrings(list(enumerate(TEXTS)))


def test_substrings_of_rows_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "row_hash", lambda columns: F.coalesce(F.length(columns[1]), F.lit(0)).cast("long") % 3)
    texts = [f"{PASSAGE} a", f"{PASSAGE} b c", "d " * 40, "x y z", None, f"q {PASSAGE}", *("u v w " * k for k in range(12))]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(frame(spark, texts)).collect()}
    assert got == brute.substrings(list(enumerate(texts)))


@pytest.mark.parametrize("name", ["substrings", "simhash", "quality", "language", "mix", "toxicity", "contamination"])
def test_columns_named_like_inner_ones(spark, name):
    names = "text2 __text __key __marks __print __root __chars __doc __sha __row doc print root key row id end start order sizes other lang2 label"
    df = frame(spark, ["a b c", None, PASSAGE, PASSAGE]).select("*", *[F.lit(i).alias(c) for i, c in enumerate(names.split())])
    got = operators(spark)[name](df)
    assert got.count() == 4 and len(set(got.columns)) == len(got.columns) and set(names.split()) <= set(got.columns)
    assert got.where("__key = 2 and __text = 1 and id = 15 and doc = 10").count() == 4


@pytest.mark.parametrize(("window", "period"), [(8, 7), (15, 13), (35, 7), (35, 21), (40, 31)])
def test_substrings_random(spark, window, period):
    r = np.random.default_rng(window)
    texts = []
    for _ in range(60):
        parts = [" ".join(map(str, r.integers(0, 50, r.integers(1, 60)))) for _ in range(3)]
        texts.append("  ".join([*parts, texts[r.integers(len(texts))] if texts and r.random() < 0.6 else ""]))
    got = substring_dedup.dedup_substrings(frame(spark, texts), window, period)
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in got.collect()} == brute.substrings(list(enumerate(texts)), window)


def test_hashes_do_not_depend_on_where_words_lie(monkeypatch):
    from millrace.llm import _text

    texts = [f"w{i % 50} " * (i % 7) + "long" * (i % 90) for i in range(200)]
    data, off = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    want = _text.Words(data, off, _text.space_table()).hashes()[0]
    monkeypatch.setattr(_text, "BLOCK_BYTES", 8)
    w = _text.Words(data, off, _text.space_table())
    assert (w.hashes()[0] == want).all() and len(want) == sum(len(t.split()) for t in texts)
    by_word: dict = {}
    for word, h in zip((x for t in texts for x in t.split()), want.tolist(), strict=True):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_substrings_keep_spacing(spark):
    texts = [f"keep  this\n{PASSAGE}\n and   that", f"other {PASSAGE}"]
    got = [r.text for r in substring_dedup.dedup_substrings(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["keep  this\nand   that", "other "]


def test_repeated_row_is_a_repeat(spark):
    df = frame(spark, [PASSAGE])
    assert [r.n_removed for r in substring_dedup.dedup_substrings(df.unionByName(df)).collect()] == [60, 60]
    assert [r.n_removed for r in substring_dedup.dedup_substrings(df).collect()] == [0]


def test_contamination_short_items_and_passes(spark):
    items = [(1, "one"), (2, "b c"), (3, PASSAGE), (None, "é"), (4, "zz !"), (3, "p58 p59 y")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(list(enumerate(TEXTS)), items)
    for most in (1 << 25, 20):  # one pass, and several
        got = decontaminate.contamination(frame(spark), bench, max_patterns=most)
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == want
        left = decontaminate.drop_contaminated(frame(spark), bench, max_patterns=most)
        assert {r.doc_id for r in left.collect()} == {i for i, w in want.items() if not w[4]}


def test_contamination_long_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    items = [(1, PASSAGE), (2, "é ü " + PASSAGE), (2, "é ü " + PASSAGE), (3, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(list(enumerate(TEXTS)), items)
    for most in (1 << 25, 15):
        got = decontaminate.contamination(frame(spark), bench, max_patterns=most)
        assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()} == want


def test_contamination_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.contamination(frame(spark), bench).where("contaminated").count()


def test_wu_manber_random():
    r = np.random.default_rng(5)
    for _ in range(40):
        letters = "ab" if r.random() < 0.5 else "abcdefgh"
        word = lambda: "".join(r.choice(list(letters), r.integers(1, 6)))  # noqa: E731, B023
        items = [(str(i), " ".join(word() for _ in range(r.integers(1, 20)))) for i in range(6)]
        texts = [" ".join([word() for _ in range(r.integers(0, 40))] + ([items[0][1]] if r.random() < 0.5 else [])) for _ in range(8)]
        tables = decontaminate.build([(i, t.encode()) for i, t in items], 5)
        found = decontaminate._hits(tables, [decontaminate.normal(t.encode()) for t in texts])
        got = {i: (n, len(h), len(x)) for i, (n, h, x) in enumerate(found)}
        assert got == {i: w[:3] for i, w in brute.contamination(list(enumerate(texts)), items, 5).items()}


def near(prints, r, n=40):
    base = r.integers(0, 2**63, 3, dtype=np.uint64)
    return np.unique(np.concatenate([prints, *(b ^ (np.uint64(1) << r.integers(0, 64, (n, 1), dtype=np.uint64)).ravel() ^ (np.uint64(1) << r.integers(0, 64, n, dtype=np.uint64)) for b in base)]))


@pytest.mark.parametrize("crowd", [4096, 3])
def test_links_join_what_brute_force_joins(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)  # 3: crowds are dealt again by bytes
    r = np.random.default_rng(7)
    prints = near(r.integers(0, 2**63, 50, dtype=np.uint64), r)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    edges = simhash.links(df).collect()
    as_int = lambda x: x & (2**64 - 1)
    assert all((as_int(e.a) ^ as_int(e.b)).bit_count() <= 3 for e in edges)
    roots = {x.node: x.root for x in simhash.components(simhash.links(df)).collect()}
    want = brute.groups({int(x): int(x) for x in prints})
    got: dict = {}
    for x in prints:
        got.setdefault(roots.get(int(x.view(np.int64)), int(x.view(np.int64))), set()).add(int(x))
    parts: dict = {}
    for x, g in want.items():
        parts.setdefault(g, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, parts.values()))
    assert any(len(g) > 5 for g in parts.values())


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(chain).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_fingerprints_of_no_words_are_zero(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(frame(spark)).collect()}
    assert got[0] == got[1] == got[2] == ("0" * 16, 0)
    assert {i: int(f, 16) for i, (f, _) in got.items()} == {i: brute.fingerprint(t) for i, t in enumerate(TEXTS)}


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(5, "same text here"), (3, "same text here"), (3, "same text here"), (None, "same text here"), (None, "alone as can be")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.drop_near_copies(df).collect()), key=str) == [(3, "same text here"), (None, "alone as can be")]


def test_mixing_without_words(spark):
    got = mixing.mix(frame(spark, [None, "", " "])).collect()
    assert all((r.size, r.target, r.taken) == (0, 0.0, 0) for r in got)


def test_sainte_lague(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 0, None: 10}
    df = spark.createDataFrame([(k, v, 7) for k, v in votes.items()], "source string, votes long, seats long")
    got = {r.source: r.quota for r in mixing.apportion(df, "votes", "seats", [], ["source"]).collect()}
    order = sorted(((-v / (2 * k - 1), s is None, s or "", k) for s, v in votes.items() for k in range(1, 9) if v))[:7]
    want = dict.fromkeys(votes, 0)
    for _, none, s, _ in order:
        want[None if none else s] += 1
    assert got == want


def test_mixing_in_many_shards(spark):
    r = np.random.default_rng(1)
    rows = [(i, "w " * int(r.integers(0, 400)), "big" if i % 3 else f"s{i % 5}") for i in range(900)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows_per_shard=50).collect()
    for s in {x[2] for x in rows}:
        own = [x for x in got if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 32 * 2 * (1 + len(own) / 50) and all(x.taken <= 2 * x.size for x in own)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_topk_ties_nulls_and_shards(spark):
    r = np.random.default_rng(2)
    v = np.floor(r.normal(size=(400, 6)) * 2) / 4
    v[100:200] = v[0]  # many equal vectors
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)]
    odd = [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (1050, [0.5, 0.25]), (1100, [1.0, 1.0])]
    whole = np.floor(256 * v).astype(np.int64)
    want = set()
    for i in range(0, 400, 50):
        s = whole @ whole[i]
        want |= {(i, n + 1, int(k), int(s[k])) for n, k in enumerate([k for k in np.lexsort((np.arange(400), -s)) if k != i][:5])}
    want |= {(1050, 1, 1100, 128 * 256 + 64 * 256), (1100, 1, 1050, 128 * 256 + 64 * 256)}
    for shard, block in ((8192, 4096), (60, 3), (20, 1)):
        got = topk.top_k(vectors(spark, rows + odd), F.col("vec_id") % 50 == 0, shard_rows=shard, query_rows=block)
        assert {tuple(x) for x in got.collect()} == want
    assert topk.top_k(vectors(spark, []), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_leaves_out_what_no_bound_reaches(spark):
    """Clusters that lie apart: the answer is brute force's, though most pairs of query and shard never meet."""
    r = np.random.default_rng(8)
    centre = np.eye(12) * 4
    v = np.floor((np.repeat(centre, 50, axis=0) + r.normal(size=(600, 12)) * 0.05) * 64) / 64
    whole, report = np.floor(256 * v).astype(np.int64), {}
    got = topk.top_k(vectors(spark, [(i, x.tolist()) for i, x in enumerate(v)]), F.col("vec_id") % 50 == 0, shard_rows=25, report=report)
    want = set()
    for i in range(0, 600, 50):
        s = whole @ whole[i]
        want |= {(i, n + 1, int(k), int(s[k])) for n, k in enumerate([k for k in np.lexsort((np.arange(600), -s)) if k != i][:5])}
    assert {tuple(x) for x in got.collect()} == want
    assert report["searched"] < 0.5 * report["pairs"], report


def test_topk_repeated_ids_and_clashing_columns(spark):
    rows = [(0, [1.0, 0.0], 1, 2), (0, [0.5, 0.0], 1, 2), (1, [1.0, 1.0], 1, 2), (2, [2.0, 0.0], 1, 2), (1, [1.0, 1.0], 1, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, cell int")
    got = topk.top_k(df, F.col("vec_id") == 0, k=2).collect()
    assert [tuple(x) for x in got] == [(0, 1, 2, 128 * 512), (0, 2, 1, 128 * 256)]  # the smallest vector of id 0 asks


def test_topk_large_components(spark):
    rows = [(0, [1e7, 1.0]), (50, [1e7, -1.0]), (3, [1e7, 2.0])]
    got = topk.top_k(vectors(spark, rows), F.col("vec_id") == 0).collect()
    assert [(r.vec_id, r.score) for r in got] == [(3, 2560000000**2 + 256 * 512), (50, 2560000000**2 - 256 * 256)]


def test_chat_layouts(spark):
    df = spark.createDataFrame(
        [
            (1, "hi", None, None, None, [], None),
            (2, None, "do", "this", "done", None, None),
            (3, None, "do", None, "done", None, None),
            (4, None, None, None, None, [("user", "a<b"), ("assistant", None)], None),
            (5, None, None, None, None, None, [("human", "q"), ("gpt", "\\l </turn>")]),
            (6, None, None, None, None, None, None),
        ],
        "id int, prompt string, instruction string, input string, output string, messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>",
    )
    got = {r.id: r for r in chat_format.format_records(df, ["prompt", "instruction", "input", "output", "messages", "conversations"]).collect()}
    assert {i: r.layout for i, r in got.items()} == {1: None, 2: "instruction_input", 3: "instruction", 4: "messages", 5: "conversations", 6: None}
    assert [tuple(t) for t in got[4].turns] == [("user", "a<b"), ("assistant", "")] and got[6].formatted is None
    back = chat_format.format_records(df, ["prompt", "instruction", "input", "output", "messages", "conversations"]).where("id = 5")
    r = back.select(chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).first()
    assert [tuple(t) for t in r.t] == [("user", "q"), ("assistant", "\\l </turn>")] and r.l == "\\l </turn>"


def test_chat_roles_and_texts_round_trip(spark):
    odd = ["", "<", ">", "\\", "\\b", "\\\\l", "</turn>", "<turn assistant>", "a\nb", "é𝄞", "\\b<\\l>\\g"]
    rows = [(i, [(role, text) for role in ("assistant", text)]) for i, text in enumerate(odd)]
    df = spark.createDataFrame(rows, "id int, turns array<struct<role:string,text:string>>")
    x = chat_format.format_turns(df).select("id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l"))
    for r in x.collect():
        assert [tuple(t) for t in r.t] == rows[r.id][1] and r.l == odd[r.id]


def test_urls_by_hand(spark):
    rows = [("http://A.Net", "a.net", "", None), ("http://a.net/x", "a.net", "/x", "net/"), ("http://b.example.net/en/?q", "b.example.net", "/en/", "example.net/en/"), ("x.net/en", "", "", None), (None, "", "", None), ("ftp://org?/fr/", "org", "", None), ("://net/#", "net", "/", "net/")]
    df = spark.createDataFrame([(r[0],) for r in rows], "url string")
    got = url_filter.judge(df, [("net/", "block"), ("example.net/en/", "allow"), ("org/fr/", "allow")], url_filter.UrlModel(None, None, "allow")).collect()
    assert [(r.url, r.host, r.path, r.rule) for r in got] == rows


def test_url_model_without_labels(spark):
    none = spark.createDataFrame([], "url string, label int")
    assert url_filter.fit(none).always == "allow"
    assert url_filter.fit(spark.createDataFrame([("http://a", 1)], "url string, label int")).always == "block"


def test_toxicity_swaps_identity_terms(spark):
    words = [f"w{i}" for i in range(40)]
    r = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        own = [*r.choice(words, 12), *(["vilestuff"] if toxic else [])]
        if r.random() < (0.8 if toxic else 0.05):
            own.append("women")  # labels lean on a group's name
        rows.append((i, " ".join(r.permutation(own))))
        labels.append((i, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    probe = spark.createDataFrame([(0, "w1 w2 women w3"), (1, "w1 w2 vilestuff w3"), (2, "w1 w2 men w3"), (3, None)], "doc_id long, text string")

    def scores(fairness):
        model = toxicity.train(docs, marks, fairness=fairness)
        return {x.doc_id: x.score for x in toxicity.score(probe, model).collect()}

    plain, fair = scores(0.0), scores(10.0)
    moved = lambda s: abs(np.log(s[0] / (1 - s[0])) - np.log(s[2] / (1 - s[2])))
    assert moved(plain) > 1 and moved(fair) < 0.3
    assert fair[1] > 0.7 and fair[0] < 0.5 and 0 <= fair[3] <= 1


def test_models_of_one_class(spark):
    docs = frame(spark, ["a", "b"])
    one = spark.createDataFrame([(0, 1, 1)], "doc_id long, toxic int, quality int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.train(docs, one)).collect()] == [1, 1]
    assert [r.score for r in quality.score(docs, quality.train(docs, one)).collect()] == [1.0, 1.0]
    none = one.where("false")
    assert [r.score for r in quality.score(docs, quality.train(docs, none)).collect()] == [0.0, 0.0]


def test_factorisation_identity():
    r = np.random.default_rng(4)
    size = quality.BUCKETS + quality.STATS
    m = quality.Model(0.3, r.normal(size=size), r.normal(size=(size, 3)), np.zeros(quality.STATS), np.ones(quality.STATS))
    bucket, value, stats = np.array([5, 17]), np.array([0.6, 0.8]), r.uniform(-1, 1, (1, quality.STATS))
    x = np.zeros(size)
    x[bucket], x[quality.BUCKETS :] = value, stats[0]
    pairs = sum(m.factors[i] @ m.factors[j] * x[i] * x[j] for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)
    assert m.logits(1, np.zeros(2, int), bucket, value, stats)[0] == pytest.approx(0.3 + m.weights @ x + pairs)


def test_kneser_ney_sums_to_one():
    text = "the cat sat on the mat and the rat ate the cat"
    code, *_ = language_id.codes([text])
    seen, n = language_id._tally(code)
    symbols = np.unique(code & np.uint64(0xFFFF))
    model = language_id.KneserNey(seen, n, len(symbols))
    for context in np.unique(code >> np.uint64(16))[:20]:
        assert model((context << np.uint64(16)) | symbols).sum() == pytest.approx(1.0)


def test_languages_and_rejection(spark):
    r = np.random.default_rng(6)
    say = lambda parts: " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(60))
    rows = [(i, say(["ka", "to", "mi"]), "x") if i % 2 else (i, say(["sch", "ung", "er"]), "y") for i in range(200)] + [(900, None, "x"), (901, "1 2", None), (902, "漢字 かな", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs.where("doc_id < 900"), F.col("doc_id") % 5 != 0)
    got = {x.doc_id: x for x in language_id.identify(docs.drop("lang"), model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows[:200])
    assert [got[i].lang_pred for i in (900, 901)] == ["und", "und"] and got[902].lang_pred in ("x", "y") and got[902].rejected
    assert np.mean([got[i].rejected for i in range(200)]) < 0.05


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and repeated rows and extra columns pass through every stage; so does an empty table."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, __row string, print int, key int"
    rows = [(i, t, None, ["s1", None][i % 2], None, "x", 1, 2) for i, t in enumerate(TEXTS)] + [(1, "", None, None, None, "x", 1, 2), (None, PASSAGE, "en", "s1", 9, None, 1, 2), (None, None, None, None, None, None, None, None)]
    marks = spark.createDataFrame([(i, i % 2, int(i == 7)) for i in range(9)], "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "p1 p2 p3"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, given in enumerate((rows, [])):
        kept = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = f"{tmp_path}/{k}-{name}"
            stage(spark, kept, str(tmp_path)).write.parquet(out)
            kept = spark.read.parquet(out)
            assert kept.columns[:8] == ["doc_id", "text", "lang", "source", "n_chars", "__row", "print", "key"], name
        assert (kept.count() > 0) == bool(given)


def test_tables_are_released(spark, data):
    import os

    import corpus_pipeline
    from millrace.llm._store import stashed

    before = set(stashed(spark))
    got = corpus_pipeline.run(spark, data)
    n = got.count()
    left = [p for p in stashed(spark) if p not in before]
    assert n > 0 and sum("mix" not in p for p in left) == 1  # the last stage's input
    assert all(os.path.isdir(p.removeprefix("file:")) for p in left)


def test_loss_mask_of_a_long_conversation(spark):
    turns = [("assistant" if i % 3 else "user", f"t<{i}>" * (i % 5)) for i in range(1500)]
    df = spark.createDataFrame([(1, turns), (2, []), (3, None)], "id int, turns array<struct<role:string,text:string>>")
    x = chat_format.format_turns(df).select("id", "loss_mask", chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l"))
    got = {r.id: r for r in x.collect()}
    assert got[1].l == "".join(t for r, t in turns if r == "assistant") and got[2].loss_mask == [] and got[3].loss_mask is None


def test_large_crowds_are_not_compared_pair_by_pair(monkeypatch):
    """Crowds beyond CROWD are parted again and again; what is linked stays linked, and 10,000 unlinked members cost no pairs."""
    r = np.random.default_rng(8)
    base = r.integers(0, 2**32, 30, dtype=np.uint64)
    prints = np.unique(np.concatenate([base, *[base ^ np.uint64(1 << int(a) | 1 << int(b)) for a, b in r.integers(0, 32, (12, 2))], r.integers(0, 2**12, 200, dtype=np.uint64)]))
    roots = lambda edges: brute.components([int(p) for p in prints], edges)
    linked = [(int(a), int(b)) for i, a in enumerate(prints) for b in prints[i + 1 :] if int(a ^ b).bit_count() <= 3]
    for crowd in (3, 50, 4096):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        edges = simhash._forest(prints, 3)
        assert set(edges) <= {*linked, *((b, a) for a, b in linked)} and roots(edges) == roots(linked) and len(edges) < len(prints)
    monkeypatch.setattr(simhash, "CROWD", 64)
    compared = []
    plain = simhash._links
    monkeypatch.setattr(simhash, "_links", lambda a, b, bits: compared.append(len(a)) or plain(a, b, bits))
    apart = np.unique(r.integers(0, 2**32, 10_000, dtype=np.uint64))
    simhash._forest(apart, 3)
    assert sum(compared) < 100 * len(apart)


def test_cells_grow_with_the_table():
    grown = [topk.cells_for(n) for n in (0, 1, 8192, 50_000, 4_000_000, 10**8, 10**9, 10**11, 10**13)]
    assert grown == [1, 1, 1, 7, 256, 1250, 3952, 8192, 8192]


def test_chat_rows_that_are_odd(spark):
    """Null conversations are one conversation, null roles and texts are empty, an empty table gives none, and callers' columns stay."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (None, 0, None, "x"), (None, 0, "user", ""), (2, None, "assistant", "</turn> \\"), (2, None, "assistant", "</turn> \\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    layout = ["system", "prompt", "response", "messages"]

    def read(x):
        done = chat_format.format_records(x, layout)
        return done, {r.conv_id: ([(t.role, t.text) for t in r.t], r.l) for r in done.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.read_loss(F.col("formatted"), F.col("loss_mask")).alias("l")).collect()}

    records = chat_format.records_of(df)
    _, got = read(records)
    assert got == {1: ([("user", "hi"), ("assistant", "")], ""), None: ([("", "x"), ("user", "")], ""), 2: ([("assistant", "</turn> \\")] * 2, "</turn> \\" * 2)}
    done, same = read(records.select("*", *[F.lit(i).alias(c) for i, c in enumerate("Layout turns formatted LOSS_MASK __length __blocks __begin".split())]))
    assert same == got and len({c.lower() for c in done.columns}) == len(done.columns)
    assert chat_format.format_records(chat_format.records_of(df.where("false")), layout).count() == 0
