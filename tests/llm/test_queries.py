"""The registered queries: SQL's rows where SQL can say them, brute force or held-out accuracy elsewhere."""

import hashlib
import math

import numpy as np
import pytest

from millrace.llm.queries import QUERIES, SEED_WORDS, SQL
from tests.compare import assert_same, database
from tests.llm import brute

LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(data):
    return database(data).execute("SELECT doc_id, text, source, lang FROM documents").fetchall()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data).toPandas(), database(data).execute(SQL[name]).df())


def test_substrings(spark, data, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op10_substrings"](spark, data).collect()}
    assert got == brute.substrings([d[:2] for d in docs])


def test_contamination(spark, data, docs):
    items = database(data).execute("SELECT item_id, text FROM benchmark").fetchall()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in QUERIES["op6_decontamination"](spark, data).collect()}
    assert got == brute.contamination([d[:2] for d in docs], items)


def test_simhash(spark, data, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_simhash"](spark, data).collect()}
    prints = {d[0]: brute.fingerprint(d[1]) for d in docs}
    root = brute.groups(prints)
    assert got == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_mixing(spark, data, docs):
    rows = QUERIES["op4_mixing"](spark, data).collect()
    again = QUERIES["op4_mixing"](spark, data).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    size = {d[0]: len(brute.SPACE_WORD.findall(d[1] or "")) for d in docs}
    source = {d[0]: d[2] for d in docs}
    total: dict = {}
    for d in docs:
        total[d[2]] = total.get(d[2], 0) + size[d[0]]
    want = brute.mixing_targets(total)
    taken = dict.fromkeys(total, 0)
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], total[s]) and 0 <= r.taken <= 2 * r.size
        assert math.isclose(r.target, want[s], rel_tol=1e-9)
        taken[s] += r.taken
    for s in total:
        assert abs(taken[s] - want[s]) <= 96, s  # three blocks of 32 words


def test_topk(spark, data):
    con = database(data)
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids = np.array([r[0] for r in rows])
    v = np.floor(256 * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(np.int64)
    want = set()
    for i in np.flatnonzero(ids % 50 == 0):
        s = v @ v[i]
        order = [k for k in np.lexsort((ids, -s)) if k != i][:5]
        want |= {(int(ids[i]), n + 1, int(ids[k]), int(s[k])) for n, k in enumerate(order)}
    assert {tuple(r) for r in QUERIES["op3_topk"](spark, data).collect()} == want


def test_urls(spark, data):
    rules = [("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"), ("net/", "block")]  # by length
    urls = dict(database(data).execute("SELECT page_id, url FROM pages").fetchall())
    seen = set()
    for r in QUERIES["op1_urls"](spark, data).collect():
        rest = urls[r.page_id].split("://", 1)[1] if "://" in (urls[r.page_id] or "") else ""
        before = rest.split("#")[0].split("?")[0]
        host, _, path = before.partition("/")
        path = "/" + path if "/" in before else ""
        assert (r.host, r.path) == (host.lower(), path)
        fit = next(((s, v) for s, v in rules if (r.host == s.split("/")[0] or r.host.endswith("." + s.split("/")[0])) and path.startswith("/" + s.split("/", 1)[1])), (None, None))
        assert r.rule == fit[0] and r.verdict == (fit[1] or r.verdict)
        if fit[0] is None:
            spam = bool(set(SEED_WORDS) & set(r.host.replace("-", ".").split(".")))
            seen.add((spam, r.verdict))
    assert seen <= {(True, "block"), (False, "allow")}


def test_chat_reads_back(spark, data):
    got = {r.conv_id: r for r in QUERIES["op7_chat"](spark, data).collect()}
    convs: dict = {-7: [("user", r"\### Assistant: </turn> ok"), ("assistant", r"\### Assistant: </turn> ok")]}
    for conv, role, text in database(data).execute("SELECT conv_id, role, text FROM conversations ORDER BY conv_id, turn").fetchall():
        convs.setdefault(conv, []).append((role, text or ""))
    assert set(got) == set(convs)
    for conv, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def held_out(spark, name, label, of):
    truth = dict(database(LARGER).execute(f"SELECT doc_id, {label} FROM {of} WHERE {label} IS NOT NULL").fetchall())
    return [(truth[r.doc_id], r) for r in QUERIES[name](spark, LARGER).collect() if r.held_out and r.doc_id in truth]


def test_quality_held_out(spark):
    pairs = held_out(spark, "op2_quality", "quality", "labels")
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for _, r in pairs)
    assert np.mean([r.predicted == y for y, r in pairs]) >= 0.95


def test_toxicity_held_out(spark):
    pairs = held_out(spark, "op9_toxicity", "toxic", "labels")
    assert all(r.predicted == (r.score >= 0.7) for _, r in pairs)
    assert not [1 for y, r in pairs if r.predicted and not y]
    assert np.mean([r.predicted for y, r in pairs if y]) >= 0.7


def test_language_held_out(spark):
    pairs = held_out(spark, "op5_language", "lang", "documents")
    assert np.mean([r.lang_pred == y for y, r in pairs]) >= 0.98


def test_pipeline(spark, data, docs, tmp_path):
    import corpus_pipeline
    from pyspark.sql import functions as F

    kept = spark.read.parquet(f"{data}/documents.parquet")
    frames = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"{k}")
        stage(spark, kept, data).write.parquet(out)
        kept = spark.read.parquet(out)
        frames.append({r.doc_id: r.asDict() for r in kept.collect()})
        if k < 4:
            assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    toxic, near, cut, clean, mixed = frames
    prints = {i: brute.fingerprint(r["text"]) for i, r in toxic.items()}
    assert set(near) == set(brute.groups(prints).values())
    want = brute.substrings([(i, r["text"]) for i, r in near.items()])
    assert {i: brute.sha(" ".join(brute.SPACE_WORD.findall(r["text"]))) for i, r in cut.items()} == {i: w[2] for i, w in want.items()}
    assert all(r["text"] == near[i]["text"] for i, r in cut.items() if want[i][1] == 0)
    bad = brute.contamination([(i, r["text"]) for i, r in cut.items()], database(data).execute("SELECT item_id, text FROM benchmark").fetchall())
    assert set(clean) == {i for i, b in bad.items() if not b[4]} == set(mixed)
    whole = corpus_pipeline.run(spark, data).select("doc_id", F.length("text").alias("n"), "taken")
    assert {tuple(r) for r in whole.collect()} == {(i, len(r["text"]), r["taken"]) for i, r in mixed.items()}
