"""Bounded samples: rows, not keys, are bounded; copies count once; nothing is lost where all fit."""

import random
import subprocess
import sys
from pathlib import Path

import pytest

from millrace.functions import sampling
from millrace.functions.sampling import hash_sample, one_each


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def least(spark, ids):
    return frame(spark, [(i, "") for i in ids]).orderBy(sampling.key_hash("id")).first().id


def test_a_key_that_most_rows_have(spark):
    """The key of least hash, three thousand times: it counts once, and the sample is full."""
    hot = least(spark, range(100))
    df = frame(spark, [(i, f"t{i}") for i in range(100)] + [(hot, f"copy {k}") for k in range(3000)])
    assert {r.id for r in hash_sample(df, 500, "id").collect()} == set(range(100)) and hash_sample(df, 500, "id").count() == 100
    got = hash_sample(df, 40, "id").collect()
    assert len(got) == 40 and len({r.id for r in got}) == 40 and hot in {r.id for r in got}
    for rows in (1, 2, 3):
        assert hash_sample(df, rows, "id").count() == rows
    assert hash_sample(df, 0, "id").count() == 0 and hash_sample(df.where("false"), 5, "id").count() == 0


def test_exactly_the_least_hashes(spark):
    df = spark.range(20_000).withColumnRenamed("id", "key")
    want = {r.key for r in df.orderBy(sampling.key_hash("key")).limit(777).collect()}
    assert {r.key for r in hash_sample(df, 777, "key").collect()} == want
    assert hash_sample(df, 20_000, "key").count() == hash_sample(df, 30_000, "key").count() == 20_000


def test_same_whatever_the_order_and_partitions(spark):
    r = random.Random(3)
    rows = [(i % 50, f"t{i}") for i in range(400)] + [(None, "none"), (None, "none 2")]
    one = sorted(map(str, hash_sample(frame(spark, rows), 20, "id").collect()))
    r.shuffle(rows)
    assert one == sorted(map(str, hash_sample(frame(spark, rows).repartition(7), 20, "id").collect())) and len(one) == 20


def test_one_each(spark):
    got = one_each(frame(spark, [(1, "a"), (1, "a"), (1, "b"), (2, None), (None, "c")]), "id")
    assert got.columns == ["id", "text"] and sorted(str(r.id) for r in got.collect()) == ["1", "2", "None"]
    assert one_each(frame(spark, [(1, "a"), (1, "a")]), "id", "text").count() == 1


@pytest.mark.parametrize("broken", ["corpus_pipeline", "millrace.llm.queries"])
def test_entry_without_what_llm_needs(broken):
    """Where the subpackage cannot be imported the rest stays, with a warning that says why."""
    root = Path(__file__).resolve().parent.parent
    if not (root / "millrace" / "llm" / "__init__.py").exists() or not (root / "corpus_pipeline.py").exists():
        pytest.skip("no subpackage llm")
    code = f"import sys, warnings; sys.modules[{broken!r}] = None\nimport __spark_entry__ as e\nwith warnings.catch_warnings(record=True) as w:\n    warnings.simplefilter('always'); q = e.queries()\nassert 'bm25_topk' in q and 'pipeline' not in q and 'op8_simhash' not in q; assert {broken!r} in str(w[0].message), w"
    if broken == "corpus_pipeline":
        code = code.replace("import __spark_entry__", "import importlib.util as u; f = u.find_spec; u.find_spec = lambda n, *a: object() if n == 'corpus_pipeline' else f(n, *a)\nimport __spark_entry__")
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
