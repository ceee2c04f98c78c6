"""Language models that do not fit in memory give what those in memory give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id


@pytest.fixture(scope="module")
def docs(spark):
    r = np.random.default_rng(7)
    say = lambda parts: " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(40))
    parts = {"x": ["ka", "to", "mi", "ran"], "y": ["sch", "ung", "er"]}
    rows = [(i, say(parts["x" if i % 2 else "y"]), "x" if i % 2 else "y") for i in range(200)]
    rows += [(300 + i, say(["qo", "vö", "zaq"]), "small") for i in range(4)]  # far fewer than the others
    rows += [(400, None, "x"), (401, "1 2", None), (402, "漢字 かな", None), (403, rows[0][1], "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").cache()


@pytest.mark.parametrize("cells", [0, 90])
def test_tables_give_the_same_as_memory(spark, docs, cells):
    learning = docs.where("doc_id < 400")
    here, there = language_id.learn(learning, F.lit(True)), language_id.learn(learning, F.lit(True), max_cells=cells)
    assert there.langs == here.langs == ["small", "x", "y"]
    assert there.limits == pytest.approx(here.limits, abs=1e-6)
    a, b = ({r.doc_id: r for r in language_id.identify(docs.drop("lang"), m).collect()} for m in (here, there))
    assert a.keys() == b.keys()
    for i in a:
        assert (a[i].lang_pred, a[i].score) == (b[i].lang_pred, pytest.approx(b[i].score, abs=1e-5))
        assert a[i].entropy == (None if b[i].entropy is None else pytest.approx(b[i].entropy, abs=1e-5))
    assert all(b[300 + i].lang_pred == "small" for i in range(4))


def test_small_language_among_fifty(spark):
    """Of fifty languages none is lost, whether the model lies in memory or in tables."""
    r = np.random.default_rng(5)
    letters = [chr(97 + i) for i in range(26)] + list("äöüßéèçñ")
    say = lambda parts, n: " ".join("".join(r.choice(parts, r.integers(1, 4))) for _ in range(n))
    parts = {f"l{k:02d}": ["".join(r.choice(letters, 3)) for _ in range(4)] for k in range(50)}
    rows = [(lang, say(p, 30)) for lang, p in parts.items() for _ in range(2 if lang == "l07" else 8)]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.learn(docs, F.lit(True), max_cells=20_000)
    assert isinstance(model, language_id.TableModel) and len(model.langs) == 50
    new = spark.createDataFrame([(lang, say(p, 30)) for lang, p in parts.items()], "want string, text string")
    assert all(x.lang_pred == x.want for x in language_id.identify(new, model).collect())


def test_limits_come_from_documents_left_out(spark, docs):
    """The limit of a language is the highest entropy of its left-out documents under a model of the others."""
    learning = docs.where("doc_id < 400")
    model = language_id.learn(learning, F.lit(True))
    rows = [(x.lang, x.text, x.aside) for x in learning.select("lang", "text", (F.pmod(F.xxhash64("text"), F.lit(language_id.LEFT_OUT)) == 0).alias("aside")).collect()]
    counts = {}
    for lang in model.langs:
        code = [c for c, _ in language_id.coded([t for x, t, aside in rows if x == lang and not aside])]
        counts[lang] = language_id._tally(np.concatenate(code))
    part = language_id.Model(counts)
    top: dict = {}
    for lang, text, aside in rows:
        h = part.entropies([text])[0]
        if aside and part.langs[int(h.argmin())] == lang:
            top[lang] = max(top.get(lang, 0.0), h.min())
    assert len(top) >= 2
    assert model.limits == pytest.approx([top.get(x, max(top.values())) for x in model.langs], abs=1e-9)


def test_pieces_of_a_long_text(monkeypatch):
    r = np.random.default_rng(3)
    texts = ["".join(r.choice(list("abÉ漢 .\n1ß"), 700)) for _ in range(30)] + [" " * 300, "a" * 300, ""]
    whole = [np.concatenate([np.zeros(0, np.uint64), *(c for c, _ in language_id.coded([t]))]) for t in texts]
    monkeypatch.setattr(language_id, "PIECE", 13)
    monkeypatch.setattr(language_id, "blocks", lambda off: ((i, i + 1) for i in range(len(off) - 1)))
    for t, want in zip(texts, whole, strict=True):
        assert (np.concatenate([np.zeros(0, np.uint64), *(c for c, _ in language_id.coded([t]))]) == want).all()
