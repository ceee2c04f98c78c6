"""Spelling variants against all pairs of words, and the paths that large keys take."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import spelling
from millrace.llm.queries import QUERIES
from tests.compare import database

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    """Whether one edit of code points makes a and b equal."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, of=31, least_chars=7, least_n=2, ratio=10):
    n: Counter = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if of and h % of == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least_chars:
                n[run] += 1
    words = {w: c for w, c in n.items() if c >= least_n}
    others = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, own in others.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {(w, form[w], root(w), words[w], len(others[w]), words[form[w]] if form[w] else None) for w in words}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


def random_texts(seed, letters, sizes, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice(letters) for _ in range(r.choice(sizes))) for _ in range(25)]
    for _ in range(60):
        w = r.choice(words)
        k = r.randrange(len(w))
        words.append(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]]))
    weight = [30 ** (i % 4) for i in range(len(words))]
    return [" ".join(r.choices(words, weight, k=r.randint(0, 200))) + r.choice(["", "!", " x1y2 ", "\n"]) for _ in range(n)]


@pytest.mark.parametrize(("letters", "sizes"), [("ab", (7, 8, 9)), ("abcdeéÀß", (6, 7, 8, 15, 16, 17)), ("xyÿ", (7, 24, 31, 32, 33, 40))])
@pytest.mark.parametrize("tile", [512, 4])
def test_random_words(spark, monkeypatch, letters, sizes, tile):
    """With tiles of four words keys are cut down to single places."""
    monkeypatch.setattr(spelling, "TILE", tile)
    texts = random_texts(len(letters) + tile, letters, sizes)
    got = rows(spelling.group_variants(frame(spark, texts), noise=spelling.delete_one_in(31)))
    assert got == brute(list(enumerate(texts))) and any(r[1] for r in got)


def test_query_counts(spark, data):
    """The whole table's words; SQL holds the rest."""
    docs = database(data).execute("SELECT doc_id, text FROM documents").fetchall()
    got = {(r.word, r.n) for r in QUERIES["op13_spelling"](spark, data).collect()}
    n: Counter = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode())
            n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    assert got == {(w, c) for w, c in n.items() if len(w) >= 7 and c >= 2}


def test_large_group_of_one_ending(spark):
    """Hundreds of words that share all but a few letters, more than a tile holds, and a hub near to many."""
    texts = []
    for i in range(1200):
        a, b = divmod(i, 35)
        w = f"{chr(97 + a % 26)}{chr(0xE0 + b % 30)}common"
        texts += [w + " " + w]
    texts += ["xxcommon " * 400] * 3
    got = rows(spelling.group_variants(frame(spark, texts)))
    assert got == brute(list(enumerate(texts)), of=0)


def test_ties_go_to_the_smallest(spark):
    texts = ["aaaaaab " * 40, "aaaaaac " * 40, "aaaaaaé " * 40, "aaaaaad aaaaaad", "aaaaaa aaaaaa"]
    got = {r[0]: r[1:3] for r in rows(spelling.group_variants(frame(spark, texts)))}
    assert got["aaaaaad"] == ("aaaaaab", "aaaaaab") and got["aaaaaab"] == (None, "aaaaaab") and "aaaaaa" not in got


def test_chain_of_forms(spark):
    texts = ["abcdefg " * 2, "abcdefgh " * 20, "abcdefghi " * 200, "abcdefghij " * 2000, "abcdefghijk " * 20_000, "zzzzzzz " * 3]
    got = {r[0]: r[2] for r in rows(spelling.group_variants(frame(spark, texts)))}
    assert {got[w.split()[0]] for w in texts[:5]} == {"abcdefghijk"} and got["zzzzzzz"] == "zzzzzzz"


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 16)
    texts = [None, "", "   ", "Straße STRASSE straßen ÀÉÎÕÜ÷×ÿþ " * 2, "你好abcdefgh你好 abcdefgh ½abcdefgh", "longest" * 5000, "longest" * 5000, "a\u0000bcdefghi bcdefghi", "é" * 9 + " " + "é" * 9]
    df = frame(spark, texts)
    assert rows(spelling.group_variants(df)) == brute(list(enumerate(texts)), of=0)
    twice = df.unionByName(df)
    assert rows(spelling.group_variants(twice)) == brute(list(enumerate(texts)) * 2, of=0)
    no_id = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert rows(spelling.group_variants(no_id, noise=spelling.delete_one_in(3))) == brute([(None, t) for t in texts], of=3)
    names = "word n form root key n_near id text2 Form_N".split()
    assert rows(spelling.group_variants(df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)]))) == brute(list(enumerate(texts)), of=0)
    assert spelling.group_variants(df.where("false")).count() == 0


def test_tile_reads_prefixes_and_suffixes():
    r = random.Random(2)
    words = ["".join(r.choice("abé") for _ in range(r.choice((7, 8, 9, 16, 17)))) for _ in range(40)]
    a, b = (spelling._packed([w[::s].encode("latin-1") for w in words], 17) for s in (1, -1))
    p, s = (spelling._same(x[:, None], x[None]) for x in (a, b))
    for i, v in enumerate(words):
        for j, w in enumerate(words):
            k = min(len(v), len(w))
            prefix = next((x for x in range(k) if v[x] != w[x]), k)
            assert min(p[i, j], k) == prefix
            assert min(s[i, j], k) == next((x for x in range(k) if v[-1 - x] != w[-1 - x]), k)
            assert near(v, w) == (v != w and abs(len(v) - len(w)) <= 1 and prefix + int(min(s[i, j], k)) >= max(len(v), len(w)) - 1)
    assert p.dtype == np.int16
