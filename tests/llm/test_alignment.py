"""Alignment of tokenizers against a plain reading of the contract, token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment
from millrace.llm.queries import QUERIES, TOKENIZERS
from tests.compare import database

A, B = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
ODD = [
    None, "", " ", "   ", "a", "a  b\t\nc", "naïve café — déjà vu", "<s> </s> <unk> <|endoftext|> <0x41>", "▁ under", "x\u0000y", "ｆｕｌｌ ﬁ 你好，世界 🙂🙂", "don't I'll we've",
    "word " * 40_000, "z" * 3000, "\n\n\n a b c　d", "a" + " " * 500 + "b", "same text", "same text", "é" * 700, "١٢٣ ⅷ ½ x²", "a" + " " * 300_000 + "b",
]


@pytest.fixture(scope="module")
def pair():
    return alignment.load_pair(A, B)


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def spans(text, encoders):
    """(ids, ends) of A and B, or None."""
    a, b = encoders
    code = {c: x for c, x in alignment.byte_of_char().items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text, num_threads=1)
    bytes_a = [bytes(code[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    want = (" " + text).encode()
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    return (ids_a, np.cumsum([len(x) for x in bytes_a]).tolist()), (ids_b, np.cumsum([len(x) for x in bytes_b]).tolist())


def brute(docs, encoders):
    linked, told = Counter(), []
    for i, text in docs:
        got = spans(text, encoders) if text else None
        if got is None:
            told.append((i, None))
            continue
        (a, ends_a), (b, ends_b) = got
        both = sorted(set(ends_a) & set(ends_b))
        at_a, at_b = dict(zip(ends_a, a, strict=True)), dict(zip(ends_b, b, strict=True))
        links = [(at_a[e], at_b[e]) for e in both]
        linked.update(links)
        groups, low = [], 0
        for e in both:
            groups.append("|".join(",".join(str(t) for t, x in zip(ids, ends, strict=True) if low < x <= e) for ids, ends in ((a, ends_a), (b, ends_b))) if len(text) < 5000 else "")
            low = e
        told.append((i, (len(a), len(b), len(both), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    top = Counter()
    for (_, y), n in linked.items():
        top[y] = max(top[y], n)
    out = []
    for i, got in told:
        if got is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, n, links, sha = got
            out.append((i, n_a, n_b, n, len(links), sum(linked[p] == top[p[1]] for p in links), sum(linked[p] for p in links), sha))
    return out


def test_query_against_brute_force(spark, data, encoders):
    docs = database(data).execute("SELECT doc_id, text FROM documents").fetchall()
    got = QUERIES["op11_alignment"](spark, data)
    assert got.dtypes == [("doc_id", "bigint"), ("n_a", "bigint"), ("n_b", "bigint"), ("n_groups", "bigint"), ("n_links", "bigint"), ("n_best", "bigint"), ("count_sum", "bigint"), ("groups_sha256", "string")]
    want, long = brute(docs, encoders), {i for i, t in docs if t and len(t) >= 5000}
    cut = lambda rows: sorted(tuple(r)[:7] + (("",) if r[0] in long else (r[7],)) for r in rows)
    assert cut(got.collect()) == cut(want)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("joined", [False, True])
def test_odd_texts(spark, pair, encoders, monkeypatch, joined):
    if joined:
        monkeypatch.setattr(alignment, "MAX_PAIRS", 0)
    rows = {r.doc_id: tuple(r)[:7] for r in alignment.align(frame(spark, ODD), pair).select("doc_id", *[c for c in alignment.NEW]).collect()}
    want = {r[0]: r[:7] for r in brute(list(enumerate(ODD)), encoders)}
    assert rows == want
    assert all(rows[i][1] > 0 for i, t in enumerate(ODD) if t and "▁" not in t and "\u0000" not in t)


def test_small_pieces_and_blocks_give_the_same(spark, pair, monkeypatch):
    r = random.Random(5)
    texts = [" ".join(r.choice(["the", "naïve", "x1", "\n\n", "don't", "", "🙂", "of it", "12,5"]) for _ in range(r.randint(1, 400))) for _ in range(40)]
    whole = alignment.Tokens(pair)
    for t in texts:
        one = [np.concatenate(x) for x in zip(*whole.encode(t.encode()), strict=True)]
        monkeypatch.setattr(alignment, "PIECE", 7)
        cut = [np.concatenate(x) for x in zip(*whole.encode(t.encode()), strict=True)]
        monkeypatch.setattr(alignment, "PIECE", 1 << 16)
        assert all((x == y).all() for x, y in zip(one, cut, strict=True))
    x = sorted(map(tuple, alignment.align(frame(spark, texts), pair).collect()))
    blocks = [whole_row(whole, t) for t in texts]
    assert [r[-1] for r in x] == [b[-1] for b in blocks]


def whole_row(tokens, text):
    doc = alignment._Doc()
    block = alignment.Block(tokens, list(tokens.encode(text.encode())))
    doc.add(block, 0, block.written()[0])
    return doc.row()[:5]


def test_both_encoders_of_a_agree(pair):
    """The quick encoder and the file's own give the same ids over all characters that are left to the quick one."""
    tokens = alignment.Tokens(pair)
    assert tokens.quick is not None
    chars = [chr(c) for c in (*range(0x280), *range(0x2000, 0x2070)) if chr(c).isprintable() or chr(c).isspace() or c < 32 or 127 <= c < 160]
    r = random.Random(1)
    texts = ["".join(chars[i : i + 40]) for i in range(0, len(chars), 40)] + ["".join(r.choice(chars) + r.choice(["", " ", "a", "1", "'s"]) for _ in range(60)) for _ in range(1500)]
    for t in texts:
        assert not alignment.RARE.search(t.encode()) and tokens.encode_a(t, False).tolist() == tokens.encode_a(t, True).tolist(), t
    assert all(alignment.RARE.search(c.encode()) for c in "ʁΩж你🙂℀ﬁ")


def test_products_against_dense_ones():
    r = np.random.default_rng(3)
    for _ in range(20):
        x, y = r.integers(0, 3, (7, 9)) * (r.random((7, 9)) < 0.4), r.integers(0, 3, (9, 5)) * (r.random((9, 5)) < 0.4)
        csr = lambda m: alignment.Csr(np.concatenate(([0], np.cumsum((m != 0).sum(axis=1)))), np.nonzero(m)[1], m[m != 0], m.shape[1])
        got, dense = alignment.product(csr(x), csr(y)), np.zeros((7, 5), int)
        dense[got.rows, got.indices] = got.values
        assert (dense == x @ y).all()
        back = csr(x).transposed()
        dense = np.zeros((9, 7), int)
        dense[back.rows, back.indices] = back.values
        assert (dense == x.T).all()


def test_links_of_each_kind(spark, pair, encoders, monkeypatch):
    monkeypatch.setattr(alignment, "LINKED", 3)
    texts = ["unbelievably naïve tokenisation", "你好 world 🙂", None, "", "a"]
    got = {k: {(r.doc_id, r.a_pos, r.b_pos, r.a_id, r.b_id, r.shared) for r in alignment.token_links(frame(spark, texts), pair, k).collect()} for k in ("overlap", "end", "group")}
    want: dict = {k: set() for k in got}
    for d, t in enumerate(texts):
        if not t:
            continue
        (a, ends_a), (b, ends_b) = spans(t, encoders)
        both = sorted(set(ends_a) & set(ends_b))
        at = lambda e: next(i for i, x in enumerate(both) if x >= e)
        for i, (x, e) in enumerate(zip(a, ends_a, strict=True)):
            for j, (y, f) in enumerate(zip(b, ends_b, strict=True)):
                shared = min(e, f) - max(([0] + ends_a)[i], ([0] + ends_b)[j])
                row = (d, i, j, x, y, max(0, shared))
                want["overlap"] |= {row} if shared > 0 else set()
                want["end"] |= {row} if e == f else set()
                want["group"] |= {row} if at(e) == at(f) else set()
    assert got == want
    with pytest.raises(ValueError):
        alignment.token_links(frame(spark, texts), pair, "other")


def test_repeated_rows_empty_tables_and_clashing_columns(spark, pair):
    df = frame(spark, ["some text", "some text"])
    twice = alignment.align(df.unionByName(df), pair).collect()
    assert len(twice) == 4 and len({r.count_sum for r in twice}) == 1 and twice[0].count_sum == 4 * twice[0].n_links
    assert alignment.align(frame(spark, []), pair).count() == 0
    assert alignment.token_links(frame(spark, []), pair).count() == 0
    names = "N_A n_best row doc pairs times pair n best __row sha a_pos text2".split()
    got = alignment.align(df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(names)]), pair)
    assert len({c.lower() for c in got.columns}) == len(got.columns) and got.where("row = 2 and doc = 3 and times = 5 and __row = 9").count() == 2
    assert alignment.align(df.withColumn("doc_id", F.lit(None).cast("long")), pair).where("doc_id is null and n_a > 0").count() == 2
