"""Toxicity by a counterfactual-regularised classifier.

A logistic model over the words of a text and their beginnings of four to six bytes
(lower-cased; which of them occur, not how often). It is fitted on at most `max_rows`
labelled rows, chosen by a hash of their ids; among their features those count that the
labels set apart (|z| of the two shares at least MIN_Z), all of them: the sample bounds them.

Counterfactuals: where a labelled text mentions an identity term, a copy with each term
swapped for the next of its set is made, and the fit adds `fairness` times the squared
change of score between the two to its loss. Few labelled texts may mention a group at
all, so half of those that don't (by a hash of the text) also give a second sentence with
a term put in front and the text's own label, and its swapped copy. The terms' own
features are always among the model's. What only a group's mention would add to a score
is so taken out, and neutral mentions stay below the threshold. Model.pairs tells how many
pairs of either kind the penalty saw; a warning says so where there were none.

Texts are scored whole, empty and null texts by the model's bias alone. Labels of no or
one class give a model of that class's share everywhere; with no labels it is zero.
Repeated ids keep their rows; input columns with the names of the result's are replaced.
"""

from __future__ import annotations

import pickle
import re
import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sampling import hash_sample, one_each
from millrace.llm._store import keep_columns, share, small_batches, stash
from millrace.llm._text import Words, alnum_table, blocks, buffers, mix, with_columns

PREFIXES, MAX_ROWS, MIN_Z = (4, 5, 6), 12_000, 4.0
NEW = ["score", "predicted"]
#: Identity terms by set; a term is swapped for the next of its set (fixed values, replaceable).
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists"), ("muslim", "christian", "jewish", "hindu", "buddhist"),
    ("black", "white", "asian", "latino"), ("gay", "straight", "lesbian", "bisexual"), ("immigrants", "natives", "refugees"), ("disabled", "deaf", "blind", "autistic"), ("old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"), ("musulmans", "chrétiens", "juifs"), ("muslime", "christen", "juden"), ("musulmanes", "cristianos", "judíos"),
)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) for words and their beginnings; the same pair may come again."""
    doc, length = w.docs(), w.ends - w.starts
    whole, *begun = w.hashes(w.ends, *(np.minimum(w.starts + n, w.ends) for n in PREFIXES))
    found, of = [whole], [doc]
    for n, h in zip(PREFIXES, begun, strict=True):
        found.append(mix(h[length >= n] + np.uint64(n)))
        of.append(doc[length >= n])
    return np.concatenate(of), np.concatenate(found)


def _swapper(sets):
    """A function that swaps identity terms in lower-cased bytes; None where there are none."""
    following = {a.lower().encode(): b.lower().encode() for s in sets for a, b in zip(s, [*s[1:], s[0]], strict=True)}
    if not following:
        return lambda text: None
    find = re.compile(rb"(?<![a-z0-9\x80-\xff])(?:" + b"|".join(map(re.escape, sorted(following, key=len, reverse=True))) + rb")(?![a-z0-9\x80-\xff])")

    def swap(text: bytes) -> bytes | None:
        text = text.translate(alnum_table())
        return find.sub(lambda m: following[m[0]], text) if find.search(text) else None

    return swap


def _pairs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), each once, in order of documents."""
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    docs, found = [], []
    for i, j in blocks(offsets):
        d, f = features(Words(data, offsets[i : j + 1], alnum_table()))
        order = np.lexsort((f, d))
        d, f = d[order], f[order]
        new = np.concatenate(([True], (d[1:] != d[:-1]) | (f[1:] != f[:-1]))) if len(d) else np.zeros(0, bool)
        docs.append(d[new] + i)
        found.append(f[new])
    return np.concatenate([np.zeros(0, np.int64), *docs]), np.concatenate([np.zeros(0, np.uint64), *found])


def _counts(batches):
    """For each feature: labelled texts of either class that have it."""
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        doc, feature = _pairs([x.as_py() or b"" for x in batch.column("text")])
        order = np.argsort(feature, kind="stable")
        feature, one = feature[order], label[doc[order]] == 1
        cuts = np.flatnonzero(np.concatenate(([True], feature[1:] != feature[:-1]))) if len(feature) else np.zeros(0, np.int64)
        ones = np.add.reduceat(one.astype(np.int64), cuts) if len(cuts) else cuts
        all_ = np.diff(np.append(cuts, len(feature)))
        yield pa.RecordBatch.from_arrays([pa.array(feature[cuts].view(np.int64)), pa.array(ones.astype(np.int64)), pa.array((all_ - ones).astype(np.int64))], names=["feature", "ones", "zeros"])


def _known(feature: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which features are among the chosen, and their places there. A table of their leading bits spares most searches."""
    if not len(chosen):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lead = np.zeros(1 << 16, bool)
    lead[(chosen >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(lead[(feature >> np.uint64(48)).astype(np.int64)])
    place = np.minimum(np.searchsorted(chosen, feature[at]), len(chosen) - 1)
    same = chosen[place] == feature[at]
    return at[same], place[same]


def term_features(sets) -> np.ndarray:
    """The features of all identity terms."""
    terms = [t.lower().encode() for s in sets for t in s]
    return np.unique(_pairs(terms)[1]) if terms else np.zeros(0, np.uint64)


def _rows(chosen: np.ndarray, sets):
    """Labelled texts and their counterfactuals as packed places of chosen features. put: the term is not the text's own."""
    swap = _swapper(sets)
    terms = [t.lower().encode() for s in sets for t in s]

    def places(text: bytes) -> bytes:
        return np.sort(_known(_pairs([text])[1], chosen)[1]).astype(np.uint32).tobytes()

    def run(batches):
        for batch in batches:
            label, own, other, put = [], [], [], []
            for y, x in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True):
                text = x.as_py() or b""
                swapped = swap(text)
                row = [(places(text), places(swapped) if swapped is not None else None, False)]
                key = zlib.crc32(text)
                if swapped is None and terms and key % 2 == 0:
                    sentence = terms[key // 2 % len(terms)] + b" " + text
                    row.append((places(sentence), places(swap(sentence)), True))
                for a, b, c in row:
                    label.append(y)
                    own.append(a)
                    other.append(b)
                    put.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(own, pa.binary()), pa.array(other, pa.binary()), pa.array(put, pa.bool_())], names=["label", "own", "other", "put"])

    return run


def _fit(rows: list, size: int, fairness: float, decay: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias: weighted log loss, squared weights and squared counterfactual changes, by Adam over all rows."""
    rows = sorted(rows, key=lambda r: (r.label, bytes(r.own), bytes(r.other or b"")))  # the same sums whatever the order of arrival
    y = np.array([r.label for r in rows], np.float64)
    own = [np.frombuffer(r.own, np.uint32).astype(np.int64) for r in rows]
    doc, at = np.repeat(np.arange(len(rows)), list(map(len, own))), np.concatenate([np.zeros(0, np.int64), *own])
    swapped = [(o, np.frombuffer(r.other, np.uint32).astype(np.int64)) for o, r in zip(own, rows, strict=True) if r.other is not None]
    pair = np.concatenate([np.zeros(0, np.int64), *(np.full(len(a) + len(b), i) for i, (a, b) in enumerate(swapped))])
    move = np.concatenate([np.zeros(0, np.int64), *(x for a, b in swapped for x in (a, b))])
    sign = np.concatenate([np.zeros(0), *(np.concatenate((np.ones(len(a)), -np.ones(len(b)))) for a, b in swapped)])
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w, bias = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[at], len(rows)) + bias, -50, 50)))
        error = weight * (p - y)
        change = np.bincount(pair, w[move] * sign, len(swapped))
        g = np.bincount(at, error[doc], size) + decay * w + 2 * fairness / max(1, len(swapped)) * np.bincount(move, change[pair] * sign, size)
        g = np.append(g, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


class Model:
    """Sorted hashes of the chosen features, their weights, and the bias. pairs: how many counterfactual pairs held a term of their own, and how many one put in."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float, pairs: tuple[int, int] = (0, 0)):
        self.chosen, self.weights, self.bias, self.pairs = chosen, weights, bias, pairs

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        for i, j in blocks(offsets):
            doc, feature = features(Words(data, offsets[i : j + 1], alnum_table()))
            at, place = _known(feature, self.chosen)
            once = np.unique(doc[at] * max(1, len(self.chosen)) + place)
            d, f = np.divmod(once, max(1, len(self.chosen)))
            out.append(np.bincount(d, self.weights[f], j - i) if len(f) else np.zeros(j - i))
        return 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *out]) + self.bias, -50, 50)))


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int, text_col: str, id_col: str) -> DataFrame:
    """(label, text) of at most max_rows labelled rows, those of least hash of the id, one text an id (that of least hash); ids with two labels have the larger."""
    ids = labels.where(learn & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    ids = hash_sample(ids, max_rows, id_col)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"))
    return one_each(texts.join(F.broadcast(ids), id_col), id_col).select("label", "text")  # ids: at most max_rows pairs of numbers


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: Column | None = None, max_rows: int = MAX_ROWS, identity_terms=IDENTITY_TERMS, fairness: float = 1.0, decay: float = 1e-4, steps: int = 300, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """A model from at most max_rows labelled rows. learn: condition on labels' columns for rows to learn from."""
    small_batches(docs.sparkSession)
    sample = stash(bounded_sample(docs, labels, label, F.lit(True) if learn is None else learn, max_rows, text_col, id_col), "labelled")
    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(n) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 50.0 if n.get(1) else -50.0)
    a, b = n[1], n[0]
    counts = sample.mapInArrow(_counts, "feature long, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    p = (F.col("ones") + F.col("zeros")) / (a + b)
    z = (F.col("ones") / a - F.col("zeros") / b) / F.sqrt(p * (1 - p + 1e-9) * (1 / a + 1 / b))
    apart = counts.where((F.col("ones") + F.col("zeros") >= 3) & (F.abs(z) >= MIN_Z))
    chosen = apart.select("feature").toArrow().column("feature").to_numpy().view(np.uint64)  # bounded as the sample is
    chosen = np.union1d(chosen, term_features(identity_terms))
    rows = sample.mapInArrow(_rows(chosen, identity_terms), "label int, own binary, other binary, put boolean").collect()
    pairs = tuple(sum(r.other is not None and r.put == k for r in rows) for k in (False, True))
    if fairness and not sum(pairs):
        warnings.warn("no labelled text gave a counterfactual pair: the penalty has no effect", stacklevel=2)
    return Model(chosen, *_fit(rows, len(chosen), fairness, decay, steps), pairs)


def _scored(shared, text_col: str, finish):
    """finish(batch, scores) gives what a batch becomes."""

    def run(batches):
        model = pickle.loads(shared.value)
        for batch in batches:
            yield finish(batch, model.scores(*buffers(batch.column(text_col))))

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from threshold on)."""
    docs = keep_columns(docs, NEW, text_col)
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    finish = lambda batch, s: with_columns(batch, set(), {"score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})
    return docs.mapInArrow(_scored(share(docs.sparkSession, model), text_col, finish), schema)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs that the model doesn't reject, with their own columns."""
    small_batches(docs.sparkSession)
    finish = lambda batch, s: batch.filter(pa.array(s < threshold))
    return docs.mapInArrow(_scored(share(docs.sparkSession, model), text_col, finish), docs.schema)
