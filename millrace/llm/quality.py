"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text: its words, lower-cased, hashed to BUCKETS and counted, scaled to unit
length; statistics of its structure (kinds of characters, repeated marks, lengths of words
and lines, repetition); and, where the table has it, the recorded number of characters. A
score is the logistic of b + w·x + the sum over pairs <v_i, v_j> x_i x_j, the pairs taken
in linear time as half of |sum v_i x_i|^2 - sum |v_i x_i|^2.

It is fitted on at most `max_rows` labelled rows, chosen by a hash of their ids and one text
an id, by Adam over batches of them in a seeded order. Statistics are standardised by the sample's means and deviations.

Texts are scored whole; null and empty texts have no words and all statistics at zero.
Labels of no or one class give that class's share as every score. Repeated rows are scored
alike; input columns with the names of the result's are replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.sampling import hash_sample, one_each
from millrace.llm._store import keep_columns, share, small_batches, stash
from millrace.llm._text import Words, alnum_table, blocks, buffers, with_columns

BUCKETS, FACTORS, MAX_ROWS, PASSES = 4096, 8, 8000, 6
NEW = ["score", "predicted"]
#: Kinds of bytes: upper, lower, digit, white space, mark, beyond ASCII.
KINDS = np.array([3 if b in (9, 10, 11, 12, 13, 32) else 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 5 if b >= 128 else 4 for b in range(256)])
STATS = 18


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[off[1:]] - total[off[:-1]]).astype(np.float64)


def featurise(data: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For documents side by side: (document, bucket, value) of words, and a row of statistics for each document. chars: recorded lengths, NaN if unknown."""
    w = Words(data, offsets, alnum_table())
    n, doc = len(w.counts), w.docs()
    once, count = np.unique(doc * BUCKETS + (w.hashes()[0] >> np.uint64(52)).astype(np.int64), return_counts=True)
    d, bucket = np.divmod(once, BUCKETS)
    norm = np.sqrt(np.bincount(d, count.astype(np.float64) ** 2, n))
    value = count / norm[d] if len(d) else np.zeros(0)
    raw, off = w.raw, w.off
    size = np.maximum(np.diff(off), 1)
    kind = KINDS[raw]
    shares = [_per_doc(kind == k, off) / size for k in range(6)]
    again = np.zeros(len(raw), bool)
    again[1:] = (raw[1:] == raw[:-1]) & (kind[1:] == 4)
    lines = _per_doc(raw == 10, off) + 1
    words = np.maximum(w.counts, 1)
    length = (w.ends - w.starts).astype(np.float64)
    mean = np.bincount(doc, length, n) / words
    stats = [
        np.log1p(np.diff(off)), *shares, _per_doc(again, off) / size, np.log(size / lines), mean,
        np.sqrt(np.maximum(np.bincount(doc, length**2, n) / words - mean**2, 0)), np.bincount(doc, length >= 15, n) / words, np.bincount(doc, length <= 2, n) / words,
        np.bincount(d, minlength=n) / words, norm**2 / words**2, _per_doc(raw == ord("|"), off) / size, np.log1p(w.counts),
        np.where(np.isnan(chars), 0.0, np.log1p(np.maximum(np.nan_to_num(chars), 0))),
    ]
    return d, bucket, value, np.where(np.diff(off)[:, None] > 0, np.stack(stats, axis=1), 0.0)


class Model:
    """bias, weights and factors for buckets and then statistics; the statistics' means and deviations."""

    def __init__(self, bias, weights, factors, centre, spread):
        self.bias, self.weights, self.factors, self.centre, self.spread = bias, weights, factors, centre, spread

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.centre) / self.spread, -4, 4)

    def logits(self, n: int, doc, bucket, value, stats) -> np.ndarray:
        z = self.standard(stats)
        sums, squares = z @ self.factors[BUCKETS:], (z**2) @ (self.factors[BUCKETS:] ** 2)
        for f in range(self.factors.shape[1]):
            vx = self.factors[bucket, f] * value
            sums[:, f] += np.bincount(doc, vx, n)
            squares[:, f] += np.bincount(doc, vx**2, n)
        linear = self.bias + z @ self.weights[BUCKETS:] + np.bincount(doc, self.weights[bucket] * value, n)
        return linear + 0.5 * (sums**2 - squares).sum(axis=1)

    def scores(self, data, offsets, chars) -> np.ndarray:
        out = [np.zeros(0)]
        for i, j in blocks(offsets):
            if self.factors is None:
                out.append(np.full(j - i, self.bias))
            else:
                out.append(1 / (1 + np.exp(-np.clip(self.logits(j - i, *featurise(data, offsets[i : j + 1], chars[i:j])), -50, 50))))
        return np.concatenate(out)


def _fit(y: np.ndarray, doc, bucket, value, stats, factors: int, decay: float, steps: int, batch: int, seed: int) -> Model:
    """Adam over batches of rows, as they lie; at least `steps` steps and PASSES passes. doc is ascending."""
    size = BUCKETS + stats.shape[1]
    model = Model(0.0, np.zeros(size), np.random.default_rng(seed).normal(0, 0.05, (size, factors)), stats.mean(axis=0), stats.std(axis=0) + 1e-6)
    z = model.standard(stats)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    theta = [np.zeros(1), model.weights, model.factors]
    moments = [(np.zeros_like(t), np.zeros_like(t)) for t in theta]
    starts = np.arange(0, len(y), batch)
    cuts = np.searchsorted(doc, [*starts, len(y)])
    for t in range(1, max(steps, PASSES * len(starts)) + 1):
        k = (t - 1) % len(starts)
        rows, words = slice(starts[k], starts[k] + batch), slice(cuts[k], cuts[k + 1])
        zk, d, b, x, n = z[rows], doc[words] - starts[k], bucket[words], value[words], len(y[rows])
        w, v = theta[1], theta[2]
        sums = zk @ v[BUCKETS:]
        squares = (zk**2) @ (v[BUCKETS:] ** 2)
        for f in range(factors):
            vx = v[b, f] * x
            sums[:, f] += np.bincount(d, vx, n)
            squares[:, f] += np.bincount(d, vx**2, n)
        logit = theta[0][0] + zk @ w[BUCKETS:] + np.bincount(d, w[b] * x, n) + 0.5 * (sums**2 - squares).sum(axis=1)
        e = weight[rows] / n * (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[rows])
        gw, gv = decay * w, decay * v
        gw[:BUCKETS] += np.bincount(b, e[d] * x, BUCKETS)
        gw[BUCKETS:] += e @ zk
        for f in range(factors):
            gv[:BUCKETS, f] += np.bincount(b, e[d] * x * (sums[d, f] - v[b, f] * x), BUCKETS)
        gv[BUCKETS:] += zk.T @ (e[:, None] * sums) - ((zk**2).T @ e)[:, None] * v[BUCKETS:]
        for i, g in enumerate((np.array([e.sum()]), gw, gv)):
            m, s = moments[i]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            theta[i] -= 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    model.bias = float(theta[0][0])
    return model


def _features(batches):
    for batch in batches:
        data, off = buffers(batch.column("text"))
        chars = batch.column("chars").to_numpy(zero_copy_only=False).astype(np.float64)
        buckets, values, stats = [], [], []
        for i, j in blocks(off):
            d, b, v, s = featurise(data, off[i : j + 1], chars[i:j])
            cut = np.searchsorted(d, np.arange(j - i + 1))
            for x, y in zip(cut[:-1], cut[1:], strict=True):
                buckets.append(b[x:y].astype(np.uint16).tobytes())
                values.append(v[x:y].astype(np.float32).tobytes())
            stats += [x.tobytes() for x in s]
        yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array(x, pa.binary()) for x in (buckets, values, stats))], names=["label", "buckets", "vals", "stats"])


def _chars(docs: DataFrame, chars_col: str | None) -> Column:
    return F.col(f"`{chars_col}`").cast("double") if chars_col and chars_col in docs.columns else F.lit(None).cast("double")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, max_rows: int = MAX_ROWS, factors: int = FACTORS, decay: float = 1e-4, steps: int = 150, batch: int = 256, seed: int = 42, text_col: str = "text", id_col: str = "doc_id", chars_col: str | None = "n_chars") -> Model:
    """A model from at most max_rows labelled rows. learn: condition on labels' columns for rows to learn from."""
    small_batches(docs.sparkSession)
    ids = labels.where((F.lit(True) if learn is None else learn) & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).cast("int").alias("label"))
    ids = hash_sample(ids, max_rows, id_col)
    texts = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("text"), _chars(docs, chars_col).alias("chars"))
    sample = one_each(texts.join(F.broadcast(ids), id_col), id_col).select("label", "text", "chars")  # ids: at most max_rows pairs of numbers
    rows = stash(sample.mapInArrow(_features, "label int, buckets binary, vals binary, stats binary"), "labelled").collect()
    rows.sort(key=lambda r: (r.label, bytes(r.stats), bytes(r.buckets)))  # the same model whatever the order of arrival
    rows = [rows[i] for i in np.random.default_rng(seed).permutation(len(rows))]
    y = np.array([r.label for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(float(y.mean()) if len(y) else 0.0, None, None, None, None)
    b = [np.frombuffer(r.buckets, np.uint16) for r in rows]
    doc = np.repeat(np.arange(len(rows)), list(map(len, b)))
    value = np.concatenate([np.frombuffer(r.vals, np.float32) for r in rows]).astype(np.float64)
    stats = np.stack([np.frombuffer(r.stats, np.float64) for r in rows])
    return _fit(y, doc, np.concatenate(b).astype(np.int64), value, stats, factors, decay, steps, batch, seed)


def _scorer(shared, text_col: str, threshold: float):
    def run(batches):
        model = pickle.loads(shared.value)
        for batch in batches:
            chars = batch.column("chars").to_numpy(zero_copy_only=False).astype(np.float64)
            score = model.scores(*buffers(batch.column("doc").field(text_col)), chars)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc", *NEW])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted. Columns keep to a struct, so none clashes with ours."""
    docs = keep_columns(docs, NEW, text_col)
    small_batches(docs.sparkSession)
    x = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _chars(docs, chars_col).alias("chars"))
    schema = T.StructType([x.schema["doc"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return x.mapInArrow(_scorer(share(docs.sparkSession, model), text_col, threshold), schema).select("doc.*", *NEW)
