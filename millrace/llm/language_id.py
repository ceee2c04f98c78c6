"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased, every run of other characters than letters becomes one boundary, and
each symbol is predicted from the three before it. Counts of four symbols are taken over
all learning documents; lower orders use continuation counts, and each order is discounted
and interpolated with the next. Per language and order, discounted probabilities and the
weights of contexts lie in arrays sorted by the sequence's 64-bit code and are found by
binary search; for the sequences that any language has seen, all languages' interpolated
probabilities lie side by side in one more sorted array, so that a symbol costs one search.

The language of the lowest cross-entropy per symbol wins; ties go to the first by name.
`rejected` says that this entropy is above what all but a thousandth of that language's own
documents reach: text of no learned language, or no prose. This limit, and how sharply
`score` turns entropies into a probability, are fitted on a tenth of the learning documents
(by a hash of the text, so copies stay together) under a model that is counted without
them; the model that judges counts all. A language with no document in that tenth has the
largest limit of the others.

No sequence is left out. A model of more than MAX_CELLS probabilities stays in Spark tables:
the most frequent sequences' probabilities, MAX_CELLS at most, go to the tasks, and what a
document has of others is joined by the sequence. Both ways give the same results.
Null texts and texts without letters are `und` with score 0, as is all if nothing was
learned. Texts are read whole, long ones in pieces that carry the symbols before them. Repeated rows are judged alike. Input columns with the names
of the result's are replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._store import keep_columns, share, small_batches, stash
from millrace.llm._text import blocks

ORDER, MAX_CELLS, PIECE = 4, 4_000_000, 1 << 20
REJECTED, HEAVY = 1000, 1000  # one in so many own documents is rejected; a sequence with more than one in so many rows is joined by broadcast
LEFT_OUT, SHARPNESS = 10, tuple(2.0 ** (k / 2) for k in range(2, 19))  # one in so many learning documents calibrates; what a difference of entropies may be multiplied by
UNKNOWN = "und"
NEW = ["lang_pred", "score", "entropy", "rejected"]
LATIN = np.array([chr(i).isalpha() for i in range(0x250)])


def codes(lowered: list[str]) -> tuple[np.ndarray, np.ndarray, str]:
    """A code of four symbols for each symbol of lower-cased texts, the number of codes of each text, and the last symbols; texts without letters have none."""
    cps = np.frombuffer("\n".join([*lowered, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(len(cps), bool)
    low = cps < 0x250
    letter[low] = LATIN[cps[low]]
    if not low.all():
        high, back = np.unique(cps[~low], return_inverse=True)
        letter[~low] = np.array([chr(c).isalpha() for c in high])[back]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others is its boundary
    doc = np.repeat(np.arange(len(lowered)), [len(t) + 1 for t in lowered])[keep]
    symbol = np.where(letter, (cps ^ (cps >> 16) * 40503) & 0xFFFF, 0).astype(np.uint64)[keep]
    n = np.bincount(doc, minlength=len(lowered))
    padded = np.zeros(len(symbol) + (ORDER - 1) * len(lowered), np.uint64)
    at = np.arange(len(symbol)) + (ORDER - 1) * (doc + 1)
    padded[at] = symbol
    code = np.zeros(len(symbol), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        code = code << np.uint64(16) | padded[at - back]
    last = np.flatnonzero(keep[:-1])[1 - ORDER :] if len(lowered) == 1 else ()
    return code, n, "".join(chr(cps[i]) if letter[i] else " " for i in last)


def coded(texts: list[str]):
    """(code, its text's number) of texts, a block at a time; a long text comes in pieces, each begun with the symbols before it, so that it needs no more memory than a short one."""
    lowered = [t.lower() for t in texts]
    for i, j in blocks(np.cumsum([0, *map(len, lowered)])):
        if len(lowered[i]) <= PIECE:
            code, n, _ = codes(lowered[i:j])
            yield code, np.repeat(np.arange(i, j), n)
            continue
        before = ""
        for a in range(0, len(lowered[i]), PIECE):
            told = int(codes([before])[1][0]) - (before[-1:].isalpha() and 1)  # without the boundary after its last letter
            piece = before + lowered[i][a : a + PIECE]
            code, n, before = codes([piece])
            more = a + PIECE < len(lowered[i])
            code = code[told : len(code) - (1 if more and piece[-1:].isalpha() else 0)]  # a piece's end is no boundary
            yield code, np.full(len(code), i)


def _tally(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if n is None:
        return np.unique(code, return_counts=True)
    order = np.argsort(code)
    code, n = code[order], n[order]
    cuts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
    return code[cuts], np.add.reduceat(n, cuts) if len(cuts) else n


def _count(batches):
    """Sequences of each language in a task's documents, with counts in all of them and in those that don't calibrate."""
    held: dict[tuple[str, bool], list] = {}

    def merged(key):
        if key not in held:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        c, n = zip(*held[key], strict=True)
        return _tally(np.concatenate(c), np.concatenate(n))

    for batch in batches:
        keys, texts = list(zip(batch.column("lang").to_pylist(), batch.column("aside").to_pylist(), strict=True)), batch.column("text").to_pylist()
        for key in sorted(set(keys)):
            for code, _ in coded([t for x, t in zip(keys, texts, strict=True) if x == key]):
                held.setdefault(key, []).append(_tally(code))
            if sum(len(c) for c, _ in held.get(key, ())) > 1 << 21:
                held[key] = [merged(key)]
    for lang in sorted({x for x, _ in held}):
        (rest, n), (aside, m) = merged((lang, False)), merged((lang, True))
        code, every = _tally(np.concatenate((rest, aside)), np.concatenate((n, m)))
        others = np.zeros(len(code), np.int64)
        others[np.searchsorted(code, rest)] = n
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(every.astype(np.int64)), pa.array(others)], names=["lang", "code", "n", "others"])


class Sorted:
    """Values by 64-bit key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, other: float):
        order = np.argsort(keys)
        self.keys, self.values, self.other = keys[order], values[order], other

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), self.other)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.other)


class KneserNey:
    """One language's model: for each order the discounted probabilities and the contexts' weights."""

    def __init__(self, code: np.ndarray, n: np.ndarray, symbols: int):
        self.orders, self.uniform = [], 1.0 / symbols
        for order in range(ORDER, 0, -1):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = float(np.clip(once / max(1, once + 2 * twice), 0.1, 0.9))
            context = code >> np.uint64(16)
            kinds, back = np.unique(context, return_inverse=True)
            total = np.bincount(back, n, len(kinds))
            follow = np.bincount(back, minlength=len(kinds))
            self.orders.append((order, Sorted(code, (n - discount) / total[back], 0.0), Sorted(kinds, discount * follow / total, 1.0)))
            if order > 1:
                code, n = np.unique(code & np.uint64((1 << 16 * (order - 1)) - 1), return_counts=True)  # continuations

    def __call__(self, code: np.ndarray) -> np.ndarray:
        """Interpolated probabilities of the last symbols of codes."""
        p = np.full(len(code), self.uniform)
        for order, seen, weight in reversed(self.orders):
            own = code & np.uint64((1 << 16 * order) - 1)
            p = seen(own) + weight(own >> np.uint64(16)) * p
        return p


class Model:
    """All languages' models, and what they give for the sequences that any has seen."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        symbols = 1 + len(np.unique(np.concatenate([c & np.uint64(0xFFFF) for c, _ in counts.values()]))) if counts else 1
        self.models = [KneserNey(*counts[x], symbols) for x in self.langs]
        self.keys = np.unique(np.concatenate([c for c, _ in counts.values()])) if counts else np.zeros(0, np.uint64)
        self.table = np.stack([np.log(m(self.keys)) for m in self.models], axis=1).astype(np.float32) if counts else np.zeros((0, 0), np.float32)
        self.limits, self.sharpness = np.full(len(self.langs), np.inf), SHARPNESS[0]

    def entropies(self, texts: list[str]) -> np.ndarray:
        """Cross-entropy per symbol of each text under each language; NaN for texts without letters."""
        total, size = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        for code, doc in coded(texts) if len(self.keys) else ():
            if not len(code):
                continue
            at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
            logs = self.table[at]
            miss = np.flatnonzero(self.keys[at] != code)
            if len(miss):
                new, back = np.unique(code[miss], return_inverse=True)
                logs[miss] = np.stack([np.log(m(new)) for m in self.models], axis=1)[back]
            starts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            total[doc[starts]] += np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
            size[doc[starts]] += np.diff(starts, append=len(doc))
        return np.where(size[:, None] > 0, -total / np.maximum(size, 1)[:, None], np.nan)


def _judged(model: Model, texts: list[str]):
    h = model.entropies(texts)
    for x in h:
        if not len(x) or np.isnan(x[0]):
            yield UNKNOWN, 0.0, None, True
        else:
            best = int(x.argmin())
            yield model.langs[best], float(1 / np.exp((x[best] - x) * model.sharpness).sum()), float(x[best]), bool(x[best] > model.limits[best])


def _judge(shared, text_col: str, fields: list[str]):
    def run(batches):
        model = pickle.loads(shared.value)
        for batch in batches:
            rows = list(_judged(model, [t or "" for t in batch.column(text_col).to_pylist()]))
            columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
            kept = {f.name: batch.column(k) for k, f in enumerate(batch.schema)} | dict(zip(NEW, (pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)), strict=True))
            yield pa.RecordBatch.from_arrays([kept[f] for f in fields], names=fields)

    return run


def _weigh(shared):
    """Languages of documents with their entropies under each language's model."""

    def run(batches):
        model = pickle.loads(shared.value)
        for batch in batches:
            h = model.entropies([t or "" for t in batch.column("text").to_pylist()])
            real = np.flatnonzero(~np.isnan(h[:, 0])) if h.shape[1] else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(real)), pa.array(h[real].tolist(), pa.list_(pa.float64()))], names=["lang", "h"])

    return run


class TableModel:
    """All languages' models as Spark tables, with the probabilities of the most frequent sequences at hand."""

    def __init__(self, counts: DataFrame, langs: list[str], room: int):
        self.langs, self.limits, self.sharpness, self.orders = langs, np.full(len(langs), np.inf), SHARPNESS[0], []
        symbols = 1 + counts.agg(F.count_distinct(last_of("code", 1))).first()[0]
        self.uniform = 1.0 / symbols
        index = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")).cast("int") - 1
        rows = counts.select(index.alias("i"), "code", "n")
        for order in range(ORDER, 0, -1):
            discount = [0.1] * len(langs)
            for r in rows.groupBy("i").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
                discount[r.i] = float(np.clip(r.once / max(1, r.once + 2 * r.twice), 0.1, 0.9))
            seen = rows.groupBy("code").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("seen"))
            kinds = rows.groupBy(F.shiftrightunsigned("code", 16).alias("context"), "i").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("follow"))
            kinds = kinds.groupBy("context").agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("total", "follow")))).alias("kinds"))
            self.orders.append((order, discount, stash(seen, f"seen{order}"), stash(kinds, f"contexts{order}")))
            if order > 1:
                rows = stash(rows.groupBy("i", last_of("code", order - 1).alias("code")).agg(F.count(F.lit(1)).alias("n")), "continuations")
        sums, least = counts.groupBy("code").agg(F.sum("n").alias("n")), 1
        for r in sums.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():  # by count, from the top, until the room is full
            room -= r["count"]
            if room < 0:
                least = r.n + 1
                break
        got = self.probabilities(sums.where(F.col("n") >= least).select("code")).toArrow()
        keys, logs = got.column("code").to_numpy().view(np.uint64), got.column("logs").combine_chunks()
        by_key = np.argsort(keys)
        self.keys, self.table = keys[by_key], logs.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(langs))[by_key]

    def probabilities(self, asked: DataFrame) -> DataFrame:
        """(code, logs) of distinct codes: the log of each language's interpolated probability. A code has at most 65,536 longer ones, so no key of a join grows with the corpus."""
        at = F.sequence(F.lit(0), F.lit(len(self.langs) - 1))
        below = None
        for order, discount, seen, kinds in reversed(self.orders):
            own = asked if order == ORDER else asked.select(last_of("code", order).alias("code")).distinct()
            x = own.join(seen, "code", "left").withColumn("context", F.shiftrightunsigned("code", 16)).join(kinds, "context", "left")
            if below is None:
                x = x.withColumn("lower", F.array(*[F.lit(self.uniform)] * len(self.langs)))
            else:
                x = x.withColumn("below", last_of("code", order - 1)).join(below, "below")
            x = x.withColumn("d", F.array(*map(F.lit, discount)))
            x = x.select("code", F.transform(at, interpolated).alias("lower"))
            below = x.withColumnRenamed("code", "below")
        return x.select("code", F.transform("lower", lambda p: F.log(p).cast("float")).alias("logs"))


def interpolated(i: Column) -> Column:
    """A language's probability from the columns seen, kinds, d and lower."""
    kinds = F.try_element_at("kinds", i)
    own = (F.try_element_at("seen", i) - F.get("d", i)) / kinds["total"]
    return F.coalesce(own, F.lit(0.0)) + F.coalesce(F.get("d", i) * kinds["follow"] / kinds["total"], F.lit(1.0)) * F.get("lower", i)


def last_of(code: str, order: int) -> Column:
    """The last symbols of a sequence's code."""
    return F.col(code) if order == ORDER else F.col(code).bitwiseAND(F.lit((1 << 16 * order) - 1))


def _parts(shared):
    """For each text with letters a row with its number of symbols and what the sequences at hand give, and one for each other sequence with its count."""

    def run(batches):
        keys, table = pickle.loads(shared.value)
        for batch in batches:
            names, texts = np.array(batch.column("key").to_pylist(), object), batch.column("text").to_pylist()
            n, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), table.shape[1]))
            docs, others, times = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for code, doc in coded(texts):
                at = np.minimum(np.searchsorted(keys, code), max(0, len(keys) - 1))
                hit = keys[at] == code if len(keys) else np.zeros(len(code), bool)
                n += np.bincount(doc, minlength=len(texts))
                sums += np.stack([np.bincount(doc[hit], column[at[hit]], len(texts)) for column in table.T.astype(np.float64)], axis=1)
                for k, v in zip((docs, others, times), _pairs(doc[~hit], code[~hit], np.ones(int((~hit).sum()), np.int64)), strict=True):
                    k.append(v)
            d, c, m = _pairs(*map(np.concatenate, (docs, others, times)))
            full = np.flatnonzero(n)
            own = [pa.array([*names[full], *names[d]], pa.binary()), pa.array([*[None] * len(full), *c.view(np.int64).tolist()], pa.int64()), pa.array([*n[full].tolist(), *m.tolist()], pa.int64())]
            own.append(pa.array([*sums[full].tolist(), *[None] * len(c)], pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(own, names=["key", "code", "n", "sums"])

    return run


def _pairs(doc: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each different (document, code) with its sum of n."""
    order = np.lexsort((code, doc))
    doc, code, n = doc[order], code[order], n[order]
    cuts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])))) if len(code) else np.zeros(0, np.int64)
    return doc[cuts], code[cuts], np.add.reduceat(n, cuts) if len(cuts) else n


def _weighed(docs: DataFrame, model: TableModel, text_col: str) -> DataFrame:
    """(key, h): entropies of the texts that have letters under each language of a model in tables. Texts are known by their SHA-256, so copies are looked up once."""
    key, each = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256)), range(len(model.langs))
    texts = docs.where(F.col(text_col).isNotNull()).select(key.alias("key"), F.col(text_col).alias("text"))
    parts = texts.mapInArrow(_parts(share(docs.sparkSession, (model.keys, model.table))), "key binary, code long, n long, sums array<double>")
    parts = stash(parts.groupBy("key", "code").agg(F.any_value("n").alias("n"), F.any_value("sums").alias("sums")), "parts")
    others = parts.where("code IS NOT NULL").select("key", "code", "n")
    asked = stash(others.groupBy("code").agg(F.count(F.lit(1)).alias("rows")), "asked")
    most = (asked.agg(F.sum("rows")).first()[0] or 0) / HEAVY
    logs = stash(model.probabilities(asked.select("code")).join(asked, "code"), "logs")
    met = [others.join(logs.where(F.col("rows") <= most), "code"), others.join(F.broadcast(logs.where(F.col("rows") > most)), "code")]  # fewer than HEAVY codes
    sums = parts.where("code IS NULL").select("key", F.col("n").alias("symbols"), "sums")
    for x in met:
        sums = sums.unionByName(x.select("key", F.lit(None).cast("long").alias("symbols"), F.transform("logs", lambda p: p.cast("double") * F.col("n")).alias("sums")))
    total = sums.groupBy("key").agg(F.max("symbols").alias("symbols"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in each])
    return total.select("key", F.array(*[-F.col(f"s{i}") / F.col("symbols") for i in each]).alias("h"))


def _joined(docs: DataFrame, model: TableModel, text_col: str) -> DataFrame:
    """docs judged by a model in tables."""
    key = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))
    h = _weighed(docs, model, text_col).withColumn("least", F.array_min("h"))
    h = h.withColumn("best", F.array_position("h", F.col("least")).cast("int") - 1)
    limit, lang = F.array(*[F.lit(float(x)) for x in model.limits]), F.array(*[F.lit(x) for x in model.langs])
    share_of = F.lit(1.0) / F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp((F.col("least") - x) * float(model.sharpness)))
    judged = h.select(F.col("key").alias("__key"), F.get(lang, "best").alias("__lang"), share_of.alias("__score"), F.col("least").alias("__entropy"), (F.col("least") > F.get(limit, "best")).alias("__rejected"))
    x = docs.withColumn("__key", key).join(judged, "__key", "left")
    return x.select(*docs.columns, F.coalesce("__lang", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("__score", F.lit(0.0)).alias("score"), F.col("__entropy").alias("entropy"), F.coalesce("__rejected", F.lit(True)).alias("rejected"))


def identify(docs: DataFrame, model: Model | TableModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1), entropy and rejected."""
    docs = keep_columns(docs, NEW, text_col)
    small_batches(docs.sparkSession)
    if isinstance(model, TableModel):
        return _joined(docs, model, text_col)
    types = (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*docs.schema, *(T.StructField(n, t) for n, t in zip(NEW, types, strict=True))])
    return docs.mapInArrow(_judge(share(docs.sparkSession, model), text_col, schema.names), schema)


def _calibrate(aside: DataFrame, part: Model | TableModel, model: Model | TableModel) -> None:
    """model's limits and sharpness, from the entropies that `part` gives the documents it has not counted.

    A limit is the value at the rank of all but one in REJECTED, found in bins of 10⁻²,
    10⁻⁶ and 10⁻¹⁰; the sharpness is the one of least log loss.
    """
    if not part.langs:
        return
    if isinstance(part, TableModel):
        key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
        h = aside.select(key.alias("key"), "lang").join(_weighed(aside, part, "text"), "key").select("lang", "h")
    else:
        h = aside.mapInArrow(_weigh(share(aside.sparkSession, part)), "lang string, h array<double>")
    at = F.array_position(F.array(*[F.lit(x) for x in part.langs]), F.col("lang")).cast("int") - 1
    seen = stash(h.select("lang", F.array_min("h").alias("entropy"), "h", F.get("h", at).alias("own")).where("own IS NOT NULL"), "entropies")

    def loss(t: float) -> Column:
        """Mean log loss where differences of entropies are multiplied by t."""
        rest = F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp((F.col("entropy") - x) * t))
        return F.avg((F.col("own") - F.col("entropy")) * t + F.log(rest))

    losses = seen.agg(*[loss(t).alias(f"t{k}") for k, t in enumerate(SHARPNESS)]).first()
    if losses[0] is None:
        return
    model.sharpness = SHARPNESS[int(np.argmin(losses))]
    seen = seen.where("own = entropy").select("lang", "entropy")
    rank, low = {}, {}
    for k, width in enumerate((1e-2, 1e-6, 1e-10)):
        bin_of = F.floor(F.col("entropy") / width)
        if k:
            chosen = F.create_map(*[F.lit(v) for x in low.items() for v in x])
            seen = seen.where(F.floor(F.col("entropy") / before) == F.try_element_at(chosen, F.col("lang")))
        found: dict[str, list] = {}
        for r in seen.groupBy("lang", bin_of.alias("bin")).count().collect():  # at most some 10,000 bins a language
            found.setdefault(r.lang, []).append((r.bin, r["count"]))
        if not found:
            return
        for lang, bins in found.items():
            bins.sort()
            if not k:
                rank[lang] = sum(c for _, c in bins) - sum(c for _, c in bins) // REJECTED
            for low[lang], c in bins:
                if rank[lang] <= c:
                    break
                rank[lang] -= c
        before = width
    for i, lang in enumerate(model.langs):
        model.limits[i] = ((low[lang] if lang in low else max(low.values())) + 1) * before


def _model(counts: DataFrame, n: str, room: int) -> Model | TableModel:
    """A model of the counts in column n."""
    own = counts.where(F.col(n) > 0).select("lang", "code", F.col(n).alias("n"))
    size = {r.lang: r["count"] for r in own.groupBy("lang").count().collect()}
    if sum(size.values()) > room // max(1, len(size)):
        return TableModel(own, sorted(size), room // len(size))
    by: dict[str, list] = {}
    for r in own.toArrow().to_batches():
        langs = np.array(r.column("lang").to_pylist(), object)
        for lang in set(langs):
            by.setdefault(lang, []).append(tuple(r.column(c).to_numpy(zero_copy_only=False)[langs == lang] for c in ("code", "n")))
    return Model({lang: _tally(np.concatenate([c for c, _ in x]).view(np.uint64), np.concatenate([n for _, n in x])) for lang, x in by.items()})


def learn(docs: DataFrame, where: Column, max_cells: int = MAX_CELLS, text_col: str = "text", lang_col: str = "lang") -> Model | TableModel:
    """A model from all documents with a language for which `where` holds, whose probabilities lie in memory where they are at most max_cells."""
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    own = docs.where(where & F.col(f"`{lang_col}`").isNotNull() & text.isNotNull()).select(F.col(f"`{lang_col}`").alias("lang"), text.alias("text"), (F.pmod(F.xxhash64(text), F.lit(LEFT_OUT)) == 0).alias("aside"))
    counts = own.mapInArrow(_count, "lang string, code long, n long, others long").groupBy("lang", "code").agg(F.sum("n").alias("n"), F.sum("others").alias("others"))
    counts = stash(counts, "sequences")
    model = _model(counts, "n", max_cells)
    _calibrate(own.where("aside").drop("aside"), _model(counts, "others", max_cells), model)
    return model
