"""A stored inverted index, and BM25 over it.

Documents are tokenised once, when they are added. A task turns its documents into segments
of bounded size; a segment has, for each of its terms, one row with the term's postings
(places of documents in the segment, and how often the term occurs), and one row with its
documents: ids, lengths, and what questions may filter by. Rows lie in buckets by term, so
asking reads the buckets of the questions' terms and nothing else; a term that every document
has is a row a segment, so no term is one task's.

To ask, the rows of the questions' terms meet by segment, once for all questions. The most that
a term adds in a segment bounds a score: a question skips the segments, and inside a segment the
groups of like documents, whose bounds don't reach the k-th score that the task has found for it.
Documents of equal filter values lie side by side, so that a segment is skipped by most questions
with filters. Filters hold before ranking; numbers of documents, lengths and document frequencies
are those of the whole index, whatever the filters.

Adding writes new segments beside the others, and all statistics are sums over segments. A
document's id is not checked against the index: one that is added twice is there twice.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text
from millrace.sources.shared import checkpoint_root, shuffle_parts, stash

Tokenizer = Callable[[Column], Column]  # a text to an array of terms; a pandas UDF with a word segmenter will do

SEGMENT_DOCS, SEGMENT_TOKENS = 1 << 14, 1 << 22  # a segment ends at either; a longer document is a segment of its own
BUCKETS = 64  # directories of terms
BLOCK_TERMS, BLOCK_QUERIES, MEETS = 4_000_000, 1 << 17, 1 << 21  # of a broadcast block of questions; scores and postings handled at once
CACHED = 1 << 16  # postings that are added up at once
BROADCAST_TERMS = 4_000_000  # asked terms that are sent to the postings
DENSE, DENSE_TERMS, DENSE_QUERIES = 0.0015, 1024, 16  # share of pairs of question and document that both have a term, from which a matrix product adds it up; terms of one; questions that are worth one
GROUPS, FEW = 8, 0.05  # groups of like documents in a segment; share of a group's documents up to which a question's candidates are scored one by one
NEAR = 1e-4  # bounds the relative error of single-precision sums of DENSE_TERMS parts
OWN = "\0docs"  # the term of a segment's own row, which no tokenizer gives


def best(scored: DataFrame, k: int, score: str = "score", by: str = "query_id", tie: tuple[str, ...] = ("id",)) -> DataFrame:
    """The k rows of highest score of each query, with rank from 1."""
    order = W.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), *tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25_df(docs: DataFrame, tokenize: Tokenizer = text.tokens) -> DataFrame:
    """Documents that have a term, and its occurrences. A document's terms are sorted in its row, so that one exchange by term counts both."""
    own = docs.select(F.sort_array(tokenize(F.col("text"))).alias("t"))
    marked = own.select(F.explode(F.transform("t", lambda x, i: F.struct(x.alias("term"), (~F.get("t", i - 1).eqNullSafe(x)).cast("long").alias("first")))).alias("x"))
    return marked.groupBy("x.term").agg(F.sum("x.first").alias("df"), F.count(F.lit(1)).alias("cf"))


def bm25_stats(docs: DataFrame, tokenize: Tokenizer = text.tokens) -> DataFrame:
    """Number of documents, tokens and the mean length."""
    sizes = docs.select(F.size(tokenize(F.coalesce("text", F.lit("")))).alias("len"))
    return sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("len").alias("n_tokens"), F.avg("len").alias("avgdl"))


# --- building


def _segments(name: str, scope: tuple[str, ...]):
    """Batches of (id, tokens, scope) to rows of segments. A segment is named by its place, so that a task that runs again names it alike."""

    def segment(batches: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        tokens = rows.column("tokens").combine_chunks()
        size = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
        coded = tokens.flatten().dictionary_encode()
        n = len(coded.dictionary)
        code, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(size)), size)
        pair, tf = np.unique(code * max(1, len(size)) + doc, return_counts=True)
        code, doc = np.divmod(pair, max(1, len(size)))
        doc, tf = doc.astype(np.uint16), tf.astype(np.uint16 if tf.max(initial=0) < 1 << 16 else np.int32)  # SEGMENT_DOCS fit
        start = np.searchsorted(code, np.arange(n + 1))
        cuts = list(zip(start[:-1].tolist(), start[1:].tolist(), strict=True))
        total = np.concatenate(([0], np.cumsum(tf, dtype=np.int64)))
        told = lambda c: pa.concat_arrays([pa.nulls(n, pa.list_(c.type)), pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c)])
        columns = {
            "segment": pa.array([f"{name}-{number}"] * (n + 1)),
            "term": pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([OWN])]),
            "df": pa.array(np.append(np.diff(start), len(size)).astype(np.int64)),
            "tokens": pa.array(np.append(total[start[1:]] - total[start[:-1]], size.sum(dtype=np.int64))),
            "docs": pa.array([doc[a:b].tobytes() for a, b in cuts] + [size.tobytes()], pa.binary()),
            "tfs": pa.array([tf[a:b].tobytes() for a, b in cuts] + [b""], pa.binary()),
            **{c: told(rows.column(c).combine_chunks()) for c in ("id", *scope)},
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, tokens, number = [], 0, 0, TaskContext.get().partitionId() << 20
        for batch in batches:
            at = 0
            for i, n in enumerate(batch.column("tokens").value_lengths().fill_null(0).to_pylist()):
                docs, tokens = docs + 1, tokens + n
                if docs >= SEGMENT_DOCS or tokens >= SEGMENT_TOKENS:
                    yield segment([*held, batch.slice(at, i + 1 - at)], number)
                    held, docs, tokens, at, number = [], 0, 0, i + 1, number + 1
            if at < batch.num_rows:
                held.append(batch.slice(at))
        if held:
            yield segment(held, number)

    return run


@dataclass(frozen=True)
class LexicalIndex:
    """Where an index lies, how its documents were tokenised, and what questions may filter by."""

    path: str
    tokenize: Tokenizer
    scope: tuple[str, ...]

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def stats(self, spark: SparkSession) -> tuple[int, float]:
        """Documents and their mean length, from the bucket of the segments' own rows."""
        n, total = self.rows(spark).where(F.col("bucket") == BUCKETS).agg(F.sum("df"), F.sum("tokens")).first()
        return n or 0, (total or 0) / n if n else 0.0


def bucket_of(term: Column) -> Column:
    """Segments' own rows have a bucket of their own, behind the terms'."""
    return F.when(term == OWN, F.lit(BUCKETS)).otherwise(F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int"))


def add_documents(docs: DataFrame, path: str, tokenize: Tokenizer = text.tokens, scope: Sequence[str] = ()) -> LexicalIndex:
    """Write documents (id, text, and the columns of scope, kept as strings) to the index at path, new or there already.

    Null texts have no terms. docs without scope comes in the same order when a task runs again,
    as a table in files does; write one that does not first. With a scope, documents are sorted by it.
    """
    if scope:
        by = [F.col(f"`{c}`").cast("string") for c in scope]
        docs = docs.repartitionByRange(shuffle_parts(docs.sparkSession), *by, "id").sortWithinPartitions(*by, "id")
    own = docs.select("id", tokenize(F.coalesce("text", F.lit(""))).alias("tokens"), *[F.col(f"`{c}`").cast("string").alias(c) for c in scope])
    schema = "segment string, term string, df long, tokens long, docs binary, tfs binary"
    lists = [T.StructField("id", T.ArrayType(docs.schema["id"].dataType)), *[T.StructField(c, T.ArrayType(T.StringType())) for c in scope]]
    made = own.mapInArrow(_segments(uuid.uuid4().hex, tuple(scope)), T.StructType([*T._parse_datatype_string(schema).fields, *lists]))
    # a bucket's rows go to several tasks by segment, as many as the session has partitions for, so that neither a term nor a bucket is one task's
    spread = -(-shuffle_parts(docs.sparkSession) // BUCKETS)
    dealt = made.withColumn("bucket", bucket_of(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64("segment"), F.lit(spread)))
    dealt.sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(path)
    return LexicalIndex(path, tokenize, tuple(scope))


# --- asking


def bm25_ask(index: LexicalIndex, queries: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, id, score, rank) by BM25 over the index's documents; a query's repeated terms count each time; scores of zero give no row.

    queries: query_id, text, and any columns of the index's scope: a string is the value that
    documents must have, an array holds the values that they may have, null asks for nothing.
    Questions are broadcast in blocks of a counted size. The postings of asked terms cross the
    network once, by segment, to a few tasks a core; several blocks read them where they then lie.
    """
    spark = queries.sparkSession
    n, avgdl = index.stats(spark)
    filters = [c for c in index.scope if c in queries.columns]
    wanted = [F.col(c) if isinstance(queries.schema[c].dataType, T.ArrayType) else F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string"))) for c in filters]
    asked = queries.select("query_id", F.explode(index.tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    asked = asked.withColumn("bucket", bucket_of(F.col("term"))).persist()  # read for its size and buckets, for its terms, and for its weights
    rows = index.rows(spark)
    size = asked.agg(F.count(F.lit(1)), F.count_distinct("query_id"), F.collect_set("bucket")).first()  # at most BUCKETS buckets
    df = rows.where(F.col("bucket").isin(size[2])).select("term", "df").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    terms = stash(df.withColumn("number", F.monotonically_increasing_id()), "terms")  # numbers stay as they were written
    weighted = asked.join(terms, "term").select("query_id", F.col("number").alias("term"), (F.col("qtf") * F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)).alias("weight"))
    blocks = max(1, math.ceil(size[0] / BLOCK_TERMS), math.ceil(size[1] / BLOCK_QUERIES))
    weighted = weighted.persist() if blocks > 1 else weighted
    id_type = rows.schema["id"].dataType.elementType
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", id_type), T.StructField("score", T.DoubleType())])
    own_row = spark.createDataFrame([(OWN, -1)], "term string, number long")
    named = terms.select("term", "number")
    if blocks == 1:
        named = F.broadcast(spark.createDataFrame(named.toArrow(), "term string, number long").union(own_row))  # at most BLOCK_TERMS
    else:
        named = F.broadcast(named.union(own_row)) if terms.count() <= BROADCAST_TERMS else named.union(own_row)
    lists = [T.StructField("id", T.ArrayType(id_type)), *[T.StructField(c, T.ArrayType(T.StringType())) for c in filters]]
    read = rows.where(F.col("bucket").isin([*size[2], BUCKETS])).join(named, "term")
    # each task keeps k rows a question, so tasks are a few a core, not as many as the session has partitions for
    tasks = min(shuffle_parts(spark), (4 if blocks == 1 else 2) * spark.sparkContext.defaultParallelism)
    met = read.select("segment", "number", "docs", "tfs", "id", *filters).repartition(tasks, "segment").sortWithinPartitions("segment", "number")
    if blocks > 1:
        packed = T.StructType([T.StructField(c, T.BinaryType()) for c in ("size", "number", "count", "doc", "tf")] + lists)
        met = met.mapInArrow(_pack(filters), packed).persist(StorageLevel.DISK_ONLY)
    found = []
    for i in range(blocks):
        own = lambda x: x if blocks == 1 else x.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)  # noqa: B023, E731
        block = own(weighted).toArrow()  # about BLOCK_TERMS rows at most
        scopes = {r[0]: tuple(None if v is None else frozenset(v) for v in r[1:]) for r in own(queries).select("query_id", *wanted).collect()} if filters else {}
        shared = spark.sparkContext.broadcast(cloudpickle.dumps((_Questions(block, scopes), filters)))
        found.append(met.mapInArrow(_asked(shared, k, k1, b, avgdl or 1.0, blocks > 1), schema))
    for x in (asked, weighted):
        x.unpersist()
    return best(reduce(DataFrame.unionByName, found), k)


class _Questions:
    """A block of questions: their terms by place, each question's terms and weights side by side, and what it filters by."""

    def __init__(self, block: pa.Table, scopes: dict):
        questions = block.column("query_id").combine_chunks().dictionary_encode()
        names = block.column("term").combine_chunks()
        self.names = names.unique().sort()  # the terms, or their numbers
        of, term = questions.indices.to_numpy(zero_copy_only=False), pc.index_in(names, self.names).to_numpy(zero_copy_only=False).astype(np.int32)
        order = np.lexsort((term, of))
        self.ids = questions.dictionary
        self.start = np.searchsorted(of[order], np.arange(len(self.ids) + 1))
        self.term, self.weight, self.of = term[order], block.column("weight").to_numpy()[order], of[order]
        self.scopes = [scopes.get(q, ()) for q in self.ids.to_pylist()] if scopes else [()] * len(self.ids)

    def places(self, numbers: np.ndarray) -> np.ndarray:
        """Where terms (by number) are in names; -1: nowhere."""
        names = self.names.to_numpy(zero_copy_only=False)
        if not len(names):
            return np.full(len(numbers), -1)
        at = np.minimum(np.searchsorted(names, numbers), len(names) - 1)
        return np.where(names[at] == numbers, at, -1)


class _Found:
    """A task's best rows of each question, and the k-th score so far."""

    def __init__(self, n: int, k: int):
        self.k, self.rows, self.held, self.limit = k, [], 0, MEETS
        self.top, self.least = np.full((n, k), -np.inf), np.full(n, -np.inf)

    def add(self, questions: np.ndarray, ids: pa.Array, score: np.ndarray) -> None:
        """Rows side by side by question (by place), k at most of each."""
        self.rows.append((questions, ids, score))
        first = np.flatnonzero(np.diff(questions, prepend=-1))
        own, count = questions[first], np.diff(first, append=len(questions))
        new = np.full((len(own), self.k), -np.inf)
        new[np.repeat(np.arange(len(own)), count), np.arange(len(questions)) - np.repeat(first, count)] = score
        self.top[own] = np.partition(np.concatenate((self.top[own], new), axis=1), self.k, axis=1)[:, self.k :]
        self.least[own] = self.top[own].min(axis=1)
        self.held += len(questions)
        if self.held > self.limit:
            self.rows = list(self.best())
            self.held = sum(len(q) for q, _, _ in self.rows)
            self.limit = 2 * self.held + MEETS

    def best(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """The rows that are not below their question's k-th score."""
        for q, ids, score in self.rows:
            keep = score >= self.least[q]
            if keep.any():
                yield q[keep], ids.filter(pa.array(keep)), score[keep]


@dataclass
class _Segment:
    """Lengths of a segment's documents; its terms by number, how many documents have each, and these side by side with how often; what its own row lists."""

    size: np.ndarray
    number: np.ndarray
    count: np.ndarray
    doc: np.ndarray
    tf: np.ndarray
    lists: dict[str, pa.Array]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's values end to end, and their lengths."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8), np.diff(ends)


def _read(batches: Iterator[pa.RecordBatch], filters: list[str]) -> Iterator[_Segment]:
    """Segments from rows in order of segment and number, its own row (number -1) first."""
    held, name = [], None

    def close() -> Iterator[_Segment]:
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            number, docs, tfs, *_ = (rows.column(c).chunk(0) for c in ("number", "docs", "tfs"))
            if number[0].as_py() == -1:
                doc, length = _bytes(docs.slice(1))
                count = length // 2
                total = int(count.sum(dtype=np.int64))
                tf = _bytes(tfs.slice(1))[0]
                tf = np.frombuffer(tf.tobytes(), np.uint16 if len(tf) == 2 * total else np.int32)
                yield _Segment(np.frombuffer(docs[0].as_py(), np.int32), number.slice(1).to_numpy(), count, np.frombuffer(doc.tobytes(), np.uint16), tf, {c: rows.column(c).chunk(0)[0].values for c in ("id", *filters)})
            held.clear()

    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("segment").dictionary_encode()
        code = own.indices.to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        for x, y in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
            segment = own.dictionary[int(code[x])].as_py()
            if segment != name:
                yield from close()
                name = segment
            held.append(batch.slice(x, y - x))
    yield from close()


def _pack(filters: list[str]):
    """Segments' rows in order to one row a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _read(batches, filters):
            columns = {c: pa.array([v.tobytes()], pa.binary()) for c, v in (("size", s.size), ("number", s.number), ("count", s.count.astype(np.int32)), ("doc", s.doc), ("tf", s.tf))}
            columns |= {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for c, v in s.lists.items()}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def _unpack(batches: Iterator[pa.RecordBatch], filters: list[str]) -> Iterator[_Segment]:
    for batch in batches:
        for i in range(batch.num_rows):
            size, number, count, doc, tf = (batch.column(c)[i].as_py() for c in ("size", "number", "count", "doc", "tf"))
            doc = np.frombuffer(doc, np.uint16)
            yield _Segment(np.frombuffer(size, np.int32), np.frombuffer(number, np.int64), np.frombuffer(count, np.int32), doc, np.frombuffer(tf, np.uint16 if len(tf) == 2 * len(doc) else np.int32), {c: batch.column(c)[i].values for c in ("id", *filters)})


def search_segment(questions: _Questions, found: _Found, rows: list[dict], filters: list[str], k1: float, b: float, avgdl: float) -> int:
    """search_postings for rows that name their terms: the segment's own row, then its postings, as 32-bit integers."""
    place = {t: i for i, t in enumerate(questions.names.to_pylist())}
    kept = [r for r in rows[1:] if r["term"] in place]
    doc, tf = ([np.frombuffer(r[c], np.int32) for r in kept] for c in ("docs", "tfs"))
    count = np.array([len(d) for d in doc], np.int64)
    whole = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
    own = _Segment(np.frombuffer(rows[0]["docs"], np.int32), np.array([place[r["term"]] for r in kept], np.int64), count, whole(doc), whole(tf), {c: rows[0][c] for c in ("id", *filters)})
    return search_postings(questions, found, own, own.number, filters, k1, b, avgdl)


def _alike(have: np.ndarray) -> np.ndarray:
    """Groups of like documents, by a few rounds of means over which frequent terms they have (rows: terms). Any grouping gives the same results; like ones are skipped together."""
    n = have.shape[1]
    if n < 32 * GROUPS or not len(have):
        return np.zeros(n, np.int64)
    x = (have / np.maximum(np.sqrt(have.sum(axis=0)), 1)).astype(np.float32)
    centres = x[:, np.linspace(0, n - 1, GROUPS).astype(np.int64)]
    for _ in range(4):
        group = (centres.T @ x).argmax(axis=0)
        centres = np.stack([x[:, group == g].sum(axis=1) for g in range(GROUPS)], axis=1)
        centres /= np.maximum(np.linalg.norm(centres, axis=0), 1e-9)
    return group


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length, end to end."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def search_postings(questions: _Questions, found: _Found, own: _Segment, at: np.ndarray, filters: list[str], k1: float, b: float, avgdl: float) -> int:
    """Adds what a segment has for each question; at: places of the segment's terms among the questions', -1 for none. Gives the number of questions that were searched, not skipped by their bound.

    Terms that many questions and documents have are added up by products in single precision,
    group by group, all others from their postings; what may reach a question's k-th score is
    then added up again in double precision.
    """
    n, held, doc, tf = len(own.size), own.count.astype(np.int64), own.doc, own.tf
    if (at < 0).any():
        part = np.repeat(at >= 0, held)
        held, doc, tf, at = held[at >= 0], doc[part], tf[part], at[at >= 0]
    if not len(held):
        return 0
    doc = doc.astype(np.int64)
    norm = k1 * (1 - b + b * own.size / avgdl)
    start, gain = np.cumsum(held) - held, tf * (k1 + 1) / (tf + norm[doc])
    slot = np.full(len(questions.names), -1)
    slot[at] = np.arange(len(at))
    there = slot[questions.term]
    known = there >= 0
    highest = np.bincount(questions.of[known], questions.weight[known] * np.maximum.reduceat(gain, start)[there[known]], len(questions.ids))
    masks: dict = {}

    def mask_of(scope: tuple) -> np.ndarray | None:
        """Which documents a question's filters let through; None: all."""
        if scope not in masks:
            mask = np.ones(n, bool)
            for c, allowed in zip(filters, scope, strict=True):
                if allowed is not None:
                    mask &= pc.fill_null(pc.is_in(own.lists[c], pa.array(sorted(allowed), pa.string())), False).to_numpy(zero_copy_only=False) if allowed else False
            masks[scope] = None if mask.all() else mask
        return masks[scope]

    may = (highest > 0) & (highest + 1e-8 >= found.least)  # scores are rounded to 9 places
    chosen = [q for q in np.flatnonzero(may).tolist() if (m := mask_of(questions.scopes[q])) is None or m.any()]
    if not chosen:
        return 0
    asking = np.zeros(len(questions.ids), bool)
    asking[chosen] = True
    shared = held * np.bincount(there[known & asking[questions.of]], minlength=len(held))
    frequent = np.argsort(-shared, kind="stable")[:DENSE_TERMS] if len(chosen) >= DENSE_QUERIES else np.zeros(0, np.int64)
    frequent = frequent[shared[frequent] >= DENSE * n * len(chosen)]
    dense = np.zeros((len(frequent), n))
    post = _spans(start[frequent], held[frequent])
    dense[np.repeat(np.arange(len(frequent)), held[frequent]), doc[post]] = gain[post]
    group = _alike(dense[:128] > 0)
    order = np.argsort(group, kind="stable")  # documents of a group lie side by side from here on
    new_place = np.argsort(order)
    doc, dense, masks = new_place[doc], dense[:, order], {s: None if m is None else m[order] for s, m in masks.items()}
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
    most = np.maximum.reduceat(dense, cuts[:-1], axis=1)
    single = dense.astype(np.float32)
    rank = np.empty(n, np.int64)
    rank[new_place[pc.sort_indices(own.lists["id"]).to_numpy()]] = np.arange(n)
    column = np.full(len(held), -1)  # of a frequent term in the matrices
    column[frequent] = np.arange(len(frequent))
    step = max(1, MEETS // n)
    for i in range(0, len(chosen), step):
        some = np.array(chosen[i : i + step])
        pair = _spans(questions.start[some], questions.start[some + 1] - questions.start[some])
        pair = pair[known[pair]]
        slots, row, weight = there[pair], np.searchsorted(some, questions.of[pair]), questions.weight[pair]
        common = column[slots] >= 0
        c_row, c_column, c_weight = row[common], column[slots[common]], weight[common]
        first = np.searchsorted(c_row, np.arange(len(some) + 1))
        weights = np.zeros((len(some), len(frequent)))
        weights[c_row, c_column] = c_weight
        slots, row, weight = slots[~common], row[~common], weight[~common]
        score = np.zeros((len(some), n))
        last = np.searchsorted(row, np.arange(len(some)), "right")
        total = np.concatenate(([0], np.cumsum(held[slots])))[last]  # postings up to a question's last
        x = 0
        while x < len(some):  # questions whose postings stay in a processor's cache
            y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + CACHED, "right")))
            own_pairs = slice(last[x - 1] if x else 0, last[y - 1])
            length = held[slots[own_pairs]]
            post = _spans(start[slots[own_pairs]], length)
            added = gain.take(post)
            added *= np.repeat(weight[own_pairs], length)
            cell = np.repeat((row[own_pairs] - x) * n, length)
            cell += doc.take(post)
            score[x:y] = np.bincount(cell, added, (y - x) * n).reshape(y - x, n)
            x = y
        for q, own_score in zip(some.tolist(), score, strict=True):
            mask = masks[questions.scopes[q]]
            if mask is not None:
                own_score[~mask] = -np.inf
        least, bound = found.least[some] - 1e-8, weights @ most
        if found.k < n and len(new := np.flatnonzero(np.isneginf(least))):  # the k-th score of this segment is theirs to begin with
            near = score[new].astype(np.float32) + weights[new].astype(np.float32) @ single
            least[new] = np.partition(near, n - found.k, axis=1)[:, n - found.k].astype(float) * (1 - 2 * NEAR) - 1e-8
        hit_rows, hit_docs = [], []
        for g, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            open_ = score[:, a:z] > np.maximum(least - bound[:, g] * (1 + 1e-12), -1e300)[:, None]
            n_open = np.count_nonzero(open_, axis=1)
            few = n_open <= FEW * (z - a)
            if not few.all():
                many = np.flatnonzero(~few)
                near = score[many, a:z].astype(np.float32)
                near += weights[many].astype(np.float32) @ single[:, a:z]
                r, d = np.nonzero(near > np.maximum(least[many] * (1 - NEAR), 0.0).astype(np.float32)[:, None] * np.float32(1 - 1e-6))
                hit_rows.append(many[r])
                hit_docs.append(d + a)
            if (some_few := np.flatnonzero(few & (n_open > 0))).size:
                r, d = np.nonzero(open_[some_few])
                hit_rows.append(some_few[r])
                hit_docs.append(d + a)
        if not hit_rows:
            continue
        row, at_ = np.concatenate(hit_rows), np.concatenate(hit_docs)
        value = score[row, at_]
        length = (first[1:] - first[:-1])[row]
        total, x = np.cumsum(length), 0
        while x < len(row):  # candidates whose frequent terms are some MEETS
            y = max(x + 1, int(np.searchsorted(total, (total[x - 1] if x else 0) + MEETS, "right")))
            term = _spans(first[row[x:y]], length[x:y])
            of = np.repeat(np.arange(y - x), length[x:y])
            value[x:y] += np.bincount(of, c_weight[term] * dense[c_column[term], at_[x:y][of]], y - x)
            x = y
        value = np.round(value, 9)  # so that equal documents tie however their terms are added
        keep = np.flatnonzero((value > 0) & (value >= found.least[some[row]]))
        keep = keep[np.lexsort((rank[at_[keep]], -value[keep], row[keep]))]
        own_row = row[keep]
        keep = keep[np.arange(len(keep)) - np.searchsorted(own_row, own_row) < found.k]
        if len(keep):
            found.add(some[row[keep]], own.lists["id"].take(pa.array(order[at_[keep]])), value[keep])
    return len(chosen)


def _asked(shared, k: int, k1: float, b: float, avgdl: float, packed: bool):
    """Segments' rows in order, or packed ones, to each question's k best of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, filters = pickle.loads(shared.value)
        found = _Found(len(questions.ids), k)
        for own in (_unpack if packed else _read)(batches, filters):
            search_postings(questions, found, own, questions.places(own.number), filters, k1, b, avgdl)
        for q, ids, score in found.best():
            yield pa.RecordBatch.from_arrays([questions.ids.take(pa.array(q)), ids, pa.array(score)], names=["query_id", "id", "score"])

    return run


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 10, k1: float = 1.5, b: float = 0.75, tokenize: Tokenizer = text.tokens, scope: Sequence[str] = ()) -> DataFrame:
    """bm25_ask over documents (id, text and the columns of scope) that are indexed for this once, in the shared folder."""
    path = f"{checkpoint_root(docs.sparkSession)}/millrace/lexical-{uuid.uuid4().hex}"
    return bm25_ask(add_documents(docs, path, tokenize, scope), queries, k, k1, b)
