"""Batch retrieval: many questions against a corpus.

Questions are few beside the corpus but may be more than one broadcast: they are taken in
blocks of a checked size. The corpus is scanned where it lies, and only each task's best
rows for a question cross the network. Where questions are many and the corpus fits a few
such blocks, the corpus is sent to the questions, so that these don't meet every task.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text
from millrace.functions.sampling import hash_sample
from millrace.operators.lexical import best, bm25_df, bm25_stats, bm25_topk  # noqa: F401
from millrace.sources.shared import checkpoint_root, shuffle_parts, stash

QUERY_BLOCK_MB, BLOCK_ROWS, MOST_VALUES = 64, 4 << 20, 1000  # of a broadcast block of vectors, and the rows a task holds for it; values of a column that a scan is pruned by
MEETS = 1 << 21  # products that are held at once
MANY, PIECE = 64, 1 << 14  # questions a task from which the rows are sent to the questions, where they fit few blocks; rows that are compared at once then
VECTOR_HITS = "query_id long, id long, score double"


def matching(filters: dict) -> Column:
    """Equality on each filter column that is given."""
    return reduce(lambda a, b: a & b, [F.col(c) == v for c, v in filters.items() if v is not None], F.lit(True))


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, scope: Sequence[str] = (), **filters) -> DataFrame:
    """(query_id, id, score, rank): the k rows of largest inner product for each query, ties to the smaller id.

    Vectors that are null or hold nulls take no part; vectors meet those of their own length.

    queries: query_id, embedding; corpus: id, embedding, and the columns that are filtered by.
    filters hold for all queries; scope names columns that each query filters by itself, by
    its column of that name: a string is the value that rows must have, an array holds those
    that they may have, null asks for nothing. All hold before ranking. Products are taken for
    batches of rows at once, and a task keeps k rows a query.
    """
    return _scan(queries, corpus.where(matching(filters)), k, scope)


@dataclass
class _Block:
    """Queries of one length: ids, vectors, what each filters by, and the cells that each probes (none: all rows)."""

    ids: np.ndarray
    q: np.ndarray
    scopes: list[tuple]
    probed: np.ndarray | None = None

    def __post_init__(self):
        groups: dict = {}
        for i, s in enumerate(self.scopes):
            groups.setdefault(s, []).append(i)
        self.groups = [(s, np.array(g)) for s, g in groups.items()]

    def meetings(self, own: pd.DataFrame, scope: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which rows meet which queries, as (places of rows, places of queries)."""
        every = np.arange(len(own))
        cells = own["cell"].to_numpy() if self.probed is not None else None
        parts = [(every, None)] if cells is None else [(np.flatnonzero(cells == c), self.probed[:, c]) for c in np.unique(cells)]
        fits = []
        for wanted, of in self.groups:
            mask = np.ones(len(own), bool)
            for c, allowed in zip(scope, wanted, strict=True):
                if allowed is not None:
                    mask &= own[c].isin(allowed).to_numpy()
            fits.append((mask, of))
        for at, probing in parts:
            for mask, of in fits:
                some, asking = at[mask[at]], of if probing is None else of[probing[of]]
                if len(some) and len(asking):
                    yield some, asking


class _Best:
    """The k best rows of each query that a task has met. Rows below a query's k-th score so far are not looked at again."""

    def __init__(self, n: int, k: int):
        self.k, self.parts, self.held, self.kept = k, [], 0, 0
        self.least = np.full(n, -np.inf)

    def add(self, ids: np.ndarray, of: np.ndarray, score: np.ndarray) -> None:
        """score: of rows (ids) and queries (places of)."""
        least = self.least[of]
        if self.k < len(ids) and np.isneginf(least).any():
            least = np.maximum(least, np.partition(score, len(ids) - self.k, axis=0)[len(ids) - self.k])
        row, query = np.nonzero(score >= least)
        self.parts.append((of[query], ids[row], score[row, query]))
        self.held += len(row)
        if self.held > self.kept + max(MEETS, self.kept):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, ids, scores), k at most of each query, ties to the smaller id."""
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        query, ids, score = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        order, query = order[place < self.k], query[place < self.k]
        self.parts, self.held, self.kept = [(query, ids[order], score[order])], len(order), len(order)
        last = place[place < self.k] == self.k - 1
        self.least[query[last]] = score[order][last]
        return self.parts[0]


def _scan(queries: DataFrame, corpus: DataFrame, k: int, scope: Sequence[str] = (), centres: np.ndarray | None = None, probes: int = 0) -> DataFrame:
    """The k best of all rows for each query, taken where the rows lie. centres: of the corpus's cells (column cell), of which each query probes the nearest; other cells are not read."""
    whole = F.forall("embedding", lambda x: x.isNotNull())
    queries, corpus = queries.where(whole), corpus.where(whole)
    scope = [c for c in scope if c in queries.columns]
    rows = corpus.select(F.col("id").cast("long").alias("id"), "embedding", *[F.col(c).cast("string").alias(c) for c in scope], *(["cell"] if centres is not None else []))
    context = queries.sparkSession.sparkContext
    wanted = [F.col(c) if isinstance(queries.schema[c].dataType, T.ArrayType) else F.when(F.col(c).isNotNull(), F.array(F.col(c).cast("string"))).alias(c) for c in scope]
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding", *wanted).persist()  # read for its size and by block
    size = asked.agg(F.sum(F.size("embedding")), F.count(F.lit(1))).first()
    blocks = max(1, math.ceil((size[0] or 0) * 8 / (QUERY_BLOCK_MB << 20)), math.ceil(size[1] * k / BLOCK_ROWS))
    parts = shuffle_parts(queries.sparkSession)
    if centres is None and size[1] >= MANY * parts:
        kept = rows.persist()  # read for its size and by block
        pieces = max(1, math.ceil((kept.agg(F.sum(F.size("embedding"))).first()[0] or 0) * 8 / (QUERY_BLOCK_MB << 20)))
        met = _rows_sent(asked, kept, k, scope, pieces) if 4 * pieces <= parts else None
        kept.unpersist()
        if met is not None:
            asked.unpersist()
            return met

    def scan(shared) -> Callable:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by = pickle.loads(shared.value)
            found = {dim: _Best(len(block.ids), k) for dim, block in by.items()}
            for pdf in frames:
                for dim, same in pdf.groupby(pdf["embedding"].map(len)):
                    if dim not in by:
                        continue
                    block = by[dim]
                    for a in range(0, len(same), 2048):
                        own = same.iloc[a : a + 2048]
                        x, row_ids = np.stack(own["embedding"].to_numpy()).astype(np.float64), own["id"].to_numpy()
                        for at, of in block.meetings(own, scope):
                            most = max(1, MEETS // len(at))
                            for b in range(0, len(of), most):
                                found[dim].add(row_ids[at], of[b : b + most], x[at] @ block.q[of[b : b + most]].T)
            for dim, best_ in found.items():
                query, ids, score = best_.cut()
                for a in range(0, len(query), 100_000):
                    yield pd.DataFrame({"query_id": by[dim].ids[query[a : a + 100_000]], "id": ids[a : a + 100_000], "score": score[a : a + 100_000]})

        return run

    found = []
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        got = block.toPandas()  # at most about QUERY_BLOCK_MB
        by, read = {}, rows
        for dim, x in got.groupby(got["embedding"].map(len)):
            if dim:
                scopes = [tuple(None if v is None else tuple(sorted({a for a in v if a is not None})) for v in r) for r in zip(*(x[c] for c in scope), strict=True)] if scope else [()] * len(x)
                by[dim] = _Block(x["query_id"].to_numpy(np.int64), np.stack(x["embedding"].to_numpy()).astype(np.float64), scopes)
        if centres is not None:
            by = {dim: x for dim, x in by.items() if dim == centres.shape[1]}
            for x in by.values():
                x.probed = nearest_cells(x.q, centres, probes)
            used = np.flatnonzero(np.any([x.probed.any(axis=0) for x in by.values()], axis=0)) if by else []
            read = read.where(F.col("cell").isin([int(c) for c in used]))
        for i, c in enumerate(scope):  # partitions that no query of the block asks for are not read
            values = [s[i] for x in by.values() for s in x.scopes]
            if values and None not in values and len(every := sorted({v for own in values for v in own})) <= MOST_VALUES:
                read = read.where(F.col(c).isin(every))
        # products are the work, so rows are dealt to as many tasks as the session has partitions for, however few files they lie in
        dealt = read.repartition(parts, "id")
        found.append(dealt.mapInPandas(scan(context.broadcast(cloudpickle.dumps(by))), VECTOR_HITS))
    asked.unpersist()
    return best(reduce(DataFrame.unionByName, found), k)


def _rows_sent(asked: DataFrame, rows: DataFrame, k: int, scope: Sequence[str], pieces: int) -> DataFrame:
    """The k best rows for each question, where the questions lie: rows go to them in blocks of about QUERY_BLOCK_MB, those of equal scope side by side, so that a question meets none but its own."""
    spark = asked.sparkSession
    dealt = asked.repartition(shuffle_parts(spark), "query_id")

    def meet(shared) -> Callable:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            by = pickle.loads(shared.value)
            for pdf in frames:
                for dim, same in pdf.groupby(pdf["embedding"].map(len)):
                    if dim not in by:
                        continue
                    q, asking = np.stack(same["embedding"].to_numpy()).astype(np.float64), same["query_id"].to_numpy()
                    wanted = [tuple(None if v is None else frozenset(v) for v in r) for r in zip(*(same[c] for c in scope), strict=True)] if scope else [()] * len(same)
                    best_ = _Best(len(same), k)
                    for own, of in _Block(asking, q, wanted).groups:
                        for values, ids, x in by[dim]:
                            if all(allowed is None or v in allowed for v, allowed in zip(values, own, strict=True)):
                                most = max(1, MEETS // len(ids))
                                for b in range(0, len(of), most):
                                    best_.add(ids, of[b : b + most], x @ q[of[b : b + most]].T)
                    query, ids, score = best_.cut()
                    yield pd.DataFrame({"query_id": asking[query], "id": ids, "score": score})

        return run

    found = []
    for p in range(pieces):
        got = (rows if pieces == 1 else rows.where(F.pmod(F.xxhash64("id"), F.lit(pieces)) == p)).toPandas()
        by: dict = {}
        for dim, same in got.groupby(got["embedding"].map(len)):
            for values, own in same.groupby(list(scope), dropna=False) if scope else [((), same)]:
                ids, x = own["id"].to_numpy(np.int64), np.stack(own["embedding"].to_numpy()).astype(np.float64)
                by.setdefault(dim, []).extend((values, ids[a : a + PIECE], x[a : a + PIECE]) for a in range(0, len(ids), PIECE) if dim)
        found.append(dealt.mapInPandas(meet(spark.sparkContext.broadcast(cloudpickle.dumps(by))), VECTOR_HITS))
    return best(reduce(DataFrame.unionByName, found), k)


def nearest_cells(q: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Which cells each query probes: those whose centres have the largest inner products."""
    probed = np.zeros((len(q), len(centres)), bool)
    np.put_along_axis(probed, np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes], True, axis=1)
    return probed


@dataclass(frozen=True)
class VectorIndex:
    """An inverted file: the centres of its cells, and its rows as Parquet by cell."""

    path: str

    def centres(self, spark: SparkSession) -> np.ndarray:
        got = spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()  # as many as there are cells
        return np.array([r.centre for r in got])

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/cells")


def build_vector_index(corpus: DataFrame, path: str, cells: int = 128, sample: int = 50_000, seed: int = 42) -> VectorIndex:
    """A new index at path over corpus (id, embedding and any other columns).

    Centres are fitted by k-means on at most `sample` rows of different ids, by hash; then
    all rows are added. Vectors that are null or hold nulls take no part.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = corpus.sparkSession
    rows = corpus.where(F.forall("embedding", lambda x: x.isNotNull())).select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    taken = hash_sample(rows, sample, "id").withColumn("features", array_to_vector("embedding"))
    model = KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features", predictionCol="cell").fit(taken)
    centres = [(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())]
    spark.createDataFrame(centres, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return add_vectors(corpus, VectorIndex(path))


def add_vectors(corpus: DataFrame, index: VectorIndex) -> VectorIndex:
    """Append rows to the cells of an index, without fitting it again. A cell of many rows is split over tasks and files by its size; vectors of another length than the centres' are an error."""
    spark = corpus.sparkSession
    centres = index.centres(spark)
    shared = spark.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def cell_of(vectors: pd.Series) -> pd.Series:
        own = shared.value
        x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, own.shape[1]))
        return pd.Series(((own**2).sum(axis=1) / 2 - x @ own.T).argmin(axis=1))

    rows = corpus.where(F.forall("embedding", lambda x: x.isNotNull())).withColumn("cell", cell_of("embedding"))
    rows.hint("rebalance", "cell").write.mode("append").partitionBy("cell").parquet(f"{index.path}/cells")
    return index


def ivf_ask(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int = 16, scope: Sequence[str] = (), **filters) -> DataFrame:
    """Approximate top-k, as vector_topk: each query meets the rows of the cells whose centres are nearest to it; files of cells that no query probes are not read."""
    spark = queries.sparkSession
    return _scan(queries, index.rows(spark).where(matching(filters)), k, scope, index.centres(spark), probes)


def ivf_topk(queries: DataFrame, corpus: DataFrame, k: int = 10, cells: int = 128, probes: int = 16, sample: int = 50_000, seed: int = 42) -> DataFrame:
    """ivf_ask over a corpus that is indexed for this once, in the shared folder."""
    path = f"{checkpoint_root(corpus.sparkSession)}/millrace/vectors-{uuid.uuid4().hex}"
    rows = stash(corpus.select("id", "embedding"), "vectors")  # read for the sample and for the cells
    return ivf_ask(build_vector_index(rows, path, cells, sample, seed), queries, k, probes)


def rrf_fuse(lists: Sequence[tuple[DataFrame, float]], k: int = 10, constant: int = 60) -> DataFrame:
    """(query_id, id, fused_score, rank) of weighted ranked lists (query_id, id, rank): the sum of weight / (constant + rank)."""
    parts = [hits.select("query_id", "id", (F.lit(float(w)) / (constant + F.col("rank"))).alias("part")) for hits, w in lists]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.sum("part").alias("fused_score"))
    return best(fused, k, "fused_score")


def hybrid_topk(vector_hits: DataFrame, bm25_hits: DataFrame, k: int = 10, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Both lists fused; score is the vector list's, null for what only BM25 found."""
    fused = rrf_fuse(((vector_hits, weights[0]), (bm25_hits, weights[1])), k)
    return fused.join(vector_hits.select("query_id", "id", "score"), ["query_id", "id"], "left")


def token_overlap(pairs: pd.DataFrame) -> pd.Series:
    """A pair scorer without a model: the share of the question's words that the text has."""
    return pd.Series([len(set(q.split()) & set(t.split())) / max(1, len(set(q.split()))) for q, t in zip(pairs["query"].fillna(""), pairs["text"].fillna(""), strict=True)])


def rerank(hits: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series] | None, k: int = 5) -> DataFrame:
    """hits (query_id, id, query, text, score, rank) by a pair scorer, with relevance, original_rank, new_rank and scored; without a scorer, or for batches where it fails, the original score counts and scored is false."""
    relevance = F.coalesce(F.col("score"), F.lit(0.0)).cast("double")
    if scorer is None:
        scored = hits.withColumns({"relevance": relevance, "scored": F.lit(False)})
    else:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                done = True
                try:
                    got = scorer(pdf[["query", "text"]]).to_numpy(float)
                except Exception:  # a scorer is the caller's; its failure leaves the order as it was, and says so
                    got, done = pdf["score"].fillna(0.0).to_numpy(float), False
                yield pdf.assign(relevance=got, scored=done)

        scored = hits.mapInPandas(run, T.StructType([*hits.schema, T.StructField("relevance", T.DoubleType()), T.StructField("scored", T.BooleanType())]))
    order = W.partitionBy("query_id").orderBy(F.desc("relevance"), "rank", "id")
    ranked = scored.withColumns({"original_rank": F.col("rank"), "new_rank": F.row_number().over(order)})
    return ranked.where(F.col("new_rank") <= k).drop("rank")


def score_filter(hits: DataFrame, least: float = 0.2, k: int = 5, score: str = "score", rank: str = "rank") -> DataFrame:
    """Hits of at least `least`, k at most; the first one where none reaches it. least <= 0 changes nothing. A null score counts as below."""
    if least <= 0:
        return hits
    own = W.partitionBy("query_id")
    good = F.coalesce(F.col(score) >= least, F.lit(False))
    x = hits.withColumns({"__good": good, "__any": F.max(good).over(own), "__place": F.row_number().over(own.orderBy((~good).cast("int"), rank))})
    return x.where((F.col("__good") & (F.col("__place") <= k)) | (~F.col("__any") & (F.col("__place") == 1))).drop("__good", "__any", "__place")


def sources(hits: DataFrame, chars: int = 200) -> DataFrame:
    """Hits as answer sources: text cut, page, section, type, rounded score."""
    return hits.select("query_id", "rank", "id", text.cut(F.col("text"), chars).alias("text"), F.col("page_start").alias("page"), "section", "content_type", F.round("score", 4).alias("score"))


def compound_query(sub_queries: Column, query: Column) -> Column:
    """Several sub-questions as one search text: distinct ones, in order, joined by spaces."""
    return F.when(F.size(sub_queries) > 1, F.array_join(F.array_distinct(sub_queries), " ")).otherwise(query)


def prompt_messages(questions: DataFrame, hits: DataFrame, history: DataFrame, system: str, before: str | None = None) -> DataFrame:
    """(query_id, messages): the system text with the contexts below, history in order, then the question.

    questions: query_id, session_id, query; hits: query_id, rank, text; history: session_id, turn, role, content.
    before: the questions' column with their turn, for history of earlier turns only. Hits may
    carry session_id and that column, else they are looked up.
    """
    said = F.struct("turn", "role", "content")
    text_ = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["text"]), "\n\n")
    message = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    head = F.when(F.coalesce("context", F.lit("")) != "", F.concat(F.lit(system + "\n\n"), F.col("context"))).otherwise(system)
    none = F.array().cast("array<struct<role:string,content:string>>")
    spoken = lambda h: F.coalesce(F.transform(h, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))), none)
    made = lambda h: F.concat(message("system", head), spoken(h), message("user", F.col("query"))).alias("messages")
    # contexts go to their questions' sessions, once, and histories grow there: a session's turns are read in order and no history is sent anywhere
    turn = before or "turn"
    own = questions.select("query_id", "session_id", (F.col(before) if before else F.lit(None).cast("int")).alias("turn"), "query")
    placed = hits if {"session_id", turn} <= {*hits.columns} else hits.select("query_id", "rank", "text").join(own.drop("query").withColumnRenamed("turn", turn), "query_id")
    contexts = placed.select("query_id", "session_id", (F.col(turn) if before else F.lit(None).cast("int")).alias("turn"), F.struct("rank", "text").alias("c"))
    turns = history.select("session_id", "turn", said.alias("said"))
    rows = turns.unionByName(own.withColumn("asks", F.lit(True)), allowMissingColumns=True).unionByName(contexts, allowMissingColumns=True)
    dealt = rows.repartition(shuffle_parts(questions.sparkSession), "session_id")
    found = dealt.withColumn("context", text_(F.collect_list("c").over(W.partitionBy("session_id", "turn", "query_id")))).where(F.col("c").isNull()).drop("c")
    session = W.partitionBy("session_id")
    told = found.withColumn("h", F.array_sort(F.collect_list("said").over(session.orderBy("turn").rangeBetween(W.unboundedPreceding, -1) if before else session)))
    return told.where("asks").select("query_id", made(F.col("h")))
