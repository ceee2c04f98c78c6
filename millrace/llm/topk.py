"""Exact top-k by inner product: ball-tree branch and bound per shard.

Vectors go to the nearest of a number of centres that grows with the root of the table
(cells_for), fitted on a bounded sample (PIVOT_ROWS rows a centre, by hash); a cell's rows are dealt to shards of about SHARD_ROWS rows, so no
cell is one task. A ball around its centre holds a cell. In a shard a ball tree is built; a
query's nodes are opened in order of the bound q·c + |q|r on the inner products in their
ball, and the search ends when no bound reaches the score of the k-th best so far.

That score is shared in waves. In the first each query searches the shard that it lies in;
in the second the cells of its NEAR highest bounds; in the third all others. From the
second wave on a query goes only to cells whose bound reaches its k-th best score of the
waves before, and starts there with it; a shard that no query goes to isn't moved at all.
Bounds that equal the score still count, so ties go to the smaller id whatever the order.

Scores are integers. They are taken in floating point where no sum can leave its exact
range and in 64-bit integers otherwise. Vectors that are null, or hold null or non-finite
components, take no part. Vectors meet those of their own length only. A query is no
candidate for itself; rows that repeat an id are rows of their own, but no candidates of a
query of that id; of query rows that repeat an id the one of the smallest vector asks. A null id takes no part. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.sampling import hash_sample
from millrace.llm._store import share, stash

SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 8192, 4096, 256
CELLS, MOST_CELLS, PIVOT_ROWS, NEAR = 256, 8192, 16, 4  # cells of a table of up to 4 million rows; of any; sampled rows for each cell; cells of the second wave
PLACED = "id long, vec array<bigint>, dim int, asks boolean, deal long, cell int, away double"
ASKING = "id long, vec array<bigint>, dim int, home int, deal long, least long, cell int"
FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes (start, end, centre, radius, children) over rows in `order`."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(rows))
        self.start, self.end, self.children, centres, radii = [0], [len(rows)], [None], [], []
        at = 0
        while at < len(self.start):
            a, b = self.start[at], self.end[at]
            own = rows[self.order[a:b]]
            centre = own.mean(axis=0)
            away = np.sqrt(((own - centre) ** 2).sum(axis=1))
            centres.append(centre)
            radii.append(away.max())
            if b - a > leaf and radii[-1] > 0:
                far = own[away.argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                half = (b - a) // 2
                by = np.argpartition((own - far) @ (other - far), half)
                self.order[a:b] = self.order[a:b][by]
                self.children[at] = len(self.start)
                self.start += [a, a + half]
                self.end += [a + half, b]
                self.children += [None, None]
            at += 1
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, query: np.ndarray, length: float, rows, ids: np.ndarray, own_id: int, k: int, least: int | None) -> list[tuple[int, int]]:
        """(score, -id) of up to k best, none below least."""
        best: list[tuple[int, int]] = []
        slack = 1e-9 * (1 + length * (abs(self.centres[0]).max(initial=0.0) * len(query) + self.radii[0]))
        nodes = [(-np.inf, 0)]
        while nodes:
            bound, at = heapq.heappop(nodes)
            floor = best[0][0] if len(best) == k else least
            if floor is not None and -bound + slack < floor:
                break
            first = self.children[at]
            if first is not None:
                two = self.centres[first : first + 2] @ query + length * self.radii[first : first + 2]
                for i in (0, 1):
                    heapq.heappush(nodes, (max(bound, -float(two[i])), first + i))
                continue
            a, b = self.start[at], self.end[at]
            score = (rows[a:b] @ query).astype(np.int64) if rows.dtype == np.float64 else rows[a:b] @ query.astype(np.int64)
            for i in np.flatnonzero(score >= floor) if floor is not None else range(b - a):
                one = (int(score[i]), -int(ids[a + i]))
                if -one[1] == own_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, one)
                elif one > best[0]:
                    heapq.heapreplace(best, one)
        return best


def _matrix(col: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def _search(k: int):
    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        n, m = queries.num_rows, vectors.num_rows
        if n and m:
            q, v = _matrix(queries.column("q_vec"), n), _matrix(vectors.column("vec"), m)
            wide = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(v.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
            tree = BallTree(v.astype(np.float64))
            ids = vectors.column("id").to_numpy()[tree.order]
            rows = v[tree.order].astype(np.float64 if wide < 2**52 else np.int64)
            real = q.astype(np.float64)
            for i, (own, least) in enumerate(zip(queries.column("q_id").to_pylist(), queries.column("q_least").to_pylist(), strict=True)):
                use = real[i] if rows.dtype == np.float64 else q[i]
                found = tree.search(use, float(np.sqrt((real[i] ** 2).sum())), rows, ids, own, k, least)
                out += [(own, -b, s) for s, b in found]
        got = np.array(out, np.int64).reshape(-1, 3)
        return pa.table({c: pa.array(got[:, i].copy()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    return run


def scaled(vec: Column, factor: int) -> Column:
    """floor(factor * x) of all components, or null if the vector takes no part."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vec.isNotNull() & F.coalesce(whole, F.lit(False)), F.transform(vec, lambda x: F.floor(x.cast("double") * factor).cast("long")))


def cells_for(n: int, shard_rows: int = SHARD_ROWS) -> int:
    """How many cells n rows are cut into: one a shard at most; up to CELLS, then with the root of the table, as both a query's choice among cells and the search in those that it reaches cost time."""
    return max(1, min(-(-n // shard_rows), MOST_CELLS, max(CELLS, int(n**0.5 / 8))))


def _pivots(given: DataFrame, n: int, cells: int) -> dict[int, np.ndarray]:
    """Centres by length of vector, from at most PIVOT_ROWS rows a cell: a few rounds of k-means."""
    sample = hash_sample(given.select("id", "deal", "vec"), PIVOT_ROWS * max(CELLS, cells), "id", "deal").toArrow().sort_by([("deal", "ascending"), ("id", "ascending")])
    size, out = sample.column("vec").combine_chunks().value_lengths().to_numpy(zero_copy_only=False), {}
    for dim in np.unique(size).tolist():
        own = np.flatnonzero(size == dim)
        x = _matrix(sample.column("vec").take(pa.array(own)), len(own)).astype(np.float64).reshape(len(own), dim)
        centre = np.unique(x[: max(1, cells * len(x) // len(size))], axis=0)
        for _ in range(5):
            at = _nearest(x, centre)
            order = np.argsort(at, kind="stable")
            cuts = np.flatnonzero(np.concatenate(([True], at[order][1:] != at[order][:-1])))
            centre = np.add.reduceat(x[order], cuts, axis=0) / np.diff(np.append(cuts, len(x)))[:, None]
        out[dim] = centre
    return out


def _nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre**2).sum(axis=1) / 2
    step = max(1, (1 << 22) // len(centre))  # so that a block of products stays small
    return np.concatenate([np.zeros(0, np.int64), *((half - x[i : i + step] @ centre.T).argmin(axis=1) for i in range(0, len(x), step))])


def _place(shared):
    """Rows with the cell of the nearest centre and the distance to it; lengths without a centre have the origin."""

    def run(batches):
        pivots = pickle.loads(shared.value)
        for batch in batches:
            vec, dim = batch.column("vec"), batch.column("dim").to_numpy(zero_copy_only=False)
            cell, away = np.zeros(len(dim), np.int32), np.zeros(len(dim))
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                x = _matrix(vec.take(pa.array(at)), len(at)).astype(np.float64)
                centre = pivots.get(d, np.zeros((1, d)))
                cell[at] = _nearest(x, centre)
                away[at] = np.sqrt(((x - centre[cell[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], names=[*batch.schema.names, "cell", "away"])

    return run


def _reach(shared, near: bool):
    """A row for each cell whose bound reaches a query's score: of the NEAR highest bounds, or of the others."""

    def run(batches):
        pivots, radii = pickle.loads(shared.value)
        for batch in batches:
            vec, dim = batch.column("vec"), batch.column("dim").to_numpy(zero_copy_only=False)
            least = batch.column("least").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                q = _matrix(vec.take(pa.array(at)), len(at)).astype(np.float64)
                centre = pivots.get(d, np.zeros((1, d)))
                radius = np.array([radii.get((d, c), -1.0) for c in range(len(centre))])
                reach = np.sqrt((q**2).sum(axis=1))[:, None] * radius[None, :]
                part = q @ centre.T
                bound = np.where(radius[None, :] >= 0, part + reach + 1e-9 * (1 + np.abs(part) + reach), -np.inf)
                order = np.argsort(-bound, axis=1, kind="stable")
                order = order[:, :NEAR] if near else order[:, NEAR:]
                good = np.take_along_axis(bound, order, axis=1)
                r, c = np.nonzero((good >= least[at][:, None]) & (good > -np.inf))
                rows.append(at[r])
                cells.append(order[r, c])
            took = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(took) for k in ("id", "vec", "dim", "home", "deal", "least")), pa.array(np.concatenate(cells).astype(np.int32))], names=["id", "vec", "dim", "home", "deal", "least", "cell"])

    return run


def top_k(rows: DataFrame, is_query: Column, k: int = 5, factor: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, cells: int | None = None, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k best among all other rows, by score, then smaller id. report: gets the number of pairs (query, shard) and of those that were searched."""
    spark = rows.sparkSession
    given = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), scaled(F.col(f"`{vec_col}`"), factor).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    given = given.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).withColumn("dim", F.size("vec"))
    # dealt by a number of its own, so that repeated rows are spread; written, so that it stays what it is
    given = stash(given.select("id", "vec", "dim", "asks", F.xxhash64("id", F.monotonically_increasing_id()).alias("deal")), "vectors")
    n, asked = given.agg(F.count(F.lit(1)), F.count_if("asks")).first()
    pivots = _pivots(given, n, min(-(-n // shard_rows), cells) if cells else cells_for(n, shard_rows))
    placed = stash(given.mapInArrow(_place(share(spark, pivots)), PLACED), "placed")
    held = stash(placed.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("shards"), F.max("away").alias("radius")), "cells")
    known = held.collect()  # a row for each centre and length
    radii = {(r.dim, r.cell): r.radius for r in known}
    several = len(known) > len({r.dim for r in known}) or any(r.shards > 1 for r in known)
    shard = F.pmod("deal", "shards").cast("int").alias("shard")
    vectors = placed.join(held.select("dim", "cell", "shards"), ["dim", "cell"]).select("id", "vec", "dim", "asks", "deal", "cell", "shards", shard)
    asks = vectors.where("asks").groupBy("id").agg(F.min(F.struct("dim", "vec", "cell", "deal", "shard")).alias("q")).select("id", "q.*")
    queries = stash(asks.withColumnRenamed("cell", "home"), "queries")
    blocks = max(1, -(-asked // query_rows))

    def meet(asking: DataFrame, block: Column) -> DataFrame:
        """Queries (id, vec, least) at (dim, cell, shard) against its vectors, a block of queries a task."""
        keys = ("dim", "cell", "shard", "block")
        asking = stash(asking.withColumn("block", block.cast("int")), "asking")
        if report is not None:
            report["searched"] = report.get("searched", 0) + asking.count()
        present = asking.groupBy(*keys[:3]).agg(F.collect_set("block").alias("blocks"))  # a number a block of queries
        moved = vectors.join(present, list(keys[:3])).select("id", "vec", *keys[:3], F.explode("blocks").alias("block"))
        named = asking.select(*[F.col(c).alias(f"q_{c}") for c in (*keys, "id", "vec", "least")])
        return named.groupBy(*[f"q_{c}" for c in keys]).cogroup(moved.groupBy(*keys)).applyInArrow(_search(k), FOUND)

    def shards_of(asking: DataFrame) -> DataFrame:
        """asking at all shards of its cells but the one that each query was at first."""
        numbered = asking.join(held.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "shards"), ["dim", "cell"])
        return numbered.where((F.col("cell") != F.col("home")) | (F.col("shard") != F.pmod("deal", "shards"))).select("id", "vec", "dim", "cell", "shard", "least")

    if report is not None:
        report["pairs"] = queries.join(held.groupBy("dim").agg(F.sum("shards").alias("n")), "dim").agg(F.sum("n")).first()[0] or 0
    at_home = queries.select("id", "vec", "dim", F.col("home").alias("cell"), "shard", F.lit(None).cast("long").alias("least"))
    found = stash(meet(at_home, F.lit(0)), "topk-home")
    for near in (True, False) if several else ():
        best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")
        least = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
        asking = queries.join(least, "id", "left").select("id", "vec", "dim", "home", "deal", "least")
        asking = asking.mapInArrow(_reach(share(spark, (pivots, radii)), near), ASKING)
        found = stash(found.unionByName(meet(shards_of(asking), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)))), "topk-found")
        if max((len(c) for c in pivots.values()), default=0) <= NEAR:
            break
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
