"""SimHash fingerprints and groups of near copies, by deletion-variant signatures.

A fingerprint has 64 bits, one for each bit of the shingles' XXH64 hashes that is set in
more than half of them. Fingerprints that differ in at most three bits are linked. Cut
into two segments of 32 bits, one segment of two linked fingerprints differs in at most
one bit; so each fingerprint is indexed under the 32 variants of either segment with one
bit deleted, equal variants are brought together, and each meeting is verified on all 64
bits. Exact copies share one fingerprint and count once from the start.

A variant's crowd is never turned into all pairs: within it the links found join into
trees, and a tree's edges leave the task, one less than it has members. Crowds are known
to be small before any is gathered: fingerprints are counted by each segment with one byte
blanked, a group that holds the crowds of that byte's eight variants. Where it has more
than CROWD fingerprints its variants are dealt by the bytes of their other segment too (of
three differing bits over four bytes one byte is the same), which leaves 25 free bits and
so at most 2²⁵ fingerprints, whatever the corpus; a task cuts these into pieces again until
a crowd is small, so none is compared pair by pair. Components come from repeated joins over
the trees' edges, cut by checkpoints; keys that many rows share, a large component's root
or the fingerprint of many copies, are joined without an exchange.

Null and empty texts, and those of no words, have fingerprint zero and are linked like
any other. The caller's columns keep to a struct, so none clashes with ours. Fewer words than a shingle make one shingle. Repeated rows and repeated ids
each count; a null id is never a group's smallest unless all its ids are null. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._store import heavy_keys, keep_columns, release, shuffle_parts, skew_join, small_batches, stash, stashed
from millrace.llm._text import buffers, with_columns

SEED, SEGMENT, CROWD = 42, 32, 4096
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
NEW = ["fingerprint", "component_id"]


def fingerprint_of(text: bytes, shingle: int) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):  # so that a long text needs no more memory than a short one
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column("text"))
            prints = np.array([fingerprint_of(data[a:b].tobytes(), shingle) for a, b in zip(off[:-1], off[1:], strict=True)], np.uint64)
            yield with_columns(batch, {"text"}, {"print": pa.array(prints.view(np.int64), pa.int64())})

    return run


def fingerprints(docs: DataFrame, shingle: int, text_col: str) -> DataFrame:
    """(doc, print): docs' columns but text_col in a struct, and the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc")
    x = docs.select(others, F.col(f"`{text_col}`").cast("binary").alias("text"))
    return x.mapInArrow(_fingerprints(shingle), T.StructType([x.schema["doc"], T.StructField("print", T.LongType())]))


def _links(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= bits


def _forest(prints: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges of trees that span what is linked in a crowd of different fingerprints.

    Up to CROWD of them, each new member is compared at once with all that no tree has taken
    yet. A larger crowd is parted: the places at which its members differ are cut into one
    piece more than links may have bits, so linked members agree in a piece; members are
    sorted by each piece in turn, and those that agree in it are a smaller crowd that differs
    at fewer places.
    """
    if len(prints) > CROWD:
        differ = int(np.bitwise_or.reduce(prints ^ prints[0]))
        if differ.bit_count() <= bits:  # all are linked
            return [(int(prints[0]), int(x)) for x in prints[1:]]
        return _spanning(e for some in _parted(prints, differ, bits) for e in _forest(some, bits))
    left, edges = np.sort(prints), []
    while len(left):
        reached, left = left[:1], left[1:]
        while len(reached) and len(left):
            at, reached = reached[-1], reached[:-1]
            near = _links(left, at, bits)
            if near.any():
                edges += [(int(at), int(x)) for x in left[near]]
                reached, left = np.concatenate((reached, left[near])), left[~near]
    return edges


def _parted(prints: np.ndarray, differ: int, bits: int) -> Iterator[np.ndarray]:
    """Crowds of those that agree in a piece, for each piece of the places at which prints differ."""
    places = np.array([b for b in range(64) if differ >> b & 1], np.uint64)
    for piece in np.array_split(places, bits + 1):
        own = prints & np.uint64(sum(1 << int(b) for b in piece))
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1])))
        for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
            if b - a > 1:
                yield prints[order[a:b]]


def _spanning(edges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those edges that join trees that no edge before has joined."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = root[x]
        return x

    kept = []
    for a, b in edges:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _verify(bits: int):
    """Rows in order of their key to tree edges within each key."""

    def crowd(prints):
        prints = np.unique(prints)
        return _forest(prints, bits) if len(prints) > 1 else []

    def run(batches):
        tail_key, tail = None, np.zeros(0, np.uint64)
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False)
            prints = batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(prints):
                continue
            cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(cuts, len(prints)))
            edges = []
            if tail_key is not None and key[0] == tail_key:
                tail = np.concatenate((tail, prints[: size[0]]))
                if len(cuts) == 1:
                    continue
            else:
                edges += crowd(tail)
                tail = prints[: size[0]]
            if len(cuts) > 1:
                edges += crowd(tail)
                two = cuts[1:-1][size[1:-1] == 2]
                near = _links(prints[two], prints[two + 1], bits) & (prints[two] != prints[two + 1])
                edges += zip(prints[two][near].tolist(), prints[two + 1][near].tolist(), strict=True)
                for c, n in zip(cuts[1:-1], size[1:-1], strict=True):
                    if n > 2:
                        edges += crowd(prints[c : c + n])
                tail = prints[cuts[-1] :]
            tail_key = key[-1]
            yield _edges(edges)
        yield _edges(crowd(tail))

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    got = np.array(sorted(set(pairs)), np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])


def links(prints: DataFrame, bits: int = 3) -> DataFrame:
    """Edges (a, b) between different fingerprints at most `bits` (up to 3) bits apart that join all that are linked. prints: distinct longs in `print`."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one deleted bit find up to three differing bits")
    parts = shuffle_parts(prints.sparkSession)
    low = F.lit((1 << SEGMENT) - 1)
    half = (F.col("print").bitwiseAND(low), F.shiftrightunsigned("print", SEGMENT))

    def blanked(segment: int, width: int) -> Column:
        """A key for each run of `width` bits of a segment: the number of the run, then the segment without it, in one long."""

        def one(i: Column) -> Column:
            others = low.bitwiseXOR(F.call_function("shiftleft", F.lit((1 << width) - 1).cast("long"), i * width))
            return (F.lit(segment * SEGMENT // width) + i).cast("long") * F.lit(1 << SEGMENT) + half[segment].bitwiseAND(others)

        return F.transform(F.sequence(F.lit(0), F.lit(SEGMENT // width - 1)), one)

    # a row becomes 64, so the rows are dealt out first: a table of a few files would be a few tasks
    dealt = prints.select("print").repartition(parts, "print")
    around = dealt.select(F.explode(F.concat(blanked(0, 8), blanked(1, 8))).alias("around"))
    crowded = stash(around.groupBy("around").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("around"), "simhash-crowded")
    rows = dealt.select("print", F.explode(F.concat(blanked(0, 1), blanked(1, 1))).alias("key"))
    n = crowded.count()
    if n:
        at, rest = F.shiftrightunsigned("key", SEGMENT), F.col("key").bitwiseAND(low)
        byte = F.call_function("shiftrightunsigned", at, F.lit(3))  # the byte that the deleted bit lies in
        others = low.bitwiseXOR(F.call_function("shiftleft", F.lit(255).cast("long"), (byte % 4 * 8).cast("int")))
        rows = rows.withColumn("around", byte * F.lit(1 << SEGMENT) + rest.bitwiseAND(others))
        marked = crowded.withColumn("crowd", F.lit(True))
        rows = rows.join(F.broadcast(marked) if n <= 1_000_000 else marked.hint("merge"), "around", "left")
        other = F.when(at < SEGMENT, half[1]).otherwise(half[0])
        finer = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.col("key") + (F.lit(1) + i * 256 + F.call_function("shiftrightunsigned", other, i * 8).bitwiseAND(F.lit(255))) * F.lit(1 << (SEGMENT + 6)))
        rows = rows.select("print", F.explode(F.when(F.col("crowd"), finer).otherwise(F.array("key"))).alias("key"))
    # most keys are alone; one exchange brings the others together, in order
    met = rows.withColumn("count", F.count(F.lit(1)).over(W.partitionBy("key"))).where(F.col("count") > 1).select("key", "print")
    return met.mapInArrow(_verify(bits), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b); root is the smallest node reachable. Each round halves the distances: nodes take the smallest root around them, then their root's root."""
    both = stash(edges.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("near"))), "simhash-edges")
    hubs = heavy_keys(both, "near")
    kept = set(stashed(edges.sparkSession))
    roots = stash(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("root")), "simhash-roots")
    while True:
        before = set(stashed(edges.sparkSession)) - kept  # roots that this round replaces
        near = skew_join(both, roots.select(F.col("node").alias("near"), "root"), "near", heavy=hubs).groupBy("node").agg(F.min("root").alias("best"))
        # what a node learns is passed to its root as well, so that whole trees move at once
        told = roots.join(near.hint("merge"), "node").select(F.explode(F.array(F.col("node"), F.col("root"))).alias("node"), "best").groupBy("node").agg(F.min("best").alias("best"))
        hooked = stash(roots.join(told.hint("merge"), "node", "left").select("node", F.col("root").alias("was"), F.least("root", "best").alias("root")), "simhash-hooked")
        over = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = stash(skew_join(hooked, over, "root", "left").select("node", "was", F.least("root", "next").alias("root")), "simhash-roots")
        if not new.where(F.col("was") != F.col("root")).limit(1).count():
            return new.select("node", "root")
        roots = new.select("node", "root")
        release(edges.sparkSession, sorted(before))


def grouped(docs: DataFrame, id_col: str, bits: int, shingle: int, text_col: str) -> DataFrame:
    """(doc, print, root, component_id) for each row of docs: its columns but the text in a struct, the fingerprint, and its group's smallest fingerprint and id."""
    printed = stash(fingerprints(docs, shingle, text_col), "simhash-prints")
    distinct = stash(printed.groupBy("print").agg(F.min(f"doc.`{id_col}`").alias("least")), "simhash-distinct")
    found = components(links(distinct.select("print"), bits))
    rooted = stash(distinct.join(found.withColumnRenamed("node", "print").hint("merge"), "print", "left").withColumn("root", F.coalesce("root", "print")), "simhash-rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stash(skew_join(rooted, groups, "root").select("print", "root", "component_id"), "simhash-groups")
    return skew_join(printed, by_print, "print")


def simhash_groups(docs: DataFrame, bits: int = 3, shingle: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each row of docs: its columns but text_col, fingerprint (16 hex digits) and component_id."""
    docs = keep_columns(docs, NEW, text_col, id_col)
    return grouped(docs, id_col, bits, shingle, text_col).select("doc.*", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, bits: int = 3, shingle: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with one row of each group: one of the smallest id (null ids last); rows equal in id and text are one row, known by two 64-bit hashes."""
    own = (F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    key = F.concat(F.hex(F.xxhash64(*own)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *reversed(own))))
    groups = grouped(docs.select(own[0].alias("id"), own[1].alias("text"), key.alias("row")), "id", bits, shingle, "text").select("doc.*", "root")
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id").alias("id"), "row")).alias("best"))
    rows = stash(groups.groupBy("row").count(), "simhash-rows")
    total = rows.agg(F.sum("count")).first()[0] or 0
    often = [r.row for r in rows.where(F.col("count") > max(1.0, total / 1000)).collect()]  # fewer than a thousand
    stay = stash(best.select(F.col("best.row").alias("row")).join(rows.hint("merge"), "row"), "simhash-stay")
    again = stay.where(F.col("count") > 1)
    rowed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), key.alias("row"))
    kept = skew_join(rowed, stay.select("row"), "row", "left_semi", often)
    if again.limit(1).count():
        kept = kept.dropDuplicates(["row"])
    return kept.select("doc.*")
