"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become words ([a-z0-9] after lower-casing A-Z, and all beyond ASCII) joined by one
space. Patterns are the windows of an item's words, 13 by default; an item of fewer words
is one window. A space before and after makes a pattern match whole words only.

Patterns of like length form a table: with m the least length in it, the last block of
a window of m bytes is looked up in the shift table. A block that no pattern has within
its first m bytes moves the window past itself; a block inside some patterns moves it to
their nearest alignment; a shift of zero selects, by the hash of that block, the patterns
whose first m bytes end with it, and these are compared with the text byte by byte. The
text is cut into lanes that are scanned together, each by its own shifts.

The benchmark is cut into sets of about MAX_PATTERNS windows, which are counted first; a
long item is cut into pieces that overlap by a window. One set is what a pass over the
documents broadcasts, and its tables grow with its patterns, up to 2**MAX_BITS shifts. More
sets mean more passes; what they hit is joined by the text's SHA-256, texts that many
documents share without an exchange, so no benchmark is too large.

Null texts and texts without words have no hits. An item whose text is null has no window;
an item with a null id takes part in hits but is not counted or listed. Items that share
an id count as one. An empty benchmark hits nothing. Input columns with the names of the
result's are replaced.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._store import keep_columns, share, skew_join, small_batches, stash
from millrace.llm._text import alnum_table, blocks, buffers, with_columns

MAX_PATTERNS, PIECE = 200_000, 20_000  # windows of a set, and of a piece of a long item
LANE = 2048
#: Classes of pattern length in bytes, and the block that each looks up (fixed values).
CLASSES = ((48, 16), (24, 12), (12, 6), (0, 3))
MIN_BITS, MAX_BITS, CHUNK = 16, 24, 4096  # of a shift table's size, and patterns entered into it at once
NEW = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
RESULT = [T.StructField(n, t) for n, t in zip(NEW, (T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.BooleanType()), strict=True)]
TABLE = bytes(b or 32 for b in alnum_table())


def normal(text: bytes) -> bytes:
    """Words with one space before, between and after; nothing if there are none."""
    words = text.translate(TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b""


def _block_hash(data: np.ndarray, at: np.ndarray, block: int) -> np.ndarray:
    """Hashes of the blocks that start at `at`."""
    h = np.zeros(len(at), np.uint64)
    for i in range(0, block, 8):
        n = min(8, block - i)
        shape = max(0, len(data) - n + 1)
        if n == 8:
            part = np.ndarray(shape, "<u8", data, strides=(1,))[at + i]
        else:
            part = np.zeros(len(at), np.uint64)
            for k in range(n):
                part |= data[at + i + k].astype(np.uint64) << np.uint64(8 * k)
        h = (h ^ part) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


class WuManber:
    """Shift table, buckets by hash of a block, and the patterns of one class of length."""

    def __init__(self, patterns: list[bytes], block: int):
        self.patterns, self.m = patterns, min(map(len, patterns))
        self.block = min(block, self.m)
        steps = self.m - self.block + 1
        # a table of eight places for each block keeps most shifts long; windows of one item share their blocks
        self.bits = int(np.clip(np.ceil(np.log2(8.0 * (len(patterns) * 8 + steps))), MIN_BITS, MAX_BITS))
        self.shift = np.full(1 << self.bits, steps, np.uint8 if steps < 256 else np.uint16 if steps < 65536 else np.uint32)
        last = []
        for a in range(0, len(patterns), CHUNK):
            own = patterns[a : a + CHUNK]
            data = np.frombuffer(b"".join(p[: self.m] for p in own), np.uint8)
            at = (np.arange(len(own))[:, None] * self.m + np.arange(steps)[None, :]).ravel()
            h = _block_hash(data, at, self.block)
            np.minimum.at(self.shift, self.place(h), np.tile(np.arange(steps)[::-1], len(own)).astype(self.shift.dtype))
            last.append(h.reshape(-1, steps)[:, -1].copy())
        last = np.concatenate(last)
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.last = last[self.order]

    def place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, data: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and pattern numbers of all occurrences."""
        end = len(data) - self.m  # the last place that a pattern may start at
        if end < 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lane = np.arange(0, end + 1, LANE)
        stop = np.minimum(lane + LANE, end + 1)
        found_at, found = [], []
        tail = self.m - self.block
        while len(lane):
            h = _block_hash(data, lane + tail, self.block)
            step = self.shift[self.place(h)].astype(np.int64)
            zero = np.flatnonzero(step == 0)
            if len(zero):
                low, high = np.searchsorted(self.last, h[zero], "left"), np.searchsorted(self.last, h[zero], "right")
                for k in np.flatnonzero(high > low):
                    p = int(lane[zero[k]])
                    for i in self.order[low[k] : high[k]]:
                        if raw.startswith(self.patterns[i], p):
                            found_at.append(p)
                            found.append(int(i))
                step[zero] = 1
            lane = lane + step
            on = lane < stop
            if not on.all():
                lane, stop = lane[on], stop[on]
        return np.array(found_at, np.int64), np.array(found, np.int64)


def build(items: list[tuple[str | None, bytes]], window: int) -> list[tuple[WuManber, list[tuple], list[int]]]:
    """Tables with, for each pattern, the ids of its items and its number of words."""
    by: dict[bytes, set] = {}
    for item, text in items:
        words = normal(text).split()
        for i in range(max(1, len(words) - window + 1) if words else 0):
            by.setdefault(b" " + b" ".join(words[i : i + window]) + b" ", set()).add(item)
    out, top = [], None
    for least, block in CLASSES:
        own = sorted(p for p in by if len(p) >= least and (top is None or len(p) < top))
        top = least
        if own:
            out.append((WuManber(own, block), [tuple(by[p]) for p in own], [p.count(b" ") - 1 for p in own]))
    return out


def _hits(tables, texts: list[bytes]) -> list[tuple[int, np.ndarray, list[str]]]:
    """For each normal text: number of words, the words that are hit, and the items that occur."""
    raw = b"\0".join(texts) + b"\0"
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    flat = np.frombuffer(raw, np.uint8)
    words: dict[int, set] = {}
    items: dict[int, set] = {}
    for table, ids, sizes in tables:
        starts, which = table.find(flat, raw)
        for d, p, k in zip(np.searchsorted(at, starts, "right") - 1, starts, which, strict=True):
            items.setdefault(d, set()).update(x for x in ids[k] if x is not None)
            words.setdefault(d, set()).add((int(p - at[d]), sizes[k]))
    out = []
    for d, text in enumerate(texts):
        n, hit = max(0, text.count(b" ") - 1), np.zeros(0, np.uint32)
        if d in words:
            spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            edge = np.zeros(n + 1, np.int64)
            for p, size in words[d]:
                first = int(np.searchsorted(spaces, p))
                edge[first] += 1
                edge[first + size] -= 1
            hit = np.flatnonzero(np.cumsum(edge[:-1]) > 0).astype(np.uint32)
        out.append((n, hit, sorted(items.get(d, ()))))
    return out


def _verdict(n: int, hit: np.ndarray, items: list[str], times: int) -> tuple:
    """A result's columns."""
    return n, len(hit), len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), len(hit) > 0 and times * len(hit) >= n


def _columns(rows: list[tuple]) -> dict[str, pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return dict(zip(NEW, (pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 5, kinds, strict=True)), strict=True))


def _scan(shared, text_col: str, fields: list[str], finish):
    """finish(batch, found) gives what a batch becomes, found being a triple for each row."""

    def run(batches):
        tables = pickle.loads(shared.value)
        for batch in batches:
            data, off = buffers(batch.column(text_col))
            found = []
            for i, j in blocks(off):
                found += _hits(tables, [normal(data[a:b].tobytes()) for a, b in zip(off[i:j], off[i + 1 : j + 1], strict=True)])
            yield finish(batch, found).select(fields)

    return run


def _join_passes(times: int, fields: list[str]):
    """Whole texts with what several passes hit to the result's columns."""

    def run(batches):
        for batch in batches:
            data, off = buffers(batch.column("text"))
            rows = []
            for a, b, hits, items in zip(off[:-1], off[1:], batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True):
                hit = np.unique(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(x, np.uint32) for x in hits or ())]))
                rows.append(_verdict(len(normal(data[a:b].tobytes()).split()), hit, sorted({x for part in items or () for x in part}), times))
            yield with_columns(batch, {"text", "sha", "hits", "items"}, _columns(rows)).select(fields)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, times: int = 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256 and contaminated.

    contaminated: a word is hit and times * n_hit >= n_words. items_sha256: of the ids of
    the items with windows in the text, sorted as strings and joined by commas.
    """
    docs = keep_columns(docs, NEW, text_col)
    pieces, sets = _pieces(benchmark, item_col, item_text, window, max_patterns)
    if sets == 1:
        schema = T.StructType([*docs.schema, *RESULT])
        finish = lambda batch, found: with_columns(batch, set(), _columns([_verdict(*f, times) for f in found]))
        return docs.mapInArrow(_scan(_tables(pieces, window, 1, 0), text_col, schema.names, finish), schema)
    # One pass for each set; the same text has the same hits wherever it stands.
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("text"), F.sha2(text, 256).alias("sha"))

    def pack(batch, found):
        some = pa.array([len(f[1]) > 0 for f in found], pa.bool_())
        new = {"hits": pa.array([f[1].tobytes() for f in found], pa.binary()), "items": pa.array([f[2] for f in found], pa.list_(pa.string()))}
        return with_columns(batch, {"text"}, new).filter(some)

    found = None
    for k in range(sets):
        one = keyed.select("sha", "text").mapInArrow(_scan(_tables(pieces, window, sets, k), "text", ["sha", "hits", "items"], pack), "sha string, hits binary, items array<string>")
        one = stash(one.dropDuplicates(["sha"]), "hits")
        found = one if found is None else found.unionByName(one)
    joined = stash(found.groupBy("sha").agg(F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items")), "all-hits")  # a row a set
    full = skew_join(keyed, joined, "sha", "left").select("doc", "text", "sha", "hits", "items")
    schema = T.StructType([keyed.schema["doc"], *RESULT])
    return full.mapInArrow(_join_passes(times, schema.names), schema).select("doc.*", *NEW)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, times: int = 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_patterns: int = MAX_PATTERNS) -> DataFrame:
    """docs that are not contaminated, with their own columns; each set of the benchmark is a pass."""
    pieces, sets = _pieces(benchmark, item_col, item_text, window, max_patterns)
    if sets > 1:
        columns = [F.col(f"`{c}`") for c in docs.columns]
        marked = contamination(docs.select(F.struct(*columns).alias("__doc"), F.col(f"`{text_col}`").alias("text")), benchmark, window, times, "text", item_col, item_text, max_patterns)
        return marked.where(~F.col("contaminated")).select("__doc.*")
    finish = lambda batch, found: batch.filter(pa.array([not _verdict(*f, times)[-1] for f in found], pa.bool_()))
    return docs.mapInArrow(_scan(_tables(pieces, window, 1, 0), text_col, docs.columns, finish), docs.schema)


def _pieces(benchmark: DataFrame, item_col: str, item_text: str, window: int, max_patterns: int) -> tuple[DataFrame, int]:
    """(item, text) of different items, long ones in pieces, and the number of sets that their windows make."""
    small_batches(benchmark.sparkSession)
    text = F.translate(F.col(f"`{item_text}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(text, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0).distinct()
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)), F.lit(PIECE))
    pieces = items.select("item", F.explode(starts).alias("at"), "words").select("item", F.slice("words", F.col("at"), F.lit(PIECE + window - 1)).alias("words"))
    pieces = stash(pieces.select("item", F.greatest(F.size("words") - window + 1, F.lit(1)).alias("windows"), F.array_join("words", " ").alias("text")), "items")
    total = pieces.agg(F.sum("windows")).first()[0] or 0
    return pieces, max(1, -(-total // max_patterns))


def _tables(pieces: DataFrame, window: int, sets: int, k: int):
    """The tables of one set of pieces, to be broadcast; a set has about an equal share of all windows."""
    own = pieces if sets == 1 else pieces.where(F.pmod(F.xxhash64("item", "text"), F.lit(sets)) == k)
    return share(pieces.sparkSession, build([(r.item, r.text.encode()) for r in own.collect()], window))
