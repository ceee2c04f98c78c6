"""Removal of long repeated word sequences, by difference-cover anchors.

A window is `window` consecutive words of one document. A word goes if a window that
covers it has a word sequence that starts at any other place of the corpus too.

1. Anchors: sequences of window - period + 1 words are hashed only where the word's
   number modulo `period` lies in a perfect difference set. For any two places some shift
   below the period brings both onto the set, so two equal windows share an anchor that
   starts at such a place in both. Anchors that occur once are forgotten.
2. Extension: around each repeated anchor every window that holds it is hashed whole
   (96 bits); windows whose hash occurs again are repeated.
3. The covered words are cut out.

Hashes are counted, never paired, so a passage in a third of all documents costs its own
rows. Each task sends a hash once however often it met it, so no partition gets all of a
common line. Texts cross the network once: all three steps read the same exchange.

A part's hashes lie in memory, so there are as many parts as the session deals rows to, and
more where the texts, whose bytes are counted first, are over PART_BYTES a part. Rows are
known by a 64-bit hash; the same first pass finds different rows that share one (a second
hash tells), and these go by their second hash.

Null texts have no words. Empty tables give empty results. Repeated rows count as
separate places. The caller's columns keep to a struct, so none clashes with ours; input
columns with the names of the result's are replaced.
"""

from __future__ import annotations

import hashlib
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._store import keep_columns, shuffle_parts, small_batches
from millrace.llm._text import WORD_BASE_2, Words, blocks, buffers, mix, runs, space_table, with_columns

#: Perfect difference sets by period (fixed values): every non-zero remainder is one difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

PART_BYTES = 64 << 20
FLUSH = 1 << 18  # hashes that a task gathers before it deals them out
DEALT = "part int, hashes binary, checks binary, docs binary, places binary, known binary, keys binary"
ROUTED = "part int, keys binary, places binary"
MARKS = "`__key` long, `__marks` binary"
NEW = ["n_words", "n_removed", "kept_sha256"]


def _repeated(h: np.ndarray, check: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that brings equal hashes together; where a run starts; what is in a run of several or of a known one."""
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if len(check):
        differ = check[order][1:] != check[order][:-1]
        if (same & differ).any():
            order = np.lexsort((check, h))
            same, differ = h[order][1:] == h[order][:-1], check[order][1:] != check[order][:-1]
        same &= ~differ
    first = np.concatenate(([True], ~same)) if len(h) else np.zeros(0, bool)
    if not len(h):
        return order, first, first
    run = np.cumsum(first) - 1
    several = (np.bincount(run) > 1) | (np.bincount(run, known[order]) > 0)
    return order, first, several[run]


def _deal(parts: int, h, check, doc, place, keys):
    """Rows to send: each different hash once, to the part that its bits name; places known to repeat as they are."""
    order, first, repeats = _repeated(h, check, np.zeros(len(h), np.uint8))
    known = np.zeros(len(h), np.uint8)
    known[order[repeats]] = 1
    send = np.sort(order[first])
    part = ((h[send] >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)
    by = np.argsort(part, kind="stable")
    send, part = send[by], part[by]
    cuts = np.flatnonzero(np.diff(part)) + 1
    rows = [(int(part[a]), send[a:b], True) for a, b in zip([0, *cuts], [*cuts, len(send)], strict=True) if b > a]
    local = np.flatnonzero(known)
    step = 1 << 16
    rows += [(int((h[local[a]] >> np.uint64(32)) % np.uint64(parts)), local[a : a + step], False) for a in range(0, len(local), step)]
    out = {k: [] for k in ("part", "hashes", "checks", "docs", "places", "known", "keys")}
    for p, at, hashed in rows:
        used, small = np.unique(doc[at], return_inverse=True)
        out["part"].append(p)
        out["hashes"].append(h[at].tobytes() if hashed else b"")
        out["checks"].append(check[at].tobytes() if hashed and len(check) else b"")
        out["docs"].append(small.astype(np.uint32).tobytes())
        out["places"].append(place[at].astype(np.uint32).tobytes())
        out["known"].append(known[at].tobytes() if hashed else b"")
        out["keys"].append(keys[used].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out["part"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in list(out)[1:])], names=list(out))


def _route(parts: int, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Places of many documents, packed in a row for each part that documents are gathered in."""
    part = (mix(key.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(part[order])) + 1)) if len(key) else np.zeros(0, np.int64)
    out: tuple[list, ...] = ([], [], [])
    for a, b in pairwise([*cuts, len(key)]):
        at = order[a:b]
        out[0].append(int(part[at[0]]))
        out[1].append(key[at].tobytes())
        out[2].append(place[at].astype(np.uint32).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["part", "keys", "places"])


def _find_repeats(parts: int):
    """In a part: the places whose hash came from several tasks or places, and those known already."""

    def run(batches):
        got = {k: [np.zeros(0, t)] for k, t in (("h", np.uint64), ("check", np.uint32), ("key", np.int64), ("place", np.uint32), ("known", np.uint8))}
        keys, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for batch in batches:
            for x in batch.to_pylist():
                key, place = np.frombuffer(x["keys"], np.int64)[np.frombuffer(x["docs"], np.uint32)], np.frombuffer(x["places"], np.uint32)
                if not x["hashes"]:
                    keys.append(key)
                    places.append(place)
                    continue
                for k, v in (("h", np.frombuffer(x["hashes"], np.uint64)), ("check", np.frombuffer(x["checks"], np.uint32)), ("known", np.frombuffer(x["known"], np.uint8)), ("key", key), ("place", place)):
                    got[k].append(v)
        h, check, key, place, known = (np.concatenate(got.pop(k)) for k in ("h", "check", "key", "place", "known"))
        order, _, repeats = _repeated(h, check, known)
        new = order[repeats]
        new = new[known[new] == 0]
        yield _route(parts, np.concatenate([*keys, key[new]]), np.concatenate([*places, place[new]]))

    return run


def _gather(batches):
    """A row for each document of a part with its places, packed."""
    keys, places = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for batch in batches:
        for x in batch.to_pylist():
            keys.append(np.frombuffer(x["keys"], np.int64))
            places.append(np.frombuffer(x["places"], np.uint32))
    key, place = np.concatenate(keys), np.concatenate(places)
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1)) if len(key) else np.zeros(0, np.int64)
    offsets = np.append(cuts, len(key)).astype(np.int64) * 4
    for a in range(0, len(cuts), 1024):  # in parts, as a batch holds at most 2**31 bytes
        at = offsets[a : a + 1025]
        packed = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at - at[0]).astype(np.int32).tobytes()), pa.py_buffer(place[at[0] // 4 : at[-1] // 4].tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(key[cuts[a : a + 1024]], pa.int64()), packed], names=["__key", "__marks"])


def _listed(col: pa.Array, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of documents and places of the marks of rows i to j; null marks are none."""
    data, off = buffers(col.slice(i, j - i))
    return np.repeat(np.arange(j - i), np.diff(off) // 4), np.frombuffer(data[off[0] : off[-1]].tobytes(), np.uint32).astype(np.int64)


def _hasher(parts: int, window: int, period: int, extend: bool):
    """Deals out the anchors of documents or, to extend, the windows around their marked anchors."""
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    table = space_table()
    n = window if extend else window - period + 1

    def run(batches):
        held, size, base = [], 0, 0
        all_keys: list[np.ndarray] = []

        def flush():
            return _deal(parts, *(np.concatenate(x) for x in zip(*held, strict=True)), np.concatenate(all_keys))

        for batch in batches:
            data, offsets = buffers(batch.column("__text"))
            keys = batch.column("__key").to_numpy(zero_copy_only=False)
            for i, j in blocks(offsets):
                w = Words(data, offsets[i : j + 1], table)
                doc = w.docs()
                place = np.arange(len(doc)) - w.first[doc]
                left = w.counts[doc] - place
                if not extend:
                    at = np.flatnonzero(cover[place % period] & (left >= n) & (w.counts[doc] >= window))
                else:
                    of, anchor = _listed(batch.column("__marks"), i, j)
                    low, high = np.maximum(anchor - period + 1, 0), np.minimum(anchor, w.counts[of] - window)
                    fits = low <= high
                    edge = np.zeros(len(doc) + 1, np.int64)
                    np.add.at(edge, w.first[of[fits]] + low[fits], 1)
                    np.add.at(edge, w.first[of[fits]] + high[fits] + 1, -1)
                    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                if not len(at):
                    continue
                words = w.hashes()[0]
                check = (runs(words, n, WORD_BASE_2)[at] >> np.uint64(32)).astype(np.uint32) if extend else np.zeros(0, np.uint32)
                held.append((runs(words, n)[at], check, doc[at] + base, place[at]))
                all_keys.append(keys[i:j])
                base += j - i
                size += len(at)
                if size >= FLUSH:
                    yield flush()
                    held, all_keys, size, base = [], [], 0, 0
        if size:
            yield flush()

    return run


def _cutter(window: int, text_col: str, fields: list[str]):
    """Whole texts and their repeated windows to what is kept."""
    table = space_table()

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("__text"))
            n_words, n_removed, sha, texts = [], [], [], []
            given = batch.column("__text")
            for i, j in blocks(offsets):
                w = Words(data, offsets[i : j + 1], table)
                of, start = _listed(batch.column("__marks"), i, j)
                edge = np.zeros(len(w.starts) + 1, np.int64)
                np.add.at(edge, w.first[of] + start, 1)
                np.add.at(edge, w.first[of] + start + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(gone)))
                removed = total[w.first[1:]] - total[w.first[:-1]]
                n_words += w.counts.tolist()
                n_removed += removed.tolist()
                for d in range(j - i):
                    raw = w.raw[w.off[d] : w.off[d + 1]].tobytes()
                    kept = raw.split()
                    if removed[d]:
                        a, b = w.first[d], w.first[d + 1]
                        kept = list(compress(kept, ~gone[a:b]))
                        cuts = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
                        places = np.append(w.starts[a:b] - w.off[d], len(raw))
                        pieces, at = [], 0
                        for x, y in zip(cuts[::2], cuts[1::2], strict=True):
                            pieces.append(raw[at : places[x]])
                            at = places[y]
                        texts.append(b"".join([*pieces, raw[at:]]))
                    else:
                        texts.append(raw if given[i + d].is_valid else None)
                    sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            new = {"n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            out = with_columns(batch, {"__key", "__marks", "__text"}, {text_col: pa.array(texts, pa.binary()).cast(pa.string()), **new})
            yield out.select(fields)

    return run


def row_hash(columns: list[Column]) -> Column:
    return F.xxhash64(*columns)


def dedup_substrings(docs: DataFrame, window: int = 35, period: int = 21, text_col: str = "text") -> DataFrame:
    """docs with repeated passages cut out of text_col, and n_words, n_removed and kept_sha256.

    kept_sha256: of the kept words joined by one space. Between kept words the text keeps
    its own spacing. period: 7, 13, 21 or 31, below window; a longer one sends fewer
    anchors, a shorter one makes each more telling.
    """
    if period not in COVERS or period >= window:
        raise ValueError(f"period must be one of {sorted(COVERS)} and below window")
    docs = keep_columns(docs, NEW, text_col)
    small_batches(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    hashed = [F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    key, other = row_hash(hashed), F.xxhash64(F.lit(1), *hashed)
    rows = docs.select(key.alias("key"), other.alias("other"), F.octet_length(text).alias("bytes"))
    rows = rows.groupBy("key").agg(F.min("other").alias("least"), F.max("other").alias("most"), F.sum("bytes").alias("bytes"))
    known = rows.agg(F.sum("bytes").alias("bytes"), F.collect_list(F.when(F.col("least") != F.col("most"), F.col("key"))).alias("clashes")).first()  # of n rows some n² / 2⁶⁵ clash
    parts = max(shuffle_parts(docs.sparkSession), -(-(known.bytes or 0) // PART_BYTES))
    if known.clashes:
        key = F.when(key.isin(known.clashes), other).otherwise(key)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(0).alias("__none")).alias("__doc")
    keyed = docs.select(others, text.cast("binary").alias("__text"), key.alias("__key")).repartition(parts, "__key")

    def repeats(dealt: DataFrame) -> DataFrame:
        found = dealt.repartition(parts, "part").mapInArrow(_find_repeats(parts), ROUTED)
        return found.repartition(parts, "part").mapInArrow(_gather, MARKS)

    anchors = repeats(keyed.mapInArrow(_hasher(parts, window, period, False), DEALT))
    windows = repeats(keyed.join(anchors, "__key").mapInArrow(_hasher(parts, window, period, True), DEALT))
    schema = T.StructType([keyed.schema["__doc"], T.StructField("__kept", T.StringType()), *[T.StructField(n, T.LongType()) for n in NEW[:2]], T.StructField(NEW[2], T.StringType())])
    cut = keyed.join(windows, "__key", "left").mapInArrow(_cutter(window, "__kept", schema.names), schema)
    return cut.select(*[F.col("__kept").alias(c) if c == text_col else F.col(f"__doc.`{c}`") for c in docs.columns], *NEW)
