"""Spelling variants: words one edit apart, grouped under the form that is far more frequent.

Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, with only A-Z lower-cased; of
these, what `noise` says is altered first (the query deletes a code point of one in 31).
Words of at least `least_chars` code points and `least_n` occurrences take part.

Two words are near if one inserted, deleted or replaced code point makes them equal: with L
the longer one's length, if their common prefix and suffix add up to L - 1 or more. Pairs are
found by dense tiles. Words that may be near share a key: the places of the longer word are
cut into two segments, the edit lies in one of them, and all outside it is the same. A key's
words become a padded matrix of code points, eight to a 64-bit number, once from the front
and once from the back; every block of rows is compared with every other at once, and common
prefixes and suffixes are read off the lowest bit that differs. A pair counts in the segment
that holds the leftmost place its edit can have, so in one key only.

Keys are counted before any is gathered. A key of more than TILE words has its segment cut in
halves, again and again: a segment of one place leaves no more words than the alphabet has
letters. So no tile grows with the table, and no word leaves a task more than once for each
of its keys, however many near words it has.

A word's form is its near word of largest n (ties: the smallest in code-point order), if that
is at least `ratio` times its own n. As n grows by `ratio` with each step, forms have no
cycles, and roots are found by following forms twice as far each round.

Null and empty texts have no words; null ids count as empty ones; repeated rows and ids each
count; other columns take no part. An empty table has no words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._store import keep_columns, release, shuffle_parts, small_batches, stash, stashed
from millrace.llm._text import buffers

TILE = 512  # words of a tile's side at most
PIECE, HELD = 1 << 22, 400_000  # bytes of text split at once; words that a task counts before it sends them on
PAIRS = 1 << 18  # pairs compared at once

#: Letters: A-Z lower-cased, a-z, and the bytes of U+00C0 to U+00FF; all else parts words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 0x80 <= b <= 0xBF or b == 0xC3 else 32 for b in range(256))
OTHERS = re.compile(rb"[\xc2\xc4-\xff][\x80-\xbf]*")

Noise = Callable[[bytes, bytes], bytes]


def keep(_id: bytes, word: bytes) -> bytes:
    return word


def runs(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a piece at a time."""
    if not text.isascii():
        text = OTHERS.sub(b" ", text)
    text, at = text.translate(LETTERS), 0
    while at < len(text):
        end = len(text)
        if end - at > PIECE:
            end = text.rfind(b" ", at, at + PIECE)
            if end < 0:  # a word longer than a piece
                end = text.find(b" ", at + PIECE)
                end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end + 1


def chars(word: bytes) -> int:
    return len(word) - word.count(b"\xc3")


def _counted(least_chars: int, noise: Noise):
    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            ids = batch.column("id").to_pylist()
            data, off = buffers(batch.column("text"))
            for i, a, b in zip(ids, off[:-1].tolist(), off[1:].tolist(), strict=True):
                own: Counter = Counter()
                for words in runs(data[a:b].tobytes()):
                    own.update(words)
                key = (i or "").encode()
                for word, n in own.items():
                    if len(word) >= least_chars:
                        word = noise(key, word)
                        if chars(word) >= least_chars:
                            held[word] += n
                if len(held) > HELD:
                    yield out(held)
                    held = Counter()
        yield out(held)

    return run


def word_counts(docs: DataFrame, least_chars: int = 7, least_n: int = 2, noise: Noise = keep, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, n): a task counts its own rows' words first, so a frequent word is a row a task."""
    keep_columns(docs, [], text_col, id_col)
    small_batches(docs.sparkSession)
    x = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text")).where(F.length("text") >= least_chars)
    return x.mapInArrow(_counted(least_chars, noise), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def delete_one_in(of: int) -> Noise:
    """Deletes a code point of words whose crc32, with the id before, `of` divides: an artificial typing error for tests and measures."""

    def noise(key: bytes, word: bytes) -> bytes:
        h = zlib.crc32(word, zlib.crc32(key + b":"))
        if h % of:
            return word
        s = word.decode()
        at = h % len(s)
        return (s[:at] + s[at + 1 :]).encode()

    return noise


def _packed(rows: list[bytes], width: int) -> np.ndarray:
    """Words as rows of 64-bit numbers, eight code points each (all are below 256), padded with zeros; the first code point is the lowest byte."""
    wide = -(-width // 8) * 8
    return np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in rows), np.uint64).reshape(len(rows), -1)


def _same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bytes that are the same from the first on, for rows against rows."""
    total = None
    for k in range(a.shape[-1] - 1, -1, -1):
        x = a[..., k] ^ b[..., k]
        low = np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3  # 8 where all are the same
        total = low if total is None else np.where(low == 8, total + np.uint8(8), low)
    return total.astype(np.int16)


def tile(front: np.ndarray, back: np.ndarray, size: np.ndarray, long: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which words are near, for groups side by side: (groups, words, words).

    front, back: (groups, words, numbers); size: lengths, 0 for padding; long, start, end: by
    group, the longer word's length and the segment that holds the leftmost place of the edit.
    """
    p = np.minimum(_same(front[:, :, None], front[:, None]), np.minimum(size[:, :, None], size[:, None]))
    s = np.minimum(_same(back[:, :, None], back[:, None]), np.minimum(size[:, :, None], size[:, None]))
    n = long[:, None, None]
    edit = n - 1 - np.minimum(s, n - 1)
    longer = np.maximum(size[:, :, None], size[:, None]) == n
    real = (size[:, :, None] > 0) & (size[:, None] > 0) & ~np.eye(size.shape[1], dtype=bool)
    return real & longer & (p + s >= n - 1) & (edit >= start[:, None, None]) & (edit < end[:, None, None])


def _tiles():
    """Rows in order of key, then n falling and word, to (word, n_near, form_n, form) of each word with near ones in its key."""

    def solve(words: list[str], n: np.ndarray, span: list[str], cuts: np.ndarray):
        sizes = np.diff(cuts)
        found: list[tuple] = []
        for side in sorted({1 << max(1, int(g - 1).bit_length()) for g in sizes.tolist() if g > 1}):
            groups = np.flatnonzero((sizes > side // 2 if side > 2 else sizes == 2) & (sizes <= side))
            for at in range(0, len(groups), max(1, PAIRS // side**2)):
                own = groups[at : at + max(1, PAIRS // side**2)]
                place = cuts[own][:, None] + np.arange(side)
                inside = np.arange(side) < sizes[own][:, None]
                rows = place[inside]
                text = [words[r].encode("latin-1") for r in rows.tolist()]
                width = max(map(len, text))
                front, back = np.zeros((2, len(own), side, -(-width // 8)), np.uint64)
                front[inside], back[inside] = _packed(text, width), _packed([t[::-1] for t in text], width)
                size = np.zeros(inside.shape, np.int16)
                size[inside] = list(map(len, text))
                long, start, end = np.array([span[c].split(" ")[:3] for c in cuts[own].tolist()], np.int16).T
                near = tile(front, back, size, long, start, end)
                count = near.sum(axis=2)
                has = np.flatnonzero(count.ravel())
                best = near.argmax(axis=2).ravel()[has]  # rows lie in order of n and word
                g, _ = np.divmod(has, side)
                found.append((place.ravel()[has], count.ravel()[has], place[g, best]))
        if not found:
            return None
        rows, count, best = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array([words[r] for r in rows.tolist()], pa.string()), pa.array(count.astype(np.int64)), pa.array(n[best]), pa.array([words[r] for r in best.tolist()], pa.string())],
            names=["word", "n_near", "form_n", "form"],
        )

    def run(batches):
        words, span, n = [], [], np.zeros(0, np.int64)
        for batch in batches:
            words += batch.column("word").to_pylist()
            span += batch.column("key").to_pylist()
            n = np.concatenate((n, batch.column("n").to_numpy(zero_copy_only=False)))
            if not words or span[0] == span[-1]:
                continue
            last = len(span) - 1
            while span[last - 1] == span[-1]:
                last -= 1
            cuts = np.array([0] + [i for i in range(1, last) if span[i] != span[i - 1]] + [last])
            done = solve(words, n, span, cuts)
            words, span, n = words[last:], span[last:], n[last:]
            if done is not None:
                yield done
        if words:
            done = solve(words, n, span, np.array([0, len(words)]))
            if done is not None:
                yield done

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) for the words (word, n) that have near ones: their number, and the near word of largest n. Words hold letters of the kind above and no word is twice."""
    spark = words.sparkSession
    size = F.length("word")
    # a word is the longer one for its own length, and the shorter or an equal one for the next
    both = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("long"))
    half = F.col("long").cast("int")
    rows = _keyed(both.select("word", "n", "long", F.explode(_halves(F.lit(0), half)).alias("seg")))
    found = []
    while True:
        rows = stash(rows, "spelling-keys")
        crowded = stash(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > TILE).select("key"), "spelling-crowded")
        many = crowded.count()
        mark = F.broadcast(crowded) if many <= 1_000_000 else crowded.hint("merge")
        tiled = rows.join(mark, "key", "left_anti") if many else rows
        dealt = tiled.select("key", "word", "n").repartition(shuffle_parts(spark), "key").sortWithinPartitions("key", F.desc("n"), "word")
        found.append(dealt.mapInArrow(_tiles(), "word string, n_near long, form_n long, form string"))
        if not many:
            break
        finer = rows.join(mark, "key", "left_semi")
        rows = _keyed(finer.select("word", "n", "long", F.explode(_halves(F.col("start"), F.col("end"))).alias("seg")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    # of equal n the smaller word comes first: tasks compare few rows of a word, one for each of its keys
    best = every.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("form_n").alias("form_n"), F.min_by("form", F.struct(-F.col("form_n"), F.col("form"))).alias("form"))
    return best


def _halves(start, end):
    middle = ((start + end) / 2).cast("int")
    cut = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    return F.filter(F.array(cut(start, middle), cut(middle, end)), lambda s: s["start"] < s["end"])


def _keyed(rows: DataFrame) -> DataFrame:
    """The key of a word and a segment: what lies before and behind it."""
    x = rows.select("word", "n", F.col("long").cast("int").alias("long"), "seg.start", "seg.end")
    after = F.col("long") - F.col("end")
    outside = F.concat(F.substring("word", F.lit(1), F.col("start")), F.lit("|"), F.substring("word", F.length("word") - after + 1, after))
    return x.withColumn("key", F.concat_ws(" ", "long", "start", "end", outside))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form (word, form): where its forms end."""
    ahead = stash(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        kept = set(stashed(forms.sparkSession))
        step = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stash(ahead.join(step.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if not moved.where("moved").limit(1).count():
            release(forms.sparkSession, [p for p in stashed(forms.sparkSession) if p not in kept])
            return ahead
        ahead = moved.select("word", "root")


def group_variants(docs: DataFrame, least_chars: int = 7, least_n: int = 2, ratio: int = 10, noise: Noise = keep, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word: form and form_n are null where no near word is `ratio` times as frequent; root is the word itself then."""
    words = stash(word_counts(docs, least_chars, least_n, noise, text_col, id_col), "spelling-words")
    far = F.col("form_n") >= F.lit(ratio) * F.col("n")
    joined = words.join(near_words(words).hint("merge"), "word", "left")
    known = stash(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("form_n")).alias("form_n"), F.when(far, F.col("form")).alias("form")), "spelling-forms")
    roots = with_roots(known.where(F.col("form").isNotNull()))
    return known.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
