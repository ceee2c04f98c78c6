"""Alignment of two tokenizers: which tokens of A and B cover the same bytes of a text.

Both encode a space and the text, without special tokens: A by byte-level BPE (a
`tokenizers` JSON file), B by SentencePiece pieces (a model that adds the space itself).
The tokens' bytes are those of the text, so a token is a row of a token-byte incidence
matrix. These are compressed sparse rows built by hand; the product A·Bᵀ, taken row by row
(Gustavson), has an entry for each pair of tokens that overlap, with the number of bytes
they share. Overlapping tokens that end at the same byte end a group; with the token-group
incidence matrices the product A·Bᵀ has an entry for each pair of tokens of one group.

`align` counts, over the whole corpus, how often a pair of ids is linked, and describes each
document by its tokens, groups and links. Pairs are counted in tasks first, so a pair that
every document has is a row a task. The counts go back to the documents by broadcast where
they are at most MAX_PAIRS (counted before), else by joins, where a frequent pair is joined
without an exchange.

A text is encoded in pieces, cut before single spaces between other characters, where both
tokenizers always part tokens; so a long text needs no more memory than its pairs.

Texts that are null, empty or not UTF-8, and texts whose joined A or B bytes differ from the
space and the text, have no tokens: their numbers are zero and groups_sha256 is ''. Repeated
rows and ids are rows of their own, and count as such; columns with the results' names are
replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._store import keep_columns, share, skew_join, small_batches, stash
from millrace.llm._text import buffers

PIECE, BLOCK = 1 << 16, 1 << 18  # characters of a text encoded at once; bytes that one product is taken over
MAX_PAIRS = 2_000_000  # pairs of ids that are broadcast (17 bytes each)
LINKED = 1 << 20  # links of a group product made at once
NEW = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
#: A place to cut: before a single space between characters that are not white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: Beyond U+027F and general punctuation the regular expression engines may know different versions of Unicode.
RARE = re.compile(rb"[\xca-\xe1\xe3-\xff]|\xe2[^\x80\x81]")


# --- sparse matrices


@dataclass
class Csr:
    """Compressed sparse rows: row i has the columns indices[starts[i]:starts[i+1]] and their values."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    columns: int

    @property
    def rows(self) -> np.ndarray:
        """The row of each entry."""
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def transposed(self) -> Csr:
        order = np.argsort(self.indices, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(self.indices, minlength=self.columns))))
        return Csr(starts, self.rows[order], self.values[order], len(self.starts) - 1)

    def part(self, a: int, b: int) -> Csr:
        """Rows a to b."""
        own = slice(self.starts[a], self.starts[b])
        return Csr(self.starts[a : b + 1] - self.starts[a], self.indices[own], self.values[own], self.columns)


def product(a: Csr, b: Csr) -> Csr:
    """a·b by Gustavson: each row of the result adds up the rows of b that a's entries name, all rows of a at once."""
    meets = np.diff(b.starts)[a.indices]
    first = np.cumsum(meets) - meets
    at = np.repeat(b.starts[a.indices] - first, meets) + np.arange(int(meets.sum()))
    row, column = np.repeat(a.rows, meets), b.indices[at]
    value = np.repeat(a.values, meets) * b.values[at]
    key = row * max(1, b.columns) + column
    if len(key) and (key[1:] < key[:-1]).any():
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    row, column = np.divmod(key[new], max(1, b.columns))
    summed = np.add.reduceat(value, new) if len(new) else value
    return Csr(np.searchsorted(row, np.arange(len(a.starts))), column, summed, b.columns)


def incidence(sizes: np.ndarray) -> Csr:
    """Tokens by bytes, for tokens that lie side by side."""
    starts = np.concatenate(([0], np.cumsum(sizes)))
    return Csr(starts, np.arange(starts[-1]), np.ones(int(starts[-1]), np.int64), int(starts[-1]))


def membership(group: np.ndarray, groups: int) -> Csr:
    """Tokens by groups."""
    return Csr(np.arange(len(group) + 1), group, np.ones(len(group), np.int64), groups)


def overlap_links(sizes_a: np.ndarray, sizes_b: np.ndarray) -> Csr:
    """Tokens of A by tokens of B: the bytes that they share."""
    return product(incidence(sizes_a), incidence(sizes_b).transposed())


def group_links(group_a: np.ndarray, group_b: np.ndarray, groups: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of tokens of one group, as (A, B), at most about LINKED at once however large a group is."""
    a, b = membership(group_a, groups), membership(group_b, groups).transposed()
    total = np.cumsum(np.diff(b.starts)[group_a])
    at = 0
    while at < len(group_a):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + LINKED, "right")))
        got = product(a.part(at, end), b)
        yield got.rows + at, got.indices
        at = end


# --- tokenizers


@dataclass(frozen=True)
class Pair:
    """The two tokenizers' files; built once in each Python worker."""

    a: bytes
    b: bytes


def load_pair(a: str, b: str) -> Pair:
    """a: path of a `tokenizers` JSON file of byte-level BPE; b: path of a SentencePiece model. Read on the driver, a few MB, and sent to the tasks."""
    with open(a, "rb") as x, open(b, "rb") as y:
        return Pair(x.read(), y.read())


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin ones for themselves, others from U+0100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, pair: Pair):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(pair.a.decode())
        self.full.encode_special_tokens = True  # their strings in a text are then ordinary text
        told = json.loads(pair.a)
        code = byte_of_char()
        special = {t["content"] for t in told.get("added_tokens", ())}
        vocab = {t: i for t, i in told["model"]["vocab"].items() if t not in special}
        self.a = [b""] * (1 + max(self.full.get_vocab(True).values()))
        for t, i in vocab.items():
            self.a[i] = bytes(code[c] for c in t)
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        plain = not told.get("normalizer") and told.get("pre_tokenizer", {}).get("type") == "ByteLevel" and told["pre_tokenizer"].get("use_regex", True) and not told["pre_tokenizer"]["add_prefix_space"]
        ranked = sorted(vocab.values()) == list(range(len(vocab))) and all(vocab.get(x + y) == 256 + i for i, (x, y) in enumerate(merges))
        self.quick = None
        if plain and ranked:  # ids are merge ranks, which is what this encoder goes by; it gives the same tokens, faster
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            self.quick = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks={self.a[i]: i for i in vocab.values()}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=pair.b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.vocab_size())]
        self.b = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.parts = not any(re.search("[^▁]▁", p) for p in names)  # no piece goes on beyond a space
        self.sizes = tuple(np.array(list(map(len, x)), np.int64) for x in (self.a, self.b))
        self.digits = tuple(_digits(len(x)) for x in (self.a, self.b))

    def encode_a(self, text: str, rare: bool) -> np.ndarray:
        if self.quick is not None and not rare:
            try:
                return self.quick.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except ValueError:  # its regular expression fails on very long runs of white space
                pass
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.int64)

    def pieces_of(self, text: str) -> Iterator[str]:
        """A text in pieces; each but the first lacks the space before it."""
        at = 0
        while self.parts and len(text) - at > PIECE:
            m = CUT.search(text, at + PIECE)
            if m is None:
                break
            yield text[at : m.start()]
            at = m.end()
        yield text[at:]

    def encode(self, data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of A and B for each piece of a text; None where they don't give the text back."""
        if not data:
            return
        try:
            text = data.decode()
        except UnicodeDecodeError:
            yield None
            return
        rare = RARE.search(data) is not None
        for piece in self.pieces_of(text):
            own = " " + piece
            a, b = self.encode_a(own, rare), np.array(self.pieces.encode(piece, num_threads=1), np.int64)
            want = own.encode()
            if b"".join(map(self.a.__getitem__, a.tolist())) != want or b"".join(map(self.b.__getitem__, b.tolist())) != want:
                yield None
                return
            yield a, b


@lru_cache(maxsize=4)
def tokens_of(pair: Pair) -> Tokens:
    return Tokens(pair)


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of the numbers below n with room for a mark behind, and which places of a row count."""
    texts = [str(i) for i in range(n)]
    width = len(texts[-1])
    digits = np.frombuffer("".join(t.rjust(width) + "," for t in texts).encode(), np.uint8).reshape(n, width + 1)
    return digits, digits != 32


# --- documents


class Block:
    """Pieces of documents side by side: their tokens, links and groups."""

    def __init__(self, tokens: Tokens, pieces: list[tuple[np.ndarray, np.ndarray]]):
        self.tokens = tokens
        self.a, self.b = (np.concatenate([p[k] for p in pieces]) for k in (0, 1))
        sizes_a, sizes_b = tokens.sizes[0][self.a], tokens.sizes[1][self.b]
        self.ends_a, self.ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        self.overlaps = overlap_links(sizes_a, sizes_b)
        i, j = self.overlaps.rows, self.overlaps.indices
        met = self.ends_a[i] == self.ends_b[j]
        self.link_a, self.link_b = i[met], j[met]
        self.ends = self.ends_a[self.link_a]
        self.group_a, self.group_b = (np.searchsorted(self.ends, e) for e in (self.ends_a, self.ends_b))
        #: by piece: first token of A and of B, first group
        self.first_a, self.first_b = (np.cumsum([0, *(len(p[k]) for p in pieces)]) for k in (0, 1))
        total = np.concatenate(([0], self.ends_a))[self.first_a]
        self.first = np.searchsorted(self.ends, total, "right")

    def written(self) -> list[bytes]:
        """The groups of each piece as text."""
        groups = len(self.ends)
        in_a, in_b = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        before_a, before_b = np.cumsum(in_a), np.cumsum(in_b) - in_b
        place = np.concatenate((np.arange(len(self.a)) + before_b[self.group_a], np.arange(len(self.b)) + before_a[self.group_b]))
        (da, ka), (db, kb) = self.tokens.digits
        width = max(da.shape[1], db.shape[1])
        rows, keep = np.zeros((len(place), width), np.uint8), np.zeros((len(place), width), bool)
        pa_, pb = place[: len(self.a)], place[len(self.a) :]
        rows[pa_, -da.shape[1] :], keep[pa_, -da.shape[1] :] = da[self.a], ka[self.a]
        rows[pb, -db.shape[1] :], keep[pb, -db.shape[1] :] = db[self.b], kb[self.b]
        rows[pa_[before_a - 1], -1] = ord("|")
        rows[pb[np.cumsum(in_b) - 1], -1] = ord(";")
        text, size = rows[keep].tobytes(), np.concatenate(([0], np.cumsum(keep.sum(axis=1))))
        at = size[self.first_a + self.first_b]
        return [text[x : y - 1] for x, y in zip(at[:-1], at[1:], strict=True)]


def _keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (b << np.int64(32)) | a


def _merged(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(times, new) if len(new) else times


class _Doc:
    def __init__(self):
        self.n, self.sha, self.fine, self.pairs = np.zeros(4, np.int64), None, True, []

    def add(self, block: Block, k: int, text: bytes) -> None:
        a, b, g = (slice(x[k], x[k + 1]) for x in (block.first_a, block.first_b, block.first))
        self.n += (a.stop - a.start, b.stop - b.start, g.stop - g.start, g.stop - g.start)
        if self.sha is None:
            self.sha = hashlib.sha256(text)
        else:
            self.sha.update(b";" + text)
        keys = _keys(block.a[block.link_a[g]], block.b[block.link_b[g]])
        self.pairs.append(_merged(keys, np.ones(len(keys), np.int64)))
        if len(self.pairs) > 64:
            self.pairs = [self.all_pairs()]

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.pairs) == 1:
            return self.pairs[0]
        return _merged(*(np.concatenate([np.zeros(0, np.int64), *(p[k] for p in self.pairs)]) for k in (0, 1)))

    def row(self) -> tuple:
        if self.sha is None or not self.fine:
            return 0, 0, 0, 0, "", b"", b""
        keys, times = self.all_pairs()
        return *self.n.tolist(), self.sha.hexdigest(), keys.tobytes(), times.astype(np.uint32).tobytes()


def _described(shared):
    """Rows to their tokens, groups and pairs of ids that end together."""

    def run(batches):
        tokens = tokens_of(pickle.loads(shared.value))
        for batch in batches:
            data, off = buffers(batch.column("text"))
            docs = [_Doc() for _ in range(batch.num_rows)]
            waiting: list[tuple[_Doc, tuple]] = []
            held = 0

            def flush():
                if waiting:
                    block = Block(tokens, [p for _, p in waiting])
                    for k, (text, (doc, _)) in enumerate(zip(block.written(), waiting, strict=True)):
                        doc.add(block, k, text)
                    waiting.clear()

            for doc, x, y in zip(docs, off[:-1].tolist(), off[1:].tolist(), strict=True):
                for piece in tokens.encode(data[x:y].tobytes()):
                    if piece is None:
                        doc.fine = False
                        break
                    waiting.append((doc, piece))
                    held += len(piece[0]) * 4
                    if held > BLOCK:
                        flush()
                        held = 0
            flush()
            rows = [d.row() for d in docs]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], names=["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    return run


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of a batch, their numbers, and how many each row has."""
    data, off = buffers(batch.column("pairs"))
    times, at = buffers(batch.column("times"))
    return data[off[0] : off[-1]].view(np.int64), times[at[0] : at[-1]].view(np.uint32).astype(np.int64), np.diff(off) // 8


def _counted(batches):
    held = [(np.zeros(0, np.int64),) * 2]
    waiting = 0
    for batch in batches:
        keys, times, _ = _pairs_of(batch)
        held.append(_merged(keys, times))
        waiting += len(held[-1][0])
        if waiting > max(1 << 20, len(held[0][0])):
            held, waiting = [_merged(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))], 0
    keys, times = _merged(*(np.concatenate([h[k] for h in held]) for k in (0, 1)))
    for i in range(0, len(keys), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(times[i : i + (1 << 16)])], names=["pair", "n"])


def _looked_up(shared):
    """Adds n_best and count_sum by the corpus-wide counts."""

    def run(batches):
        known, n, best = pickle.loads(shared.value)
        for batch in batches:
            keys, times, size = _pairs_of(batch)
            at = np.searchsorted(known, keys)
            row = np.repeat(np.arange(len(size)), size)
            sums = []
            for x in (times * best[at], times * n[at]):
                total = np.concatenate(([0], np.cumsum(x)))
                edge = np.concatenate(([0], np.cumsum(size)))
                sums.append(pa.array(total[edge[1:]] - total[edge[:-1]]))
            assert len(row) == len(keys)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")), *sums], names=["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"])

    return run


def _exploded(batches):
    for batch in batches:
        keys, times, size = _pairs_of(batch)
        rows = np.repeat(batch.column("row").to_numpy(zero_copy_only=False), size)
        for i in range(0, len(keys), 1 << 16):
            own = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(rows[own]), pa.array(keys[own]), pa.array(times[own])], names=["row", "pair", "times"])


def _held(docs: DataFrame, text_col: str) -> DataFrame:
    """(doc, text): the other columns in a struct, so that none clashes with ours."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("none")]
    return docs.select(F.struct(*others).alias("doc"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def described(docs: DataFrame, pair: Pair, text_col: str = "text") -> DataFrame:
    """(row, doc, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): docs' columns but the text in a struct, and the id pairs whose tokens end together, packed."""
    small_batches(docs.sparkSession)
    x = _held(docs, text_col)
    schema = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
    made = x.mapInArrow(_described(share(docs.sparkSession, pair)), T.StructType([x.schema["doc"], *T._parse_datatype_string(schema).fields]))
    return stash(made.withColumn("row", F.monotonically_increasing_id()), "alignment")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best) over all rows of `described`: how many links hold the pair, and whether no pair with its B id has more. pair: the B id times 2³² and the A id."""
    counts = rows.select("pairs", "times").mapInArrow(_counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    own = W.partitionBy(F.shiftright("pair", 32))  # at most A's vocabulary
    return counts.withColumn("best", F.col("n") == F.max("n").over(own))


def align(docs: DataFrame, pair: Pair, text_col: str = "text") -> DataFrame:
    """docs without text_col, with n_a, n_b (tokens), n_groups, n_links (pairs of tokens that end together), n_best (links whose id pair is its B id's most frequent), count_sum (of all links' corpus-wide counts) and groups_sha256."""
    docs = keep_columns(docs, NEW, text_col)
    rows = described(docs, pair, text_col)
    counts = stash(pair_counts(rows), "alignment-counts")
    own = [F.col(f"doc.`{c}`") for c in docs.columns if c != text_col]
    if counts.count() <= MAX_PAIRS:
        got = counts.toArrow().sort_by("pair")
        table = tuple(got.column(c).to_numpy() for c in ("pair", "n", "best"))
        made = rows.drop("row").mapInArrow(_looked_up(share(docs.sparkSession, table)), T.StructType([rows.schema["doc"], *T._parse_datatype_string("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long").fields]))
    else:
        linked = stash(rows.select("row", "pairs", "times").mapInArrow(_exploded, "row long, pair long, times long"), "alignment-linked")
        sums = skew_join(linked, counts, "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        made = rows.join(sums.hint("merge"), "row", "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})
    return made.select(*own, *NEW)


def token_links(docs: DataFrame, pair: Pair, kind: str = "overlap", text_col: str = "text") -> DataFrame:
    """docs without text_col, a row for each link: a_pos, b_pos (places of tokens in the document), a_id, b_id and shared (bytes in common).

    kind: `overlap`, pairs that share bytes; `end`, those that end together too; `group`, all
    pairs between the same two shared ends (shared is zero where they don't overlap). A
    document's links leave its task as they are made.
    """
    if kind not in ("overlap", "end", "group"):
        raise ValueError(f"unknown kind of links: {kind}")
    new = ["a_pos", "b_pos", "a_id", "b_id", "shared"]
    docs = keep_columns(docs, new, text_col)
    small_batches(docs.sparkSession)
    x = _held(docs, text_col)
    shared = share(docs.sparkSession, pair)

    def of(block: Block):
        sizes_a, sizes_b = np.diff(np.concatenate(([0], block.ends_a))), np.diff(np.concatenate(([0], block.ends_b)))
        if kind == "group":
            for i, j in group_links(block.group_a, block.group_b, len(block.ends)):
                start = np.maximum((block.ends_a - sizes_a)[i], (block.ends_b - sizes_b)[j])
                yield i, j, np.maximum(np.minimum(block.ends_a[i], block.ends_b[j]) - start, 0)
        else:
            i, j, v = block.overlaps.rows, block.overlaps.indices, block.overlaps.values
            keep = slice(None) if kind == "overlap" else block.ends_a[i] == block.ends_b[j]
            yield i[keep], j[keep], v[keep]

    def run(batches):
        tokens = tokens_of(pickle.loads(shared.value))
        for batch in batches:
            data, off = buffers(batch.column("text"))
            for r, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                if any(p is None for p in tokens.encode(data[a:b].tobytes())):
                    continue
                done_a = done_b = 0
                for piece in tokens.encode(data[a:b].tobytes()):
                    block = Block(tokens, [piece])
                    for i, j, v in of(block):
                        for k in range(0, len(i), 1 << 16):
                            x_, y_ = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                            doc = batch.column("doc").take(pa.array(np.full(len(x_), r)))
                            yield pa.RecordBatch.from_arrays([doc, *map(pa.array, (x_ + done_a, y_ + done_b, block.a[x_], block.b[y_], v[k : k + (1 << 16)]))], names=["doc", *new])
                    done_a, done_b = done_a + len(block.a), done_b + len(block.b)

    schema = T.StructType([x.schema["doc"], *[T.StructField(c, T.LongType()) for c in new]])
    return x.mapInArrow(run, schema).select(*[F.col(f"doc.`{c}`") for c in docs.columns if c != text_col], *new)
