"""Words and their hashes over whole Arrow text buffers, with numpy; used inside Spark tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18  # text handled at once, so that arrays of eight bytes a byte stay in a core's cache; a longer document is a block of its own

#: Odd multipliers of polynomial hashes modulo 2**64.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

_powers: dict = {}


def space_table() -> bytes:
    """Byte map for words [^\\x20\\x09-\\x0D]+: separators become 0."""
    return bytes(0 if b == 0x20 or 0x09 <= b <= 0x0D else b for b in range(256))


def alnum_table() -> bytes:
    """Byte map for words of digits, letters and all beyond ASCII, with A-Z lower-cased: the rest become 0."""
    return bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        have = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            have.append(np.multiply.accumulate(p))
        if size <= 16 * BLOCK_BYTES:
            _powers[base] = have
    return have[0], have[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary or string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    _, offsets, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges of documents of about limit bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of documents whose bytes lie one after the other.

    starts and ends: byte places; first: number of words before each document, with the total last.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: bytes):
        off = offsets - offsets[0]
        self.raw = data[offsets[0] : offsets[-1]]
        self.bytes = np.frombuffer(self.raw.tobytes().translate(table), np.uint8)
        inside = self.bytes != 0
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = off[:-1][off[:-1] < off[1:]]
        start[edge] = inside[edge]
        edge = off[1:][off[:-1] < off[1:]] - 1
        end[edge] = inside[edge]
        self.starts, self.ends, self.off = np.flatnonzero(start), np.flatnonzero(end) + 1, off
        self.first = np.searchsorted(self.starts, off)
        self.counts = np.diff(self.first)

    def docs(self) -> np.ndarray:
        """Number of the document of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, *ends: np.ndarray) -> list[np.ndarray]:
        """64-bit hashes of the words up to each of ends (their own ends, if none are given). Bytes are hashed in pieces, so a long document needs little more than its words."""
        ends = ends or (self.ends,)
        out = [np.zeros(len(self.starts), np.uint64) for _ in ends]
        i = 0
        while i < len(self.starts):
            a = int(self.starts[i])
            j = max(i + 1, int(np.searchsorted(self.ends, a + 4 * BLOCK_BYTES, "right")))
            part = self.bytes[a : self.ends[j - 1]].astype(np.uint64)
            p, inverse = powers(BYTE_BASE, len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * p[: len(part)], out=sums[1:])
            first = self.starts[i:j] - a
            for o, e in zip(out, ends, strict=True):
                o[i:j] = mix((sums[e[i:j] - a] - sums[first]) * inverse[first] + np.uint64(1))
            i = j
        return out


def runs(hashes: np.ndarray, n: int, base: int = WORD_BASE) -> np.ndarray:
    """Hashes of every n consecutive words, whatever the document."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    p, inverse = powers(base, len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * p[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverse[: len(hashes) - n + 1])


def with_columns(batch: pa.RecordBatch, drop: set[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema) if f.name not in drop]
    kept += list(new.items())
    return pa.RecordBatch.from_arrays([c for _, c in kept], names=[n for n, _ in kept])
