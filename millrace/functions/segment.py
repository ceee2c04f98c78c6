"""Words of scripts without spaces: the most probable path through a dictionary's words.

A run of CJK characters is a lattice: an edge for each word of the dictionary at each place,
and one for each single character. A path's probability is the product of its words'; the
best path is found by dynamic programming over the places, from the end, so a run costs its
length times the longest word. Of equal paths the one whose first word is longest is taken.

The dictionary is a table (word, n), given or learnt from the corpus. A character that it
lacks counts half an occurrence.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.sources.shared import stash

MAX_WORDS = 2_000_000  # of a dictionary that is sent to the tasks; a larger one is refused
FIRST, DIGITS, LONGEST = 0x4E00, 0x9FA5 - 0x4E00 + 1, 4  # CJK characters as digits; as many make a 64-bit number
CHUNK_CHARS, HELD_CODES = 1 << 21, 1 << 21  # characters that are counted at once; sequences of a length that a task holds
CJK_RUN = re.compile("[一-龥]+")
RUN = re.compile("[一-龥]+|[a-zA-Z0-9]{2,}")


class Words:
    """A dictionary's words with the logarithms of their shares."""

    def __init__(self, counts: dict[str, int]):
        total = math.log(max(1, sum(counts.values())))
        self.cost = {w: math.log(n) - total for w, n in counts.items() if w and n > 0}
        self.longest = max(map(len, self.cost), default=1)
        self.unknown = math.log(0.5) - total
        lengths: dict[str, set[int]] = {}
        for w in self.cost:
            if len(w) > 1:
                lengths.setdefault(w[:2], set()).add(len(w))
        self.begun = {two: sorted(own) for two, own in lengths.items()}  # lengths of the words that begin with two characters

    def split(self, run: str) -> list[str]:
        n, get = len(run), self.cost.get
        single = [get(c, self.unknown) for c in run]
        begun = [*map(self.begun.get, map(str.__add__, run, run[1:])), None]
        best, step, own = [0.0] * (n + 1), [1] * n, 0.0
        for i in range(n - 1, -1, -1):
            own += single[i]
            if begun[i]:
                for k in begun[i]:
                    cost = get(run[i : i + k]) if i + k <= n else None
                    if cost is not None and cost + best[i + k] >= own:
                        own, step[i] = cost + best[i + k], k
            best[i] = own
        out, i = [], 0
        while i < n:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out


_known: dict[str, Words] = {}  # by name: a dictionary is unpacked once in each Python worker


def segmenter(words: DataFrame, stop_words: Sequence[str] = rules.STOP_WORDS) -> Callable[[Column], Column]:
    """A tokenizer (text to array<string>) as text.tokens, but for CJK runs cut into words: of two characters and more, and no stop words. words: (word, n), checked to be at most MAX_WORDS."""
    held = {r.word: r.n for r in words.limit(MAX_WORDS + 1).toLocalIterator()}
    if len(held) > MAX_WORDS:
        raise ValueError(f"a dictionary of more than {MAX_WORDS} words")
    shared, name, stops = words.sparkSession.sparkContext.broadcast(cloudpickle.dumps(held)), uuid.uuid4().hex, frozenset(stop_words)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        if name not in _known:
            _known.clear()
            _known[name] = Words(pickle.loads(shared.value))
        own = _known[name]

        def one(said: str | None) -> list[str] | None:
            if said is None:
                return None
            parts = (own.split(r) if r[0] >= "一" else [r] for r in RUN.findall(said))
            return [w for part in parts for w in part if len(w) > 1 and w not in stops]

        return texts.map(one)

    return cut


def _counted(longest: int):
    """Makes texts to (word, n): their CJK runs' sequences of up to `longest` characters, each some times a task. A sequence is a number, its characters are the digits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(longest)]
        size = [0] * longest

        def merged(k: int) -> tuple[np.ndarray, np.ndarray]:
            code, n = (np.concatenate(x) for x in zip(*held[k], strict=True))
            code, of = np.unique(code, return_inverse=True)
            return code, np.bincount(of, n).astype(np.int64)

        def told(k: int) -> pd.DataFrame:
            code, n = merged(k)
            digits = np.stack([code // DIGITS ** (k - j) % DIGITS for j in range(k + 1)], axis=1) + FIRST
            said = digits.astype("<u4").tobytes().decode("utf-32-le")
            held[k], size[k] = [], 0
            return pd.DataFrame({"word": [said[i : i + k + 1] for i in range(0, len(said), k + 1)], "n": n})

        def add(runs: list[str]) -> Iterator[pd.DataFrame]:
            digit = np.frombuffer("\n".join(runs).encode("utf-32-le"), "<u4").astype(np.int64) - FIRST
            code = digit.copy()
            whole = digit >= 0
            for k in range(longest):
                if k:
                    code, whole = code[:-1] * DIGITS + digit[k:], whole[:-1] & (digit[k:] >= 0)
                if not whole.any():
                    break
                held[k].append(np.unique(code[whole], return_counts=True))
                size[k] += len(held[k][-1][0])
                if size[k] > HELD_CODES:
                    held[k] = [merged(k)]
                    size[k] = len(held[k][0][0])
                    if size[k] > HELD_CODES // 2:
                        yield told(k)

        for pdf in frames:
            runs, chars = [], 0
            for said in pdf["text"].dropna():
                for m in CJK_RUN.finditer(said):
                    runs.append(m[0])
                    chars += len(m[0])
                if chars > CHUNK_CHARS:
                    yield from add(runs)
                    runs, chars = [], 0
            if runs:
                yield from add(runs)
        for k in range(longest):
            if held[k]:
                yield told(k)

    return run


def learn_words(docs: DataFrame, longest: int = 4, least: int = 5, cohesion: float = 8.0, text_col: str = "text") -> DataFrame:
    """(word, n): a dictionary from the corpus's own CJK runs.

    All sequences of up to `longest` characters are counted; single characters stay, and of
    the others those that occur `least` times and, wherever they are cut in two, `cohesion`
    times as often as their parts would meet by chance. Sequences are counted in tasks first,
    as numbers, so a frequent one is some rows a task.
    """
    if not 0 < longest <= LONGEST:
        raise ValueError(f"words of 1 to {LONGEST} characters")
    grams = docs.select(F.col(text_col).alias("text")).mapInPandas(_counted(longest), "word string, n long")
    counts = grams.groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.length("word") == 1))
    counts = stash(counts, "sequences")  # read for the total, for the words and for both their parts
    total = counts.where(F.length("word") == 1).agg(F.sum("n")).first()[0] or 0
    cuts = counts.where(F.length("word") > 1).select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    part = lambda name: counts.select(F.col("word").alias(name), F.col("n").alias(f"n_{name}"))
    joined = cuts.withColumns({"a": F.substr("word", F.lit(1), "at"), "b": F.substr("word", F.col("at") + 1, F.lit(longest))}).join(part("a"), "a").join(part("b"), "b")
    firm = joined.groupBy("word", "n").agg(F.min(F.col("n") * F.lit(float(total)) / (F.col("n_a") * F.col("n_b"))).alias("least")).where(F.col("least") >= cohesion)
    return counts.where(F.length("word") == 1).unionByName(firm.select("word", "n"))
