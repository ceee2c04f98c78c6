"""Many phrases looked for at once: an Aho-Corasick automaton over a table of phrases.

A text is read once, a step a character, whatever the number of phrases: each state is the
longest end of what was read that begins a phrase, and knows the phrases that end there. A
table of phrases may be larger than one automaton should be: it is cut into blocks of
BLOCK_CHARS characters, each a column of its own over the same text.
"""

from __future__ import annotations

import pickle
import uuid
from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

BLOCK_CHARS, HELD = 200_000, 4  # characters of an automaton's phrases, and so its states, some 60 MB; automata that a worker keeps


class Automaton:
    """States are numbered; `next` has the steps of each by character, `ends` the phrases that end there, `fail` the state of the next shorter end, `link` the next of those that ends a phrase."""

    def __init__(self, phrases: Sequence[str]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for number, phrase in enumerate(phrases):
            state = 0
            for c in phrase:
                step = self.next[state].get(c)
                if step is None:
                    step = self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                state = step
            if phrase:
                self.ends[state].append(number)
        self.fail, self.link = [0] * len(self.next), [0] * len(self.next)
        wave = deque(self.next[0].values())
        while wave:
            state = wave.popleft()
            for c, step in self.next[state].items():
                wave.append(step)
                back = self.fail[state]
                while back and c not in self.next[back]:
                    back = self.fail[back]
                back = self.next[back].get(c, 0)
                self.fail[step] = back
                self.link[step] = back if self.ends[back] else self.link[back]

    def found(self, text: str) -> Iterator[int]:
        """Numbers of the phrases at each place where one ends, longest first at a place."""
        state = 0
        for c in text:
            while state and c not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(c, 0)
            at = state if self.ends[state] else self.link[state]
            while at:
                yield from self.ends[at]
                at = self.link[at]


def blocks(phrases: Iterable[tuple[str, object]]) -> Iterator[list[tuple[str, object]]]:
    """Phrases with what they carry, in blocks of BLOCK_CHARS characters."""
    own, size = [], 0
    for p in phrases:
        if own and size + len(p[0]) > BLOCK_CHARS:
            yield own
            own, size = [], 0
        own.append(p)
        size += len(p[0])
    if own:
        yield own


_built: dict[str, tuple[Automaton, list]] = {}  # by name of its phrases: an automaton is built once in each Python worker


def _automaton(name: str, shared, phrases_of) -> tuple[Automaton, list]:
    if name not in _built:
        if len(_built) >= HELD:
            _built.clear()
        own = pickle.loads(shared.value)
        _built[name] = Automaton([phrases_of(p) for p in own]), own
    return _built[name]


def found_in(spark: SparkSession, text: Column, phrases: Sequence[str]) -> Column:
    """Numbers (array<int>) of the phrases that the text contains, each once, in order. Null texts contain none; empty phrases are in no text. phrases: one automaton's."""
    shared, name = spark.sparkContext.broadcast(cloudpickle.dumps(list(phrases))), uuid.uuid4().hex

    @F.pandas_udf("array<int>")
    def find(texts: pd.Series) -> pd.Series:
        own, _ = _automaton(name, shared, lambda p: p)
        return texts.map(lambda t: sorted(set(own.found(t))) if t else [])

    return find(text)


def first_found(spark: SparkSession, text: Column, phrases: Iterable[tuple[str, str]]) -> Column:
    """What the first of the phrases (phrase, value) carries that the text contains; null without one. There may be any number of phrases."""

    def of(own: list) -> Column:
        shared, name = spark.sparkContext.broadcast(cloudpickle.dumps(own)), uuid.uuid4().hex

        @F.pandas_udf("string")
        def find(texts: pd.Series) -> pd.Series:
            automaton, known = _automaton(name, shared, lambda p: p[0])
            least = [min(automaton.found(t), default=None) if t else None for t in texts]
            return pd.Series([None if i is None else known[i][1] for i in least], dtype=object)

        return find(text)

    parts = [of(own) for own in blocks(phrases)]
    return F.coalesce(*parts) if parts else F.lit(None).cast("string")
