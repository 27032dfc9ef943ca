"""Embedders, summarizers and pair scorers: what models would supply, with
deterministic stand-ins made of built-in functions."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import SPACE, strip, truncated
from strataweave.functions.vectors import is_zero, zeros

TOKEN = r"[^a-z0-9]+"
WORDS = re.compile(r"[a-z0-9]+")


class Embedder(Protocol):
    dim: int

    def __call__(self, text: Column) -> Column: ...


class HashedWords:
    """Counts of lower-case words by 32 bits of the MD5 of each, modulo dim.

    One vectorised pass: as an expression over arrays, every slot would read all words again.
    """

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def __call__(self, text: Column) -> Column:
        dim = self.dim

        @F.pandas_udf("array<double>")
        def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            slots = _Slots(dim)
            for texts in batches:
                yield pd.Series([np.bincount([slots[w] for w in WORDS.findall((t or "").lower())], minlength=dim).astype(float) for t in texts])

        return counted(text)


class _Slots(dict):
    """word -> slot, of at most MEMORY words."""

    MEMORY = 500_000

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        slot = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % self.dim
        if len(self) < self.MEMORY:
            self[word] = slot
        return slot


Model = Callable[[list[str]], list[list[float]]]
Load = Callable[[], Model]


class Lazy:
    """A model that is loaded when it is first called."""

    def __init__(self, load: Load) -> None:
        self.load, self.model = load, None

    def __call__(self, texts: list[str]) -> list[list[float]]:
        if self.model is None:
            self.model = self.load()
        return self.model(texts)


class ModelEmbedder:
    """Any batch model: load() once per worker, then model(list of texts) -> vectors,
    `group` texts at a time. A group that fails is tried again after each of the
    delays, then text by text; a text that fails gets a zero vector. More models,
    as a local one behind a remote one, take over a group that those before fail on."""

    def __init__(self, load: Load, dim: int, *more: Load, group: int = 20, delays: tuple[float, ...] = (1.0, 2.0)) -> None:
        self.loads, self.dim, self.group, self.delays = (load, *more), dim, group, delays

    def __call__(self, text: Column) -> Column:
        loads, dim, group, delays = self.loads, self.dim, self.group, self.delays

        @F.pandas_udf("array<double>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            models = [Lazy(load) for load in loads]

            def grouped(texts: list[str]) -> list[list[float]]:
                for model in models:
                    for wait in (0.0, *delays):
                        time.sleep(wait)
                        try:
                            found = [list(v) for v in model(texts)]
                            if len(found) == len(texts):
                                return found
                        except Exception:
                            continue
                return [single(t) for t in texts]

            def single(t: str) -> list[float]:
                for model in models:
                    try:
                        return list(model([t])[0])
                    except Exception:
                        continue
                return [0.0] * dim

            for texts in batches:
                held = [t or "" for t in texts]
                yield pd.Series([v for at in range(0, len(held), group) for v in grouped(held[at : at + group])])

        return embed(text)


def embed(df: DataFrame, embedder: Embedder, text: str = "content", out: str = "embedding") -> DataFrame:
    return df.withColumn(out, embedder(F.col(text)))


def repaired(df: DataFrame, embedder: Embedder, text: str = "content", vector: str = "embedding") -> DataFrame:
    """Vectors that are missing or zero are made once more."""
    bad = F.col(vector).isNull() | is_zero(F.col(vector))
    return df.withColumn(vector, F.when(bad, F.coalesce(embedder(F.col(text)), zeros(embedder.dim))).otherwise(F.col(vector)))


def first_sentence(text: Column, fallback: Column, n: int = 500) -> Column:
    """An extractive summary: the first sentence, at most n characters, or the fallback where blank."""
    found = strip(F.regexp_extract(F.coalesce(text, F.lit("")), rf"^{SPACE}*([^\n]*?[.!?](?={SPACE}|$)|[^\n]*)", 1))
    return truncated(F.when(found == "", fallback).otherwise(found), n)


def word_overlap(query: Column, text: Column) -> Column:
    """A pair scorer: the share of the query's distinct words that the text holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN), lambda w: w != ""))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(query), words(text))).cast("double"), F.size(words(query))), F.lit(0.0))


Scorer = Callable[[Column, Column], Column]


def scorer(wanted: Sequence[str], registry: Mapping[str, Callable[[], Scorer]]) -> Scorer | None:
    """The first scorer of these names that is registered and loads; none if none does."""
    for name in wanted:
        try:
            return registry[name]()
        except Exception:
            continue
    return None


def complete(df: DataFrame, completers: Sequence[Callable[[Column], Column]], prompt: str = "prompt", out: str = "answer") -> DataFrame:
    """df with the answer of the first completer that has one; a completer maps a prompt to text or null."""
    return df.withColumn(out, F.coalesce(*(c(F.col(prompt)) for c in completers), F.lit(None).cast("string")))
