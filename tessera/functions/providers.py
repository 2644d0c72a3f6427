"""Plug points for models: plain functions on lists of texts, run in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Complete = Callable[[list[str]], list[str]]
Embed = Callable[[list[str]], list[list[float]]]

_REGISTRY: dict[tuple[str, str], Callable[[], Callable]] = {}


def register(kind: str, name: str, make: Callable[[], Callable]) -> None:
    """make builds the client on the executor, once for each task."""
    _REGISTRY[kind, name] = make


def provider(kind: str, name: str) -> Callable[[], Callable]:
    if (kind, name) not in _REGISTRY:
        raise ValueError(f"no {kind} named {name!r}; known: {sorted(n for k, n in _REGISTRY if k == kind)}")
    return _REGISTRY[kind, name]


def _mapped(df: DataFrame, make: Callable[[], Callable], text: str, out: str, kind: T.DataType) -> DataFrame:
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make()
        for batch in batches:
            yield pd.Series(client([x or "" for x in batch]))

    return df.withColumn(out, run(F.col(text)))


def complete(df: DataFrame, make: Callable[[], Complete], prompt: str = "prompt", out: str = "answer") -> DataFrame:
    return _mapped(df, make, prompt, out, T.StringType())


def embed(df: DataFrame, make: Callable[[], Embed], text: str = "text", out: str = "embedding") -> DataFrame:
    return _mapped(df, make, text, out, T.ArrayType(T.FloatType()))


def cross_encode(pairs: DataFrame, make: Callable[[], Callable[[list[str], list[str]], list[float]]], question: str = "question", text: str = "text", out: str = "rerank") -> DataFrame:
    """Adds a model's score of each pair of question and text."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for q, t in batches:
            yield pd.Series(model(list(q), list(t)), dtype=float)

    return pairs.withColumn(out, run(question, text))
