"""What exact scoring in tasks shares: the best k of each question so far, ties kept, and filters of questions on rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of a row's column and a question's column that must be equal; a question's null stands for any value.
Match = Sequence[tuple[str, str]]


class Bars:
    """Per question the k-th best score that a task has seen. What is below it can't be among the k best of all."""

    def __init__(self, questions: int, k: int, floor: float):
        self.k, self.least = k, np.full(questions, -np.inf)
        self.floor = floor

    def keep(self, at: slice, scores: np.ndarray, allowed: np.ndarray | None) -> np.ndarray:
        """scores: (question, row). Which of them may be among the k best, all that tie with the k-th too."""
        if allowed is not None:
            scores = np.where(allowed, scores, -np.inf)
        rows = scores.shape[1]
        if rows >= self.k:
            self.least[at] = np.maximum(self.least[at], np.partition(scores, rows - self.k, axis=1)[:, rows - self.k])
        return (scores >= self.least[at, None]) & (scores > self.floor)


def match_columns(match: Match, of_question: bool) -> list[Column]:
    return [F.col(pair[of_question]).cast("string").alias(f"_m{i}") for i, pair in enumerate(match)]


def allowed(questions: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray | None:
    """(question, row): whether all values that a question demands are the row's. Values are objects; None in a row is equal to nothing."""
    out = None
    for own, value in zip(questions, rows, strict=True):
        fits = (own[:, None] == value[None, :]) | np.equal(own, None)[:, None]
        out = fits if out is None else out & fits
    return out


def objects(values: list) -> np.ndarray:
    out = np.empty(len(values), dtype=object)
    out[:] = values
    return out


def collected(df: DataFrame, most: int) -> list | None:
    """The rows on the driver if they are at most so many, which are counted first; else None."""
    return df.collect() if df.limit(most + 1).count() <= most else None
