"""Hooks for model calls as batched columns; by default outputs are supplied columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from groundline import config as C


def embed(fn: Callable[[list[str]], list[list[float]]], batch: int = C.EMBEDDING_BATCH) -> Callable[[Column], Column]:
    """Column function around ``fn(texts) -> vectors``, called with at most ``batch`` texts."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list = []
            for lo in range(0, len(texts), batch):
                asked = texts.iloc[lo:lo + batch].tolist()
                got = fn(asked)
                if len(got) != len(asked):
                    raise ValueError("embedding response count does not match its request")
                out.extend(got)
            yield pd.Series(out, index=texts.index)

    return run


def complete(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """Column function around ``fn(prompt) -> text``."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in parts:
            yield prompts.map(fn)

    return run
