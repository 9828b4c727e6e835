"""Where models come in: embedding, generation, scoring and named entities are functions that a caller passes in.

Each becomes a column function that sees batches of rows, so that a model is loaded once a worker and called on many.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def embed(model: Callable[[list[str]], list[list[float]]]) -> Callable[..., Column]:
    """Texts to vectors; null texts to null."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        known = texts.dropna()
        found = dict(zip(known.index, model(known.tolist()), strict=True)) if len(known) else {}
        return pd.Series([found.get(i) for i in texts.index], index=texts.index, dtype=object)

    return run


def generate(model: Callable[[list[str]], list[str]], retries: int = 3, fallback: str = "") -> Callable[..., Column]:
    """Prompts to answers; a batch that fails ``retries`` times gets ``fallback``, null prompts too."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        out = pd.Series([fallback] * len(prompts), index=prompts.index)
        known = prompts.dropna()
        for _ in range(retries if len(known) else 0):
            try:
                out[known.index] = model(known.tolist())
                break
            except Exception:  # noqa: BLE001, S112 - any fault of a remote model is worth another try
                continue
        return out

    return run


def score(model: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[..., Column]:
    """Pairs of texts to numbers; a pair with a null to null."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known = a.notna() & b.notna()
        out = pd.Series([None] * len(a), index=a.index, dtype="float64")
        if known.any():
            out[known] = model(list(zip(a[known], b[known], strict=True)))
        return out

    return run


def capitalised(text: Column) -> Column:
    """Spans of capitalised words: what stands in for named entities where no model is passed in."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Z][a-z]+(?: [A-Z][a-z]+)*"), F.lit(0)))
