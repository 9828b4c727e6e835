"""Chunks that end at separators: paragraphs, lines, sentences, words, and only then characters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", ". ", " ")


def pieces(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> Iterator[str]:
    """Consecutive pieces of at most ``size`` characters that make up the text, cut at the coarsest separator that allows it."""
    if len(text) <= size:
        if text:
            yield text
        return
    if not separators:
        yield from (text[i : i + size] for i in range(0, len(text), size))
        return
    mark = separators[0]
    parts = text.split(mark)
    for i, part in enumerate(parts):
        yield from pieces(part + mark if i < len(parts) - 1 else part, size, separators[1:])


def split(text: str | None, size: int = 1024, overlap: int = 128) -> list[str]:
    """Chunks of at most ``size`` characters; each begins with the last whole pieces of the one before, up to ``overlap`` characters. An empty text has none."""
    out, now, length = [], [], 0
    for piece in pieces(text or "", size):
        if now and length + len(piece) > size:
            out.append("".join(now))
            while now and (length > overlap or length + len(piece) > size):
                length -= len(now.pop(0))
        now.append(piece)
        length += len(piece)
    return [*out, "".join(now)] if now else out


def chunks(text: Column, size: int = 1024, overlap: int = 128) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t, size, overlap))

    return run(text)
