"""Recursive chunking by separators, with overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import ship

#: Separators of scientific text, the coarsest first.
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ")


def recursive_chunks(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters: the text is cut at the coarsest separator it holds, parts that are still too
    long at finer ones, and neighbouring parts are joined up to the size; up to ``overlap`` characters of whole parts are
    repeated. A part without any separator stays as long as it is."""
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        return [text] if text.strip() else []
    sep, finer = separators[at], separators[at + 1 :]
    parts = text.split(sep)
    parts = [p + (sep if i + 1 < len(parts) else "") for i, p in enumerate(parts)]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if joined := "".join(held).strip():
            out.append(joined)

    for p in parts:
        if len(p) > size:
            flush()
            held.clear()
            out += recursive_chunks(p, size, overlap, finer)
            continue
        if held and sum(map(len, held)) + len(p) > size:
            flush()
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(p) > size):
                held.pop(0)
        held.append(p)
    flush()
    return out


def chunked(df: DataFrame, key: str, section: str, text: str, sizes: dict[str, tuple[int, int]], default: tuple[int, int] = (1000, 200)) -> DataFrame:
    """(key, section, chunk_index, content): chunks of each text with the size and overlap of its section; blank texts none."""
    ship(df.sparkSession)

    def split(frames):
        for f in frames:
            rows = [(k, s, i, c) for k, s, t in zip(f["k"], f["s"], f["t"], strict=True) for i, c in enumerate(recursive_chunks(t, *sizes.get(s, default)))]
            yield pd.DataFrame(rows, columns=["k", "section", "chunk_index", "content"])

    src = df.select(F.col(key).alias("k"), F.col(section).alias("s"), F.col(text).alias("t")).where("t is not null")
    return src.mapInPandas(split, f"k {dict(src.dtypes)['k']}, section string, chunk_index int, content string").withColumnRenamed("k", key)
