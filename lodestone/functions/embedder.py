"""Plug point for embedders: any function from a list of texts to a matrix of vectors runs on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.session import ship

Embedder = Callable[[list[str]], np.ndarray]


def hashing_embedder(dims: int = 64) -> Embedder:
    """Embedder without a model: signed hashes of a text's words, weighed by the root of their counts."""

    def embed(texts: list[str]) -> np.ndarray:
        import re
        from collections import Counter

        import xxhash

        out = np.zeros((len(texts), dims))
        for i, t in enumerate(texts):
            for w, n in Counter(re.findall("[a-z0-9]+", t.lower())).items():
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dims] += (1 if h >> 63 else -1) * n**0.5
        return out

    return embed


def embedded(df: DataFrame, text: str, embedder: Embedder, out: str = "vector") -> DataFrame:
    """Add ``out``: the embedder's vector of each text. Null texts have none; nothing is shuffled."""
    ship(df.sparkSession)
    fields = df.schema.fieldNames()
    at = fields.index(text)

    def run(batches):
        for b in batches:
            texts = b.column(at).to_pylist()
            got = iter(embedder([t for t in texts if t is not None]))
            vectors = [None if t is None else [float(x) for x in next(got)] for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*fields, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{schema}, `{out}` array<double>")
