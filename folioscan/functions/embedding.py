"""A deterministic embedder that needs no model, and the way any embedder is run."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32


def hashed_vectors(dimension: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Unit vectors from hashed words; equal texts get equal vectors."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), dtype=np.float32)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                code = zlib.crc32(word.encode("utf-8"))
                out[row, code % dimension] += 1.0 if code & 0x80000000 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        norms[norms == 0] = 1.0
        return out / norms

    return embed


def embedded(chunks: DataFrame, embed: Callable, id_type: str | None = None, batch: int = BATCH, max_chars: int | None = None) -> DataFrame:
    """(id, document_id, embedding) of passages, ``batch`` texts per call of ``embed``.

    Works on a table and on a stream alike; rows go through the workers as Arrow
    batches and a lost task repeats only its own calls. Texts are handed over whole; ``max_chars``
    is for models that accept no more.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at in range(0, len(part), batch):
                few = part.iloc[at:at + batch]
                vectors = embed(few["content"].tolist())
                yield pd.DataFrame({
                    "id": few["id"].to_numpy(), "document_id": few["document_id"].to_numpy(),
                    "embedding": [np.asarray(v, dtype=np.float32) for v in vectors],
                })

    content = F.col("content") if max_chars is None else F.substring("content", 1, max_chars)
    rows = chunks.select("id", "document_id", content.alias("content"))
    kinds = [id_type or chunks.schema["id"].dataType.simpleString(), chunks.schema["document_id"].dataType.simpleString()]
    return rows.mapInPandas(run, f"id {kinds[0]}, document_id {kinds[1]}, embedding array<float>")
