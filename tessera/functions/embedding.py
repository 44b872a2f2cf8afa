"""Vectors of texts in batches, by a model that each worker loads once.

A model is a function without arguments that returns another one, (texts) -> matrix: the first
is called once in a worker, the second for each batch (``predict_batch_udf``). That is where
an encoder is plugged in. :func:`hashing_model` needs no weights: a text's tokens are hashed
to coordinates and signs and summed up; the length is left to the cosine. It knows no meanings,
but texts that share words are near each other, the same on every machine.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

Model = Callable[[], Callable[[np.ndarray], np.ndarray]]

#: Texts of one call of a model, and the coordinates of the hashing model.
BATCH, WIDTH = 64, 64
_TOKEN = re.compile("[a-z0-9]+")


def hashing_model(width: int = WIDTH) -> Model:
    """Token -> the first four bytes of its MD5: a coordinate, and by the next byte a sign."""

    def load() -> Callable[[np.ndarray], np.ndarray]:
        known: dict[str, tuple[int, float]] = {}  # lives as long as the worker

        def place(token: str) -> tuple[int, float]:
            found = known.get(token)
            if found is None:
                if len(known) >= 200_000:
                    known.clear()
                d = hashlib.md5(token.encode(), usedforsecurity=False).digest()
                found = known[token] = (int.from_bytes(d[:4], "big") % width, 1.0 if d[4] % 2 else -1.0)
            return found

        def encode(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), width))
            for row, text in zip(out, texts, strict=True):
                for token in _TOKEN.findall(text.lower() if text else ""):
                    at, sign = place(token)
                    row[at] += sign
            return out.astype(np.float32)

        return encode

    return load


def embed(texts: DataFrame, model: Model | None = None, batch: int = BATCH) -> DataFrame:
    """id, embedding of ``texts`` (id, text); a null text is an empty one, whose vector has no
    length. It fits as the embedder of a workspace."""
    encode = predict_batch_udf(model or hashing_model(), return_type=ArrayType(FloatType()), batch_size=batch)
    return texts.select("id", encode(F.coalesce("text", F.lit(""))).alias("embedding"))
