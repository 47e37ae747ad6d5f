"""EMBED(text[, model]): vectors of texts from a pluggable provider.

The model ``hash`` needs no network: signed hashes of words, scaled to length
one.  Others are registered as functions of a list of texts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from ..errors import EngineError, TypeMismatch
from ..plans.expressions import Typed
from .registry import Extension, ScalarFunction

DIMENSION = 768
Provider = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), DIMENSION))
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = xxhash.xxh64_intdigest(word)
            out[i, h % DIMENSION] += 1.0 if h >> 63 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


PROVIDERS: dict[str, Provider] = {"hash": hashed}


def _embed(args: list[Typed]) -> Typed:
    model = args[1].literal if len(args) > 1 else "hash"
    if args[0].type not in ("text", "null") or not isinstance(model, str):
        raise TypeMismatch("EMBED takes a text and the name of a model")
    if model not in PROVIDERS:
        raise EngineError(f"no model {model}")
    provider = PROVIDERS[model]

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        found = provider(texts.fillna("").tolist())
        return pd.Series([None if t is None else v.tolist() for t, v in zip(texts, found)])

    return Typed(vectors(args[0].column.cast("string")), "vector")


EMBED = Extension("embed", "1.0", [ScalarFunction("EMBED", 1, 2, _embed)])
