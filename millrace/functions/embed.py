"""A deterministic embedding for texts where no model is at hand: hashed tokens with signs, scaled to unit length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

NAME = "hashing:1"


def hashed(text: Column, dims: int = 64) -> Column:
    """``array<double>``; a text without tokens is all zero."""
    tokens = T.topic_tokens(text)
    zero = F.array_repeat(F.lit(0.0), dims)

    def add(acc, token):
        at = F.pmod(F.xxhash64(token), F.lit(dims)) + 1
        sign = F.when(F.pmod(F.xxhash64(token, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        return F.concat(F.slice(acc, F.lit(1), (at - 1).cast("int")), F.array(F.element_at(acc, at.cast("int")) + sign), F.slice(acc, (at + 1).cast("int"), F.lit(dims)))

    summed = F.aggregate(tokens, zero, add)
    norm = F.sqrt(F.aggregate(summed, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(summed, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))
