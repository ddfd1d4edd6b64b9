"""Bitmaps of fixed size over 64-bit hashes, which leave out most rows that a join would drop anyway."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

BITS = 1 << 26


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for the low bits of every value of the only column (8 MB, however many rows)."""
    slot = F.col(hashes.columns[0]).bitwiseAND(F.lit(BITS - 1))
    bit = F.expr(f"shiftleft(1L, cast(`{hashes.columns[0]}` & 63 as int))")
    words = hashes.select(F.shiftright(slot, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the int64 values may be in the bitmap."""
    slot = values & (BITS - 1)
    return ((bits[slot >> 6] >> (slot & 63)) & 1).astype(bool)


def parted(frame: DataFrame, key: Column, hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose key (a long, not null) may be among the hashes, and the others, which need no join to tell that they match nothing."""
    sent = frame.sparkSession.sparkContext.broadcast(bitmap(hashes))

    @F.arrow_udf("boolean")
    def among(keys: pa.Array) -> pa.Array:
        return pa.array(marked(sent.value, keys.to_numpy()))

    return frame.where(among(key)), frame.where(~among(key))
