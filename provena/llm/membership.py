"""A Bloom filter of 64-bit hashes, built by Spark and asked on executors: what it lets through by mistake costs work, never a result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each hash; and the most bits of a filter (64 MiB), beyond which it lets more through.
BITS_EACH = 16
MAX_BITS = 1 << 29
#: Bits of one row of Spark's bitmap functions.
ROW = 1 << 15
#: A hash's second place comes from its bits from here on.
SHIFT = 32


def may_hold(hashes: DataFrame) -> Callable[[Column], Column]:
    """A condition on hashes that is true for all of the one column of ``hashes`` and for few others. Null counts as no hash."""
    spark = hashes.sparkSession
    hashes = hashes.toDF("h").where("h is not null")
    bits = min(MAX_BITS, max(ROW, 1 << (BITS_EACH * hashes.count()).bit_length()))
    places = F.array(F.col("h").bitwiseAND(F.lit(bits - 1)) + 1, F.shiftright("h", SHIFT).bitwiseAND(F.lit(bits - 1)) + 1)
    rows = hashes.select(F.explode(places).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():  # bits / ROW rows of fixed size
        at = (r["row"] - 1) * ROW // 8
        table[at : at + ROW // 8] = np.frombuffer(r["bits"], np.uint8)
    held = spark.sparkContext.broadcast(table)

    def has(h: pd.Series) -> pd.Series:
        own = held.value
        h = h.to_numpy(np.int64)
        out = np.ones(len(h), bool)
        for p in (h & (bits - 1), (h >> SHIFT) & (bits - 1)):
            out &= (own[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return pd.Series(out)

    return F.pandas_udf(has, "boolean")
