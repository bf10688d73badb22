"""Joins that stay balanced when one key holds a large share of the rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 8


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join on ``on``: rows of ``big`` spread over salts, ``small`` repeated per salt.

    ``small`` is the side that is unique (or nearly so) per key.  A hot key's
    rows go to up to ``salts`` tasks; no row is dropped.  Neither side is ever
    broadcast: see ``grown``.
    """
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    repeated = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(grown(repeated), [*on, "_salt"], how).drop("_salt")


def grown(frame: DataFrame) -> DataFrame:
    """Mark a side of a join that grows with the input, so that Spark sorts and merges instead of broadcasting it.

    Spark measures a side by its compressed bytes; a table just below its limit of
    10 MB becomes a hash table of several hundred MB, which the driver has to build.
    """
    return frame.hint("merge")
