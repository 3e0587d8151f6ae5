"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def salted_lookup(facts: DataFrame, lookup: DataFrame, keys: list[str], row_id: str,
                  how: str = "left", salts: int | None = None) -> DataFrame:
    """Join many fact rows with one lookup row per key.

    Rows of a hot key are spread over ``salts`` tasks by a hash of the row, and the
    lookup row is repeated once per salt; the root of the number of shuffle partitions
    unless given, so that both grow with the cluster. The result is the plain join.
    """
    if salts is None:
        salts = max(8, math.isqrt(int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
