"""Places of rows in an order, without a window over one large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reportloom.llm.common import shuffle_parts
from reportloom.plans.store import materialize


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str = "numbered") -> DataFrame:
    """``df`` and ``place``: how many rows of the same ``group`` come before a row, from 0.

    Rows are sorted by group and order over range partitions and written; a row's place is
    its place in the partition, less the first of its group there, plus the group's rows in the
    partitions before. Rows that tie in group and order are told apart by their place in
    ``df``, so ``df`` must be a stored table; they spread over partitions too. Only counts of
    (group, partition) are summed up, one row for each pair that occurs. Null is a group.
    """
    keys = [F.col(g).asc_nulls_first() for g in group] + list(order) + [F.col("_row")]
    placed = materialize(
        df.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(shuffle_parts(df), *keys)
        .sortWithinPartitions(*keys).drop("_row").withColumn("_at", F.monotonically_increasing_id()), name)
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    runs = placed.groupBy(*group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min(local).alias("_head"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = materialize(runs.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(
        *(F.col(g).alias(f"_{g}") for g in group), "_part", "_head", "_before"), f"{name}-offsets")
    same = part == F.col("_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return placed.join(offsets, same).withColumn(
        "place", F.col("_before") + local - F.col("_head")).select(*df.columns, "place")
