"""Shards along a Hilbert curve through several metadata dimensions.

1. Every dimension is quantised by quantiles over all rows into ``2**bits`` cells. Strings are
   compared whole, byte by byte, with cut strings; these are found among the counts of
   distinct values in order, which are summed up in blocks.
2. Cells become an index on the Hilbert curve: rows near on the curve are near in every
   dimension, so a file of neighbours has narrow ranges in all of them.
3. Rows are sorted by index over range partitions (ties: text checksum, id, place in the
   input, so that a hot cell is split), and cut into runs of equal row counts. A row's
   place is its place in its sorted partition plus the sizes of the partitions before.

Only metadata, size and checksum are sorted; texts move once, in ``write_shards``.

Law of ``assign``: ``rows``, counts at most one apart.

Cases: a dimension that ``docs`` lacks is a ValueError. A null dimension is in the lowest cell; null texts have size 1 and
checksum 0, as have empty ones. Ties and repeated rows are separate rows with a slot of
their own. Fewer rows than shards leave shards empty; an empty table gives no rows.
Extra columns are not read by ``assign``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from reportloom.llm.common import shuffle_parts
from reportloom.llm.ranking import numbered
from reportloom.plans.store import discard, materialize


def _number(df: DataFrame, name: str) -> Column:
    """An order-keeping number."""
    if isinstance(df.schema[name].dataType, NumericType):
        value = F.col(name).cast("double")
        return F.when(F.isnan(value), F.lit(None)).otherwise(value)
    return F.unix_micros(F.col(name).cast("timestamp")).cast("double")


def string_cuts(df: DataFrame, name: str, cells: int, block: int = 4096) -> list[str]:
    """At most ``cells - 1`` strings that cut the rows into runs of about equal counts, in order.

    A cut is the last string of its run, so rows above it are beyond. Blocks of ``block`` distinct values
    are summed up first; only those in which a run ends are looked into.
    """
    counts = materialize(df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(
        F.count("*").alias("n")), "string-counts")
    placed = materialize(numbered(counts, [], [F.col("v")], "string-order").withColumn("block", F.expr(f"place div {block}")), "string-places")
    total = placed.agg(F.sum("n")).first()[0]
    if not total:
        return []

    def ends(before: Column, own: Column) -> Column:
        return F.floor(before * cells / F.lit(total)) < F.floor((before + own) * cells / F.lit(total))
    sums = placed.groupBy("block").agg(F.sum("n").alias("own")).withColumn("before", F.sum("own").over(
        Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    wide = sums.withColumn("before", F.coalesce("before", F.lit(0))).filter(ends(F.col("before"), F.col("own"))).select("block", "before")
    inside = Window.partitionBy("block").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.join(wide, "block").withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    cuts = [r.v for r in near.filter(ends(F.col("before"), F.col("n"))).orderBy("place").select("v").collect()]
    discard(counts, placed)
    return cuts[:cells - 1]


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of points given as (points, dimensions) cells of ``bits`` bits each.

    Walking down the bits, the quadrant's reflection and swap of the curve are undone in
    place; what is left, interleaved and decoded from Gray code, is the index.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for d in range(n):
            high = (x[d] & bit) > 0
            swap = (x[0] ^ x[d]) & low
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[d] = np.where(high, x[d], x[d] ^ swap)
    for d in range(1, n):
        x[d] ^= x[d - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    index = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for d in range(n):
            index = index << 1 | (x[d] >> level & 1)
    return index


def with_index(df: DataFrame, dims: list[str], bits: int = 5, accuracy: int = 1000) -> DataFrame:
    """``df`` and ``_curve``, the index of each row; ``df`` is read twice."""
    if len(dims) * bits > 62:
        raise ValueError("an index has 62 bits at most")
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    texts = {d for d in dims if isinstance(df.schema[d].dataType, StringType)}
    values = {d: F.col(d) if d in texts else _number(df, d) for d in dims}
    found = {d: string_cuts(df, d, 1 << bits) for d in dims if d in texts}
    if len(texts) < len(dims):
        numbers = [d for d in dims if d not in texts]
        row = df.agg(*(F.percentile_approx(values[d], shares, accuracy).alias(f"c{i}") for i, d in enumerate(numbers))).first()
        found |= {d: row[i] or [] for i, d in enumerate(numbers)}
    cells = []
    for d in dims:
        value, edges = values[d], sorted(set(found[d]), key=lambda e: e.encode() if isinstance(e, str) else e)
        below = F.lit(0)
        for e in edges:
            below = below + (value > F.lit(e)).cast("int")
        cells.append(F.coalesce(below + 1 if len(edges) + 1 < 1 << bits else below, F.lit(0)).cast("int"))

    @F.pandas_udf("long")
    def curve(*parts: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([p.to_numpy() for p in parts], 1), bits))

    return df.withColumn("_curve", curve(*cells))


def assign(docs: DataFrame, dims: tuple[str, ...] = ("lang", "source", "n_chars"), shards: int = 8,
           id_col: str = "doc_id", text_col: str = "text", bits: int = 5) -> DataFrame:
    """Per row: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``curve``."""
    if missing := [d for d in dims if d not in docs.columns]:
        raise ValueError(f"no column {', '.join(missing)} to order by")
    body = F.coalesce(F.col(text_col), F.lit(""))
    named = [F.col(d).alias(f"_d{i}") for i, d in enumerate(dims)]
    keys = materialize(docs.select(
        F.col(id_col).alias("_id"), *named, (F.octet_length(body) + 1).cast("long").alias("_size"),
        F.crc32(F.encode(body, "utf-8")).alias("_crc"), F.monotonically_increasing_id().alias("_row")), "shard-keys")
    indexed = with_index(keys, [f"_d{i}" for i in range(len(dims))], bits)
    order = ["_curve", "_crc", "_id", "_row"]
    placed = materialize(
        indexed.select(*order, "_size").repartitionByRange(shuffle_parts(docs), *order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()), "shard-order")
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    total, before, rows = 0, {}, sum(r.n for r in sizes)
    for r in sizes:
        before[r.p], total = total, total + r.n
    offsets = docs.sparkSession.createDataFrame(list(before.items()), "p long, before long")
    place = placed.join(F.broadcast(offsets), part == F.col("p")).withColumn("_place", F.col("before") + local)
    shard = F.expr(f"_place * {shards} div {max(rows, 1)}")
    # a shard's first place is the least whose shard it is: ceil(shard * rows / shards)
    head = F.expr(f"(_shard * {rows} + {shards - 1}) div {shards}")
    out = place.withColumn("_shard", shard)
    discard(keys)
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                      F.lit("rows").alias("law"), F.col("_shard").cast("int").alias("shard"),
                      (F.col("_place") - head).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
                      F.col("_curve").alias("curve"))


def write_shards(docs: DataFrame, folder: str, dims: tuple[str, ...] = ("lang", "source", "n_chars"),
                 files: int = 64, bits: int = 5) -> None:
    """Write whole rows as Parquet in curve order: every file is a run of the curve.

    Readers that filter on any of ``dims`` skip files by the ranges in their footers.
    """
    run = with_index(docs, list(dims), bits)
    tie = F.monotonically_increasing_id()
    run.withColumn("_tie", tie).repartitionByRange(files, "_curve", "_tie").sortWithinPartitions("_curve", "_tie").drop(
        "_curve", "_tie").write.mode("overwrite").parquet(folder)
