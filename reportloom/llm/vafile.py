"""Exact top-k by integer inner product over a vector-approximation file.

1. Every component becomes ``floor(scale * x)``. Rows whose vector is null or holds a null or
   non-finite component, or no component, take no part; vectors meet only vectors of
   their own length.
2. Copies of one vector can fill at most k places, and the k + 1 smallest ids of a group
   of copies decide all of them, so only these stay candidates (the ranking cuts
   before the shuffle). Every row stays a query.
3. Index: each component is quantised into ``2**bits`` cells. Boundaries are quantiles of a
   bounded sample (``fit_rows`` rows, the least by hash); the outermost cells reach to the exact
   minimum and maximum over all rows, so bounds hold for every row. Cells are
   packed by blocks of rows into a table of their own.
4. Scan: for a block of queries (``query_block``, bounded) the cells of all rows give a lower
   and an upper bound of each score. A task keeps the rows whose upper bound
   reaches the k-th largest lower bound that it has seen; the same cut is made again over
   all tasks.
5. Read: exact vectors are read in order of their upper bounds, a first portion and then ever
   larger ones, until the k-th exact score of every query is above all bounds not yet
   read. Ties go on reading, so equal scores fall to the smaller id.

The result does not depend on sample, bits, blocks or portions. Scores are exact while
the sum of products stays below 2**53.

Cases: a query's own row is left out by row, not by id; a repeated row is a candidate of its
own. A null id is no query, and as a candidate comes after all others at a tie. Fewer
candidates than k give fewer rows; an empty table gives none. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportloom.plans.store import discard, materialize


def _whole(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """``(uid, id, dim, v)`` of the rows that take part."""
    x = F.col(vec_col)
    finite = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"),
                          F.when(finite, F.transform(x, lambda e: F.floor(scale * e.cast("double")))).alias("v"))
    return rows.filter("v is not null").select("uid", "id", F.size("v").alias("dim"), "v")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def fit_cells(rows: DataFrame, dim: int, bits: int, fit_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inner boundaries (dim, cells - 1), and least and greatest value of every cell (dim, cells)."""
    edge = {r.pos: (r.lo, r.hi) for r in rows.select(F.posexplode("v").alias("pos", "e")).groupBy("pos").agg(
        F.min("e").alias("lo"), F.max("e").alias("hi")).collect()}
    # hashes below a bound leave about fit_rows rows, so no task sorts more than that
    share = min(1.0, 1.2 * fit_rows / max(rows.count(), 1))
    mark = F.xxhash64(F.lit(6), "uid")
    sample = rows.filter(mark <= int(min((2 * share - 1) * 2.0 ** 63, 2 ** 63 - 1))).select("v").orderBy(mark).limit(
        fit_rows).toArrow().column(0).combine_chunks()
    if not len(sample):
        sample = rows.select("v").limit(fit_rows).toArrow().column(0).combine_chunks()
    cells = 1 << bits
    cuts = np.quantile(_matrix(sample, dim), np.arange(1, cells) / cells, axis=0, method="lower").T
    lo = np.concatenate([np.array([[edge[d][0]] for d in range(dim)]), cuts], 1).astype(float)
    hi = np.concatenate([cuts - 1, np.array([[edge[d][1]] for d in range(dim)])], 1).astype(float)
    return cuts, np.minimum(lo, hi), np.maximum(lo, hi)


def _index(candidates: DataFrame, dim: int, cuts: np.ndarray, block: int) -> DataFrame:
    """Packed cells: ``(uids, ids, known, cells)`` by blocks of rows; ``known`` marks ids that are not null."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                values = _matrix(part.column("v"), dim)
                cells = np.stack([np.searchsorted(cuts[d], values[:, d], "right") for d in range(dim)], 1).astype(np.uint8)
                ids = part.column("id")
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (
                    part.column("uid").to_numpy().tobytes(), ids.fill_null(0).to_numpy().tobytes(),
                    ids.is_valid().to_numpy(zero_copy_only=False).tobytes(), cells.tobytes())],
                    ["uids", "ids", "known", "cells"])
    return candidates.select("uid", "id", "v").mapInArrow(run, "uids binary, ids binary, known binary, cells binary")


def _scan(index: DataFrame, queries: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> DataFrame:
    """Pairs ``(q, uid, id, lb, ub)`` that may be among the k best of a query, as far as a task can tell."""
    dim = queries.shape[1]
    held = index.sparkSession.sparkContext.broadcast((np.maximum(queries, 0), np.minimum(queries, 0), own, lo, hi))
    none = -np.inf

    def run(batches):
        up, down, own, lo, hi = held.value
        m = len(own)
        best = np.full((m, k), none)  # largest lower bounds so far
        kept: list[tuple] = []
        at = np.arange(dim)
        for batch in batches:
            for uids, ids, known, cells in zip(*(batch.column(c).to_pylist() for c in range(4))):
                uids, ids = np.frombuffer(uids, np.int64), np.frombuffer(ids, np.int64)
                known = np.frombuffer(known, bool)
                cells = np.frombuffer(cells, np.uint8).reshape(-1, dim)
                low, high = lo[at, cells], hi[at, cells]
                ub = up @ high.T + down @ low.T
                lb = up @ low.T + down @ high.T
                self_ = uids[None, :] == own[:, None]
                ub[self_] = lb[self_] = none
                best = -np.partition(-np.concatenate([best, lb], 1), k - 1, axis=1)[:, :k]
                floor = best.min(1)
                q, c = np.nonzero((ub >= floor[:, None]) & (ub > none))
                kept.append((q, uids[c], ids[c], known[c], lb[q, c], ub[q, c]))
                if len(kept) > 16:
                    kept = [_cut(kept, floor)]
        if kept:
            q, uid, ident, known, low, high = _cut(kept, best.min(1))
            for a in range(0, len(q), 50_000):
                s = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q[s], pa.int32()), pa.array(uid[s]), pa.array(ident[s], mask=~known[s]),
                     pa.array(low[s]), pa.array(high[s])], ["q", "uid", "id", "lb", "ub"])
    return index.mapInArrow(run, "q int, uid long, id long, lb double, ub double")


def _cut(kept: list[tuple], floor: np.ndarray) -> tuple:
    parts = [np.concatenate(x) for x in zip(*kept)]
    stay = parts[5] >= floor[parts[0]]
    return tuple(x[stay] for x in parts)


def _read(pairs: DataFrame, exact: DataFrame, queries: np.ndarray, portion: int, k: int) -> DataFrame:
    """Exact scores of pairs in order of their bounds, until the k-th of every query is certain."""
    spark = pairs.sparkSession
    held = spark.sparkContext.broadcast(queries.astype(np.int64))
    dim = queries.shape[1]

    def scores(batches):
        for batch in batches:
            if batch.num_rows:
                q = batch.column("q").to_numpy()
                got = (held.value[q] * _matrix(batch.column("v"), dim)).sum(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q", "uid", "id")), pa.array(got)],
                                                 ["q", "uid", "id", "score"])

    todo, done, first = pairs, [], 1
    while True:
        now = todo.filter(f"nth >= {first} and nth < {first + portion}")
        read = materialize(now.join(exact.select("uid", "v"), "uid").select("q", "uid", "id", "v").mapInArrow(
            scores, "q int, uid long, id long, score long"), "scores")
        done.append(read)
        first, portion = first + portion, 2 * portion
        so_far = reduce(DataFrame.union, done)
        kth = so_far.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(
            f"n = {k}").select("q", F.col("score").alias("kth"))
        left = todo.filter(f"nth >= {first}").join(kth, "q", "left").filter("kth is null or ub >= kth").drop("kth")
        if left.isEmpty():
            return so_far
        todo = left


def search(vectors: DataFrame, queries: str, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = 1024, bits: int = 6, fit_rows: int = 20_000, block: int = 4096, query_block: int = 2048,
           portion: int | None = None) -> DataFrame:
    """``(query_id, rank, id_col, score)``: the k best of all other rows for every row that meets ``queries``.

    ``queries`` is a condition on ``id``, the rows' id.
    """
    spark = vectors.sparkSession
    whole = materialize(_whole(vectors, id_col, vec_col, scale), "vectors")
    copy = F.row_number().over(Window.partitionBy("v").orderBy(F.asc_nulls_last("id"), "uid"))
    exact = materialize(whole.withColumn("_copy", copy).filter(F.col("_copy") <= k + 1).drop("_copy"), "candidates")
    asked = whole.filter(queries)
    out = [spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")]
    for row in asked.groupBy("dim").agg(F.count("*").alias("n")).collect():
        dim, rows = row.dim, exact.filter(F.col("dim") == row.dim)
        if not dim:
            continue
        cuts, lo, hi = fit_cells(rows, dim, bits, fit_rows)
        index = materialize(_index(rows, dim, cuts, block), "cells")
        parts = -(-row.n // query_block)
        for part in range(parts):
            mine = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(7), "uid"), F.lit(parts)) == part))
            table = mine.select("uid", "id", "v").toArrow().combine_chunks()
            if not table.num_rows:
                continue
            matrix = _matrix(table.column("v").combine_chunks(), dim)
            found = _scan(index, matrix.astype(float), table.column("uid").to_numpy(), lo, hi, k)
            found = materialize(found, "bounds")
            floor = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("lb")))).filter(
                f"n = {k}").select("q", F.col("lb").alias("floor"))
            fair = found.join(floor, "q", "left").filter("floor is null or ub >= floor").drop("floor")
            ordered = materialize(fair.withColumn("nth", F.row_number().over(
                Window.partitionBy("q").orderBy(F.desc("ub"), "uid"))), "pairs")
            discard(found)
            scored = _read(ordered, rows, matrix, portion or 4 * k, k)
            names = spark.createDataFrame(list(enumerate(table.column("id").to_pylist())), "q int, query_id long")
            best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(
                F.desc("score"), F.asc_nulls_last("id"), "uid"))).filter(f"rank <= {k}")
            out.append(best.join(F.broadcast(names), "q").select("query_id", "rank", F.col("id").alias(id_col), "score"))
    return reduce(DataFrame.union, out)
