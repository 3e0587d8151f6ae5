"""Sections of documents too large for one row: the document is a table of lines.

``structure.detect_sections`` keeps a document on its row. Here every line is a row
``doc_id, page_number, line_no, text``; a line's section is the number of openings up to it, a
running sum that is carried over partitions, so one document may spread over all tasks. Only
a single section comes together on one row, as it does in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reportloom.functions.text import lines_of, strip
from reportloom.operators.structure import _without_colons, classify_heading
from reportloom.plans.store import materialize


def running_sum(rows: DataFrame, group: str, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` and ``name``: the sum of ``value`` over the rows of ``group`` up to and with each one.

    ``order`` must tell the rows of a group apart. Rows are sorted over range partitions and written; sums
    within a partition are windows of that partition, and what comes from earlier ones is one
    number for each (group, partition).
    """
    keys = [group, *order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = placed.groupBy(group, "_part").agg(F.sum(value).alias("_own"))
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(F.col(group).alias("_group"), F.col("_part").alias("_at"), F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return placed.join(carried, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at"))).withColumn(
        name, F.col("_before") + F.sum(value).over(inside)).drop("_part", "_group", "_at", "_before")


def page_lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page_number, line_no, text`` of ``doc_id, page_number, text``."""
    return pages.select("doc_id", "page_number", F.posexplode(lines_of(F.col("text"))).alias("line_no", "text"))


def sections_of_lines(lines: DataFrame) -> DataFrame:
    """``doc_id, section_idx, title, kind, page_number, text``, as ``detect_sections`` gives them."""
    place = F.struct("page_number", "line_no")
    marked = materialize(lines.select("doc_id", "page_number", "line_no", strip(F.col("text")).alias("s")).withColumn(
        "h", classify_heading(F.col("s"))).select("doc_id", "page_number", "line_no", "s", "h.is_heading", "h.kind"), "lines")
    first = marked.filter("s <> ''").groupBy("doc_id").agg(F.min(place).alias("first"))
    opened = marked.join(first, "doc_id").withColumn("opens", (F.col("is_heading") | (place == F.col("first"))).cast("long")).drop("first")
    numbered = running_sum(opened, "doc_id", ["page_number", "line_no"], "opens", "section").filter("section > 0")
    head = F.struct("s", "is_heading", "kind", "page_number")
    body = F.when(~F.col("is_heading"), F.struct("page_number", "line_no", "s"))
    grouped = numbered.groupBy("doc_id", "section").agg(
        F.min_by(head, place).alias("head"), F.transform(F.array_sort(F.collect_list(body)), lambda x: x["s"]).alias("body"))
    name = strip(_without_colons(F.col("head.s")))
    unknown: Column = (F.col("section") == 1) & F.col("head.kind").isNull() & (name == "Document")
    return grouped.select(
        "doc_id", (F.col("section") - 1).cast("int").alias("section_idx"),
        F.when(~F.col("head.is_heading") | unknown, "Preamble").otherwise(name).alias("title"), F.col("head.kind").alias("kind"),
        F.col("head.page_number").alias("page_number"), strip(F.array_join("body", "\n")).alias("text"))
