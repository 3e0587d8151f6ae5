"""Listings, counts, deletion and integrity of the stored tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from reportloom.plans.store import materialize
from reportloom.sources.buckets import Library


def page_of(rows: DataFrame, group: str, order: list[Column], skip: int = 0, limit: int = 50) -> DataFrame:
    """One page of the rows of every group (an owner's documents, a document's pages).

    Rows beyond the page are dropped before the shuffle (window group limit).
    """
    w = W.partitionBy(group).orderBy(*order)
    ranked = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= skip + limit)
    return ranked.filter(F.col("_n") > skip).drop("_n")


def list_documents(documents: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """Newest documents of every owner."""
    return page_of(documents, "owner_id", [F.desc("created_at"), F.desc("doc_id")], skip, limit)


def list_pages(pages: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    return page_of(pages, "doc_id", [F.col("page_number")], skip, limit)


def list_sections(sections: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    return page_of(sections, "doc_id", [F.col("section_idx")], skip, limit)


def list_measurements(measurements: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """In reading order: by section, then line."""
    return page_of(measurements, "doc_id", [F.col("section_idx"), F.col("line_idx")], skip, limit)


def list_tables(tables: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """Tables of every document, in the order in which they stand there."""
    return page_of(tables, "doc_id", [F.col("table_index")], skip, limit)


def list_conversations(conversations: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """Newest conversations of every owner: ``conv_id, owner_id, created_at``, more."""
    return page_of(conversations, "owner_id", [F.desc("created_at"), F.desc("conv_id")], skip, limit)


def list_messages(messages: DataFrame, skip: int = 0, limit: int = 50) -> DataFrame:
    """Messages of every conversation, oldest first."""
    return page_of(messages, "conv_id", [F.col("turn")], skip, limit)


def list_entities(entities: DataFrame, entity_type: str | None = None) -> DataFrame:
    wanted = entities if entity_type is None else entities.filter(F.col("entity_type") == entity_type)
    return wanted.orderBy("doc_id", "entity_type", "raw_text")


def facet_entities(entities: DataFrame, shown: int = 24) -> DataFrame:
    """Entities per document and type, most frequent type first, with the first texts."""
    counts = entities.groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("type_rank", F.row_number().over(
        W.partitionBy("doc_id").orderBy(F.desc("n"), "entity_type")))
    texts = page_of(entities.withColumn("_facet", F.struct("doc_id", "entity_type")), "_facet",
                    [F.col("raw_text"), F.col("section_idx")], 0, shown)
    lists = texts.groupBy("doc_id", "entity_type").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("raw_text", "section_idx"))), lambda x: x["raw_text"]).alias("texts"))
    return ranked.join(lists, ["doc_id", "entity_type"])


def document_counts(documents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Number of child rows per document; children are counted before they are joined."""
    out = documents
    for name, child in children.items():
        out = out.join(child.groupBy("doc_id").agg(F.count("*").alias(name)), "doc_id", "left")
    return out.fillna(0, list(children))


def owner_stats(counted: DataFrame, questions: DataFrame, comparisons: DataFrame) -> DataFrame:
    """Documents by status and sums per owner.

    ``counted`` is the result of :func:`document_counts` with ``owner_id, status``;
    questions and comparisons are rows with an ``owner_id``.
    """
    sums = [c for c in ("pages", "chunks", "entities", "measurements") if c in counted.columns]
    base = counted.groupBy("owner_id").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status").isin("uploaded", "processing")).alias("processing"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        *[F.sum(c).alias(c) for c in sums])
    for name, rows in (("questions", questions), ("comparisons", comparisons)):
        base = base.join(rows.groupBy("owner_id").agg(F.count("*").alias(name)), "owner_id", "left")
    return base.fillna(0, ["questions", "comparisons"])


def newest_runs(runs: DataFrame, kind: str | None = None, limit: int = 50) -> DataFrame:
    wanted = runs if kind is None else runs.filter(F.col("kind") == kind)
    return wanted.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


_LARGEST = 1.7976931348623157e308


def group_medians(rows: DataFrame, group: str, value: str, cells: int = 4096) -> DataFrame:
    """``group, median``: the exact median (mean of the middle two) of every group.

    A pass counts the values between a least and a greatest one in ``cells`` equal cells; the
    counts say in which cell, and at which place in it, a middle value lies, and the next pass
    looks at that cell alone, until it holds one value. A pass has one row for a group and cell as its state, summed
    up map-side, however many values there are; 52 bits of a double are 12 bits a pass. Nulls and
    not-a-numbers are left out; infinite values count as the largest double.
    """
    number = F.col(value).cast("double")
    known = rows.filter(number.isNotNull() & ~F.isnan(number)).select(
        F.col(group).alias("g"), F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), number)).alias("v"))
    sizes = known.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # the two middle ranks, counted from 1; equal for an odd number
    ranks = F.array_distinct(F.array(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")))
    asked = sizes.select("g", "lo", "hi", F.explode(ranks).alias("rank")).withColumn("left", F.col("rank"))
    while True:
        asked = materialize(asked, "median-ranks")
        if asked.filter("lo < hi").isEmpty():
            return asked.groupBy(F.col("g").alias(group)).agg(F.avg("lo").alias("median"))
        ranges = asked.select(F.col("g").alias("h"), "lo", "hi").distinct()
        inside = known.join(ranges, F.col("g").eqNullSafe(F.col("h"))).filter("v between lo and hi")
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        cell = F.when(F.col("lo") < F.col("hi"), F.least(F.lit(cells - 1), F.floor(share * cells))).otherwise(F.lit(0))
        counts = inside.groupBy("h", "lo", "hi", cell.alias("cell")).agg(
            F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        placed = counts.withColumn("upto", F.sum("n").over(W.partitionBy("h", "lo", "hi").orderBy("cell"))).withColumnsRenamed(
            {"lo": "low", "hi": "high"})
        before = F.col("upto") - F.col("n")
        asked = asked.join(placed, F.col("g").eqNullSafe(F.col("h")) & (F.col("lo") == F.col("low")) & (F.col("hi") == F.col("high"))).filter(
            (F.col("left") <= F.col("upto")) & (F.col("left") > before)).select(
            "g", F.col("a").alias("lo"), F.col("b").alias("hi"), "rank", (F.col("left") - before).alias("left"))


def run_rollup(runs: DataFrame) -> DataFrame:
    """Runs, failures, mean and exact median of the duration of every kind."""
    counted = runs.groupBy("kind").agg(
        F.count("*").alias("runs"), F.count_if(~F.col("success")).alias("failures"),
        F.round(F.avg("duration_ms"), 4).alias("mean_ms"))
    medians = group_medians(runs, "kind", "duration_ms").select(F.col("kind").alias("_kind"), F.col("median").alias("median_ms"))
    return counted.join(medians, F.col("kind").eqNullSafe(F.col("_kind")), "left").drop("_kind")


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the deleted documents."""
    gone = ids.select("doc_id").distinct()
    return {name: df.join(gone, "doc_id", "left_anti") for name, df in tables.items()}


def delete_stored(library: Library, ids: DataFrame, compact: bool = True) -> list[int]:
    """Delete documents from every stored table of a library at once.

    No reader sees them once the tombstones are written. With ``compact`` their rows leave
    the files too, in the buckets concerned, which are returned.
    """
    library.delete(ids)
    return library.compact() if compact else []


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows whose parent is missing."""
    return child.join(parent.select(*keys).distinct(), keys, "left_anti")


def check_provenance(documents: DataFrame, pages: DataFrame, sections: DataFrame, chunks: DataFrame,
                     entities: DataFrame | None = None, measurements: DataFrame | None = None,
                     citations: DataFrame | None = None, sentences: DataFrame | None = None,
                     comparisons: DataFrame | None = None) -> DataFrame:
    """Broken links per step of the chain, and how many rows of a document have one.

    Document, page, section and chunk; where given, also sections of ``entities`` and ``measurements``
    (``doc_id, section_idx``; without a section: none is asked for), chunks that ``citations`` of answers
    (``query_id, ref, doc_id, chunk_index``) and ``comparisons`` (``doc_id, chunk_index``) name, and citations that
    ``sentences`` of answers (``query_id, ref``) refer to; the latter have no document, so their ``doc_id`` is null.
    Parents are reduced to their keys, so a link costs one join of keys.
    """
    def step(name, child, parent, keys):
        known = child.filter(" and ".join(f"{k} is not null" for k in keys))
        own = F.col("doc_id") if "doc_id" in child.columns else F.lit(None).cast("long")
        return orphans(known, parent, keys).groupBy(own.alias("doc_id")).agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("link"), "doc_id", "rows")
    in_section, in_chunk = ["doc_id", "section_idx"], ["doc_id", "chunk_index"]
    links = [("page-document", pages, documents, ["doc_id"]), ("section-page", sections, pages, ["doc_id", "page_number"]),
             ("chunk-section", chunks, sections, in_section), ("entity-section", entities, sections, in_section),
             ("measurement-section", measurements, sections, in_section), ("citation-chunk", citations, chunks, in_chunk),
             ("comparison-chunk", comparisons, chunks, in_chunk), ("sentence-citation", sentences, citations, ["query_id", "ref"])]
    found = [step(*link) for link in links if link[1] is not None and link[2] is not None]
    return reduce(DataFrame.unionAll, found)


def audit_rollup(events: DataFrame) -> DataFrame:
    return events.groupBy("action", "user_id").agg(
        F.count("*").alias("events"), F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"))
