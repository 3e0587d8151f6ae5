"""Chunks: sentence packing, merging of small pieces, table chunks; on the document row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions.arrays import let, slice_runs
from reportloom.functions.text import split_sentences, strip

TARGET, HARD_MAX, MIN_CHUNK = 900, 1400, 80

CHUNK_COLUMNS = ("chunk_index", "section_idx", "section_title", "page_number", "text",
                 "char_count", "token_estimate", "is_table_chunk")


def pack_sentences(sentences: Column, target: int = TARGET, hard_max: int = HARD_MAX) -> Column:
    """Greedy chunks of whole sentences; a sentence longer than the limit stays whole."""
    empty = F.struct(F.lit(1).alias("i"), F.lit(0).alias("size"),
                     F.array().cast("array<int>").alias("starts"))

    def step(acc, s):
        n = F.length(s)
        fresh = (acc["size"] == 0) | (acc["size"] + n > hard_max)
        size = F.when(fresh, n + 1).otherwise(acc["size"] + n + 1)
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(size >= target, 0).otherwise(size).alias("size"),
            F.when(fresh, F.concat(acc["starts"], F.array(acc["i"])))
            .otherwise(acc["starts"]).alias("starts"))

    return let(sentences, lambda ss: let(
        F.aggregate(ss, empty, step, lambda acc: acc["starts"]),
        lambda starts: slice_runs(ss, starts, lambda run, _i: F.array_join(run, " "))))


def pack_text(text: Column) -> Column:
    """Chunk texts of a section: blank-line blocks are packed one by one."""
    pieces = F.when(F.contains(text, F.lit("\n\n")), F.split(text, "\n\n")).otherwise(F.array(text))
    blocks = F.filter(pieces, lambda b: strip(b) != "")
    return F.flatten(F.transform(blocks, lambda b: pack_sentences(split_sentences(b))))


def merge_small(chunks: Column, min_chars: int = MIN_CHUNK, hard_max: int = HARD_MAX) -> Column:
    """Append a small chunk to the one before it when page and section agree.

    ``chunks`` is ``array<struct<section_idx, section_title, page_number, text, is_table_chunk>>``.
    """
    empty = F.struct(F.lit(1).alias("i"), F.lit(0).alias("size"),
                     F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("section"),
                     F.array().cast("array<int>").alias("starts"))

    def step(acc, c):
        n = F.length(c["text"])
        joins = ((F.size(acc["starts"]) > 0) & (n < min_chars) & ~c["is_table_chunk"]
                 & acc["page"].eqNullSafe(c["page_number"])
                 & acc["section"].eqNullSafe(c["section_idx"]) & (acc["size"] + n <= hard_max))
        return F.struct(
            (acc["i"] + 1).alias("i"),
            F.when(joins, acc["size"] + 1 + n).otherwise(n).alias("size"),
            c["page_number"].alias("page"), c["section_idx"].alias("section"),
            F.when(joins, acc["starts"]).otherwise(
                F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"))

    def build(run, i):
        first = F.get(run, F.lit(0))
        return F.struct(
            first["section_idx"].alias("section_idx"), first["section_title"].alias("section_title"),
            first["page_number"].alias("page_number"),
            F.array_join(F.transform(run, lambda c: c["text"]), " ").alias("text"),
            first["is_table_chunk"].alias("is_table_chunk"))

    return let(chunks, lambda cs: let(
        F.aggregate(cs, empty, step, lambda acc: acc["starts"]),
        lambda starts: slice_runs(cs, starts, build)))


def serialize_table(header: Column, rows: Column, caption: Column) -> Column:
    def line(cells):
        return F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | ")
    return F.concat_ws("\n", F.concat(F.lit("Table: "), F.nullif(caption, F.lit(""))),
                       line(header), F.when(F.size(rows) > 0, F.array_join(F.transform(rows, line), "\n")))


def section_chunks(sections: Column) -> Column:
    """Packed chunks of all sections, before merging."""
    return F.flatten(F.transform(
        F.filter(sections, lambda s: strip(s["text"]) != ""),
        lambda s: F.transform(pack_text(s["text"]), lambda t: F.struct(
            s["section_idx"].alias("section_idx"), s["title"].alias("section_title"),
            s["page_number"].alias("page_number"), t.alias("text"),
            F.lit(False).alias("is_table_chunk")))))


def table_chunks(tables: Column) -> Column:
    """One unsplit chunk per table of ``array<struct<page_number, header, rows, caption>>``."""
    made = F.transform(tables, lambda t: F.struct(
        F.lit(None).cast("int").alias("section_idx"), F.lit("Tables").alias("section_title"),
        t["page_number"].cast("int").alias("page_number"),
        strip(serialize_table(t["header"], t["rows"], t["caption"])).alias("text"),
        F.lit(True).alias("is_table_chunk")))
    return F.filter(made, lambda c: c["text"] != "")


def _chunk(c: Column, index: Column) -> Column:
    return F.struct(
        index.cast("int").alias("chunk_index"), c["section_idx"].alias("section_idx"),
        c["section_title"].alias("section_title"), c["page_number"].alias("page_number"),
        c["text"].alias("text"), F.length(c["text"]).alias("char_count"),
        F.greatest(F.lit(1), F.floor(F.length(c["text"]) / 4).cast("int")).alias("token_estimate"),
        c["is_table_chunk"].alias("is_table_chunk"))


def with_tables(chunks: Column, tables: Column) -> Column:
    """``document_chunks`` followed by ``table_chunks``, which may be null; nothing merges with a table."""
    return let(chunks, lambda cs: F.when(tables.isNull(), cs).otherwise(
        F.concat(cs, F.transform(tables, lambda c, i: _chunk(c, F.size(cs) + i)))))


def document_chunks(sections: Column, tables: Column | None = None) -> Column:
    """``array<struct<chunk_index, ...>>`` of a document: sections in order, then tables."""
    chunks = F.transform(merge_small(section_chunks(sections)), _chunk)
    return chunks if tables is None else with_tables(chunks, table_chunks(tables))


def nest_tables(tables: DataFrame) -> DataFrame:
    return tables.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        "table_index", "page_number", "header", "rows", "caption"))), lambda t: F.struct(
            t["page_number"].alias("page_number"), t["header"].alias("header"),
            t["rows"].alias("rows"), t["caption"].alias("caption"))).alias("tables"))


def explode_chunks(docs: DataFrame, chunks: Column) -> DataFrame:
    return docs.select("doc_id", F.explode(chunks).alias("c")).select(
        "doc_id", *[f"c.{c}" for c in CHUNK_COLUMNS])
