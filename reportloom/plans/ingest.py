"""From document text to the derived tables, one narrow plan over the corpus.

``prepare`` adds the cleaned pages, the gate and the sections to every document
row. The derived tables are projections of that row, so building all of them
needs no shuffle; only tables that arrive as separate rows are joined in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from reportloom.functions import vocab as V
from reportloom.functions.arrays import let
from reportloom.operators import batches as B, chunk as C, extract as X, pages as P, structure as T


def cleaned_pages(text: Column) -> Column:
    return P.cleaned_texts(P.paginate_paragraphs(text))


def prepare(docs: DataFrame, pages: Column | None = None) -> DataFrame:
    """Keep all columns of ``docs``; add ``body`` with pages, sections and the gate."""
    source = P.cleaned_texts(P.paginate_paragraphs(F.col("text")) if pages is None else pages)
    body = let(source, lambda ps: F.struct(
        ps.alias("pages"), T.detect_sections(ps).alias("sections"), T.detect_title(ps).alias("title"),
        P.gate(ps).alias("gate"), P.page_word_counts(ps).alias("counts")))
    return docs.withColumn("body", body)


@dataclass
class Derived:
    """Derived tables of a corpus, as lazy DataFrames."""

    documents: DataFrame
    pages: DataFrame
    sections: DataFrame
    entities: DataFrame
    measurements: DataFrame
    chunks: DataFrame


def _column_sections() -> Column:
    return let(cleaned_pages(F.col("text")), T.detect_sections)


def sections_of(docs: DataFrame) -> DataFrame:
    """Section rows straight from document text (no other column is carried)."""
    return T.explode_sections(B.cut_in_batches(docs.select("doc_id", "text"), True, False),
                              B.either("cut_sections", _column_sections()))


def sections_and_chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, sections, chunks`` of every document."""
    cut = B.cut_in_batches(docs.select("doc_id", "text"), True, True).select(
        "doc_id", B.either("cut_sections", _column_sections()).alias("sections"), "cut_chunks")
    return cut.select("doc_id", "sections", B.either("cut_chunks", C.document_chunks(F.col("sections"))).alias("chunks"))


def prepare_batch(docs: DataFrame) -> DataFrame:
    """``doc_id, pages, gate, sections, chunks`` of every document; plain reports are cut in Arrow batches."""
    cut = B.cut_in_batches(docs.select("doc_id", F.col("text").alias("whole"), "text"), True, True)
    pages = let(cleaned_pages(F.col("whole")), lambda ps: F.struct(ps.alias("pages"), P.gate(ps).alias("gate")))
    found = cut.select("doc_id", pages.alias("body"), B.either("cut_sections", _column_sections()).alias("sections"), "cut_chunks")
    return found.select("doc_id", "body.pages", "body.gate", "sections",
                        B.either("cut_chunks", C.document_chunks(F.col("sections"))).alias("chunks"))


def chunks_of(docs: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    docs = docs.select("doc_id", "text")
    if tables is not None:
        docs = docs.join(C.nest_tables(tables).select("doc_id", C.table_chunks(F.col("tables")).alias("tables")), "doc_id", "left")
    cut = B.cut_in_batches(docs, False, True)
    chunks = B.either("cut_chunks", let(_column_sections(), lambda s: C.document_chunks(s)))
    return C.explode_chunks(cut, chunks if tables is None else C.with_tables(chunks, F.col("tables")))


def document_fields(docs: DataFrame, entities: DataFrame) -> DataFrame:
    """Title, counts, type, status, version and date of every document."""
    heads = prepare(docs).select(
        "doc_id",
        F.coalesce("body.title", "filename").alias("title"),
        F.col("body.counts.page_count").alias("page_count"),
        F.col("body.counts.word_count").alias("word_count"),
        F.lit("txt").alias("doc_type"), F.col("body.gate.status").alias("status"),
        F.col("body.gate.message").alias("status_message"),
        F.lit(V.PIPELINE_VERSION).alias("pipeline_version"))
    return heads.join(X.document_dates(entities), "doc_id", "left")


def derive(docs: DataFrame, tables: DataFrame | None = None) -> Derived:
    """All derived tables of ``docs(doc_id, filename, text)``."""
    prepared = prepare(docs)
    good = prepared.filter("body.gate.status = 'completed'")
    sections = T.explode_sections(good, F.col("body.sections"))
    entities = X.extract_entities(sections)
    text_measurements = X.extract_measurements(sections)
    table_rows = (X.measurements_from_tables(tables) if tables is not None else None)
    measurements = (X.union_measurements(table_rows, text_measurements) if tables is not None
                    else text_measurements)
    if tables is None:
        chunks = C.explode_chunks(good, C.document_chunks(F.col("body.sections")))
    else:
        chunks = C.explode_chunks(good.join(C.nest_tables(tables), "doc_id", "left"),
                                  C.document_chunks(F.col("body.sections"), F.col("tables")))
    return Derived(document_fields(docs, entities), P.explode_pages(prepared, F.col("body.pages")),
                   sections, entities, measurements, chunks)
