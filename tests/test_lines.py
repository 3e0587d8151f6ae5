"""Sections over a line table against the array form; places of texts in chunks."""

import random

from pyspark.sql import functions as F

from reportloom.operators import chunk as C, compare as A, lines as L, structure as S


def test_sections_of_lines_are_those_of_the_array_form(spark):
    rng = random.Random(3)
    kinds = ["Medications", "LAB RESULTS:", "1. Assessment", "plain words here", "", "  ", "Notes:", "more text.", "DOCUMENT", "ALL UPPER CASE"]
    pages = [(d, p, "\n".join(rng.choice(kinds) for _ in range(rng.randint(0, 12)))) for d in range(30) for p in range(1, 4)]
    # one document with most of the lines, pages of two thousand
    pages += [(99, p, "\n".join(rng.choice(kinds) for _ in range(2000))) for p in range(1, 8)]
    pages += [(100, 1, ""), (101, 1, "\n \n"), (102, 1, "Document\ntext"), (103, 2, "only text")]
    df = spark.createDataFrame(pages, "doc_id long, page_number int, text string")
    nested = df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "page_number", "text", F.lit("text").alias("method")))).alias("pages"))
    columns = ["doc_id", "section_idx", "title", "kind", "page_number", "text"]
    want = S.explode_sections(nested, S.detect_sections(F.col("pages"))).select(*columns).collect()
    got = L.sections_of_lines(L.page_lines(df)).select(*columns).collect()
    assert len(got) > 3000 and sorted(map(str, got)) == sorted(map(str, want))
    assert L.sections_of_lines(L.page_lines(df.limit(0))).count() == 0


def test_places_in_chunks(spark):
    # sentences of one section fall into several chunks; white space changes on the way
    text = "\n\n".join("  ".join(f"Drug {b}{i} was given   at noon." for i in range(40)) for b in "abc")
    sections = spark.createDataFrame([(1, 0, "Notes", 1, text), (1, 1, "None", 1, "  "), (2, 0, "Short", 1, "Drug x.")],
                                     "doc_id long, section_idx int, title string, page_number int, text string")
    nested = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(
        "section_idx", "title", F.lit(None).cast("string").alias("kind"), "page_number", "text"))).alias("s"))
    chunks = C.explode_chunks(nested, C.document_chunks(F.col("s")))
    held = {(r.doc_id, r.chunk_index): r.text for r in chunks.collect()}
    assert len(held) > 4
    asked = [(1, 0, f"Drug {b}{i} was") for b in "abc" for i in range(40)] + [(1, 0, "absent"), (1, 1, "x"), (2, 0, "Drug x."), (9, 0, "y")]
    rows = spark.createDataFrame([(*a, k) for k, a in enumerate(asked)], "doc_id long, section_idx int, needle string, k int")
    got = {r.k: r.chunk_index for r in A.place_in_chunks(rows, sections, chunks).collect()}
    want = {k: min(c for (d, c), t in held.items() if d == doc and needle in t) for k, (doc, _, needle) in enumerate(asked)
            if any(d == doc and needle in t for (d, _), t in held.items())}
    assert got == want and len(want) == 121
