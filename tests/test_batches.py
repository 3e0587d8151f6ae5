"""Plain reports cut in Arrow batches are those of the column form, section by section and chunk by chunk."""

import random

from pyspark.sql import functions as F

from reportloom.functions.arrays import let
from reportloom.operators import batches as B, chunk as C, structure as S
from reportloom.plans import ingest

LINES = ["", "Labs", "Labs:", "LABS ::", "Past Medical History", "1. Labs", "2) notes:", "10.2. Plan", "3 / 4", "page 2 of 9", "Page 2of 9",
         "- 7 -", "12", "12345", "iv / 3", "Document", "Document:", "ALLERGIES NOTED TODAY", "A1", "AB", "B", "Is this one?:", "Take these: now",
         "Sodium: 138 mmol/L", "Nothing to add.", "One. Two! Three? four", "Klabs", "follow up :", "x" * 95 + ":", ":", "...", "Plan : :",
         "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN", "a sentence that goes on. " * 5 + "end", "y" * 700 + ".",
         "one two three four five six seven eight nine ten eleven twelve:", "Labs."]
ODD = ["a  b", "a\tb", "tail ", " Notes", "c\x07d", "g\rh", "Élan vital:", "İcu:", "z" * 1400]


def test_batches_and_columns(spark):
    rng = random.Random(8)
    texts = [None, "", "\n", " ", "12", "Labs", "\n\nLabs\n", "\n12\n", "Document\nx", "Document\n\n\n\nLabs\n1 / 1"] + LINES + ODD
    texts += ["\n".join(rng.choices(LINES if i % 4 else LINES + ODD, k=rng.randint(1, 25))) for i in range(800)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    plain = [t for t in texts if B.cut_sections(t) is not None]
    assert 300 < len(plain) < len(texts) - 20

    column = let(ingest.cleaned_pages(F.col("text")), S.detect_sections)
    got = {r.doc_id: r for r in ingest.sections_and_chunks(rows).collect()}
    for r in rows.select("doc_id", "text", column.alias("s"), C.document_chunks(column).alias("c")).collect():
        assert got[r.doc_id].sections == r.s, r.text
        assert got[r.doc_id].chunks == r.c, r.text
    want = S.explode_sections(rows, column)
    assert ingest.sections_of(rows).schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, ingest.sections_of(rows).collect())) == sorted(map(str, want.collect()))


def test_chunks_with_tables(spark):
    rows = spark.createDataFrame([(1, "Labs\nSodium: 3"), (2, "Élan\nx"), (3, "Notes\nfine."), (4, ""), (5, None)], "doc_id long, text string")
    tables = spark.createDataFrame([(d, 1, k, ["Test"], [["a"]], None if k else "cap") for d in (1, 2, 4, 5) for k in (0, 1)] + [(3, 1, 0, [], [], "")],
                                   "doc_id long, page_number int, table_index int, header array<string>, rows array<array<string>>, caption string")
    got = {}
    for r in ingest.chunks_of(rows, tables).collect():
        got.setdefault(r.doc_id, {})[r.chunk_index] = (r.section_idx, r.text, r.is_table_chunk)
    table = [(None, "Table: cap\nTest\na", True), (None, "Test\na", True)]
    assert got == {1: {0: (0, "Sodium: 3", False), 1: table[0], 2: table[1]}, 2: {0: (0, "Élan\nx", False), 1: table[0], 2: table[1]},
                   3: {0: (0, "fine.", False)}, 4: dict(enumerate(table))}
