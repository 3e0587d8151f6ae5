"""Entities as rows are those of the array form, and the first mentions of plain Python matching."""

import random
import re

from pyspark.sql import functions as F

from reportloom.operators import extract as X

WORDS = ["2024-03-05", "3/4/2024", "March 5, 2024", "Metformin", "metformin", "10 mg", "5 units", "120/80 mmHg", "37.2 C", "Brook Clinic",
         "Dr. Ada Moss", "BP", "er", "\n", "\u0001", "x" * 80, "Omeprazole 20 mg", "."]


def test_rows_and_arrays(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(WORDS) + rng.choice([" ", "", "\n", ", "]) for _ in range(rng.randint(0, 40))) for _ in range(300)] + ["", None]
    rows = spark.createDataFrame([(i, 0, 1, t) for i, t in enumerate(texts)], "doc_id long, section_idx int, page_number int, text string")
    key = ["doc_id", "section_idx", "page_number"]
    array = rows.select(*key, F.explode(X.entity_hits(F.col("text"))).alias("e")).select(*key, *(f"e.{c}" for c in X.ENTITY_COLUMNS))
    got = X.extract_entities(rows)
    assert got.schema == array.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, array.collect()))
    pattern = re.compile(r"(?i)(?=\d)\b(\d+(?:\.\d+)?)\s*(mg|mcg|g|kg|ml|mmol|units?|iu)\b")
    doses = {(r.doc_id, r.raw_text): r.source_snippet for r in got.filter("entity_type = 'dose'").collect()}
    want = {}
    for i, t in enumerate(texts):
        for m in pattern.finditer(t or ""):
            want.setdefault((i, m.group(0).strip()), t[max(0, m.start() - 60):m.end() + 60].replace("\n", " "))
    assert len(want) > 100 and doses.keys() == want.keys()
    # white space ends a snippet's sides; the control character is no white space
    assert all(doses[k] == want[k].strip(" \t\r\n") for k in want)


def test_plain_texts_in_batches_and_by_columns(spark):
    rng = random.Random(11)
    words = ["2024-03-05", "12024-03-05", "13/4/2024", "3/45/2024", "2/3/1899", "31-12-2023", "1-2-34", "2024-13-99", "march 5 2024", "May 5,2024",
             "MARCHES 5 2024", "Metformin", "xmetforminx", "ferrous sulfate", "ferrous", "co-omeprazole", "azole", "b-lisinopril-x", "10mg", "1.5 mcg",
             "3. g", "2 UNITS", "5 iu", "7 mgx", "9_mg", "_9 mg", "a9 mg", "120/80", "120 / 80 mm Hg", "1200/80", "12/34/2024", "37.2 degrees c", "101f",
             "98 Celsius", "98.6", "1234 c", "deg", "Mercy General Clinic", "St. Mary's Hospital", "Labs", "Health System", "health system", "Laboratory",
             "Dr. Ada Moss", "Dr Ada", "dr. ada", "Dr", "BP", "5bp", "bp5", "bp-er", "ER.", "erx", "x-po", "po_", "\n", " ", "-", "/", "x" * 70, ".", ","]
    texts = ["".join(rng.choice(words) + rng.choice([" ", "", "\n", ", "]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    rows = spark.createDataFrame([(i, i % 3, 1, t) for i, t in enumerate(texts)], "doc_id long, section_idx int, page_number int, text string")
    plan = X.extract_entities(rows)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan
    got, want = (sorted(map(str, f.collect())) for f in (X.extract_entities(rows), X.extract_entities(rows, list(X.ALL_RULES))))
    assert len(want) > 10000 and got == want
