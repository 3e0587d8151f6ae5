"""Comparison, sources, streaming and skew on small tables."""

import random

from pyspark.sql import functions as F

from reportloom.functions.skew import salted_lookup
from reportloom.operators import compare as A, evaluate as E, manage as O, pages as P
from reportloom.plans import ingest
from reportloom.sources import files
from reportloom.streaming import intake

MEAS = ("doc_id long, ord int, name string, value_raw string, value_num double, unit string, reference_range string, "
        "flag string, page_number int, section_idx int, source_snippet string")


def meas(doc, order, name, value, unit="mg/dL"):
    return (doc, order, name, value, float(value), unit, "1-10", None, 1, 0, f"{name} {value}")


def pair(spark):
    return spark.createDataFrame([(7, 1, 2)], "pair_id long, doc_a long, doc_b long")


def test_comparison(spark):
    m = spark.createDataFrame([meas(1, 0, "Hemoglobin", "13.2"), meas(1, 1, "Glucose", "108"), meas(1, 2, "TSH", "2"),
                               meas(2, 0, "hemoglobin", "11.8", "g/L"), meas(2, 1, "Glucose", "108.0"),
                               meas(2, 2, "ALT", "62")], MEAS)
    rows = {r.key: r for r in A.compare_measurements(pair(spark), m).collect()}
    assert rows["hemoglobin"].change_note == "Value changed from 13.2 to 11.8 (-1.4). Unit: mg/dL → g/L."
    assert [rows[k].change_type for k in ("glucose", "tsh", "alt")] == ["unchanged", "removed", "added"]
    assert rows["alt"].item == "Alt"


def test_conflicts(spark):
    m = spark.createDataFrame([meas(1, 0, "Glucose", "100"), meas(1, 1, "Glucose", "108"), meas(1, 2, "Glucose", "100"),
                               meas(2, 0, "Glucose", "100"), meas(2, 1, "Glucose", "90")], MEAS)
    cross = A.value_conflicts(pair(spark), m).collect()
    assert [(r.claim_a, r.claim_b) for r in cross] == [("Glucose = 108", "Glucose = 100")]
    inside = {(r.claim_a, r.claim_b) for r in A.internal_conflicts(m.filter("doc_id = 1")).collect()}
    assert inside == {("Glucose = 100", "Glucose = 108"), ("Glucose = 108", "Glucose = 100")}


def test_entity_difference(spark):
    ents = spark.createDataFrame(
        [(1, "medication", "Metformin", "metformin", 1), (2, "medication", "metformin", "metformin", 1),
         (2, "medication", "gabapentin", "gabapentin", 1), (2, "dose", "5 mg", "5 mg", 1)],
        "doc_id long, entity_type string, raw_text string, normalized_text string, page_number int")
    got = [(r.category, r.item, r.change_type) for r in A.compare_entities(pair(spark), ents).collect()]
    assert got == [("Medications", "gabapentin", "added")]


def test_salted_lookup_is_the_plain_join(spark):
    rng = random.Random(1)
    # one key holds a third of the rows
    facts = spark.createDataFrame([(i, 0 if rng.random() < 0.34 else rng.randint(1, 50)) for i in range(600)], "id int, k int")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 51, 2)], "k int, v string")
    plain = sorted(map(tuple, facts.join(lookup, "k", "left").select("id", "k", "v").collect()))
    assert sorted(map(tuple, salted_lookup(facts, lookup, ["k"], "id").select("id", "k", "v").collect())) == plain


def test_files_and_duplicates(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Größe\r\nzwei".encode())
    (tmp_path / "b.txt").write_bytes("Größe\rzwei".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b"  \n")
    rows = {r.path[-5:]: r for r in files.read_text_files(spark, str(tmp_path)).collect()}
    assert rows["a.txt"].text == rows["b.txt"].text == "Größe\nzwei"
    assert rows["c.txt"].error == "Text file is empty"
    f = spark.createDataFrame([(i, "o", "same") for i in range(5)] + [(9, "p", "same")], "file_id int, owner_id string, sha256 string")
    got = {r.file_id: r.existing_id for r in files.dedup_by_content(f).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 0, 4: 0, 9: None}


def test_manifest(spark):
    rows = [("../../x/re<port>.TXT", 5), ("a.txt", 0), ("a.txt", 31 * 2**20), ("noext", 3), ("run.exe", 3), ("...", 3)]
    got = [(r.clean_name, r.reject_reason) for r in files.validate_manifest(
        spark.createDataFrame(rows, "filename string, size long")).collect()]
    assert got == [("re_port_.TXT", None), ("a.txt", "Uploaded file is empty"), ("a.txt", "File exceeds 30 MB limit"),
                   ("noext", "File has no extension"), ("run.exe", "File type '.exe' not allowed"), ("", "Invalid filename")]


def test_written_tables_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, "r.txt", f"Labs\nSodium: {130 + i} mmol/L\nNotes\nSeen 2024-01-0{i + 1}.") for i in range(4)],
                                 "doc_id long, filename string, text string")
    made = ingest.derive(docs)
    files.write_tables({"chunks": made.chunks, "measurements": made.measurements}, str(tmp_path), 4)
    assert files.read_back(spark, str(tmp_path), "chunks").count() == made.chunks.count() == 8
    assert {r.value_num for r in files.read_back(spark, str(tmp_path), "measurements").collect()} == {130.0, 131.0, 132.0, 133.0}
    assert O.check_provenance(docs, made.pages, made.sections, made.chunks).count() == 0
    kept = O.delete_documents({"chunks": made.chunks}, docs.filter("doc_id < 2"))["chunks"]
    assert {r.doc_id for r in kept.collect()} == {2, 3}


def test_ocr_pages(spark):
    pages = spark.createDataFrame(
        [(1, 1, "native text that is long enough", None, None), (1, 2, "", "recognised words", 80.0),
         (1, 3, "", "recognised words", 10.0), (1, 4, "short", None, None), (1, 5, "", "recognised again", 90.0)],
        "doc_id int, page_number int, native_text string, ocr_text string, ocr_confidence double")
    got = [r.method for r in P.classify_pages(pages, ocr_cap=1).orderBy("page_number").collect()]
    assert got == ["text", "ocr", "ocr-failed", "empty", "ocr-failed"]


def test_prf_of_empty_sets(spark):
    gold = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", None)], "g string, i string")
    found = spark.createDataFrame([("a", "x"), ("a", "z"), ("b", None)], "g string, i string")
    got = {r.g: (r.tp, r.fp, r.fn, r.precision, r.f1) for r in E.prf(found, gold, "g", "i").collect()}
    assert got == {"a": (1, 1, 1, 0.5, 0.5), "b": (0, 0, 0, 1.0, 1.0)}


def test_streamed_files(spark, tmp_path):
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    inbox.mkdir()
    (inbox / "one.txt").write_text("Labs\nSodium: 138 mmol/L and a little more text here.")
    intake.start_ingest(intake.stream_text_files(spark, str(inbox)), out, f"{out}/cp").awaitTermination()
    (inbox / "two.txt").write_text("tiny")
    (inbox / "blank.txt").write_text(" \n")
    intake.start_ingest(intake.stream_text_files(spark, str(inbox)), out, f"{out}/cp").awaitTermination()
    status = [r.status for r in spark.read.parquet(f"{out}/status").collect()]
    assert sorted(status) == ["completed", "failed", "failed"]
    assert spark.read.parquet(f"{out}/chunks").count() >= 1


def test_rows_of_a_page_listing(spark):
    docs = spark.createDataFrame([(i, i % 2, i) for i in range(10)], "doc_id int, owner_id int, created_at int")
    got = sorted(r.doc_id for r in O.list_documents(docs, 1, 2).collect())
    assert got == [4, 5, 6, 7]
    assert O.newest_runs(docs.select(F.col("doc_id").alias("run_id"), "created_at"), limit=3).count() == 3


def _measured(*rows):
    return [(d, i, name, str(v), float(v), None, None, None, 1, None, f"{name} {v}") for d, i, name, v in rows]


MEASURED = ("doc_id long, ord int, name string, value_raw string, value_num double, unit string, reference_range string, "
            "flag string, page_number int, section_idx int, source_snippet string")


def test_comparison_notes_and_pairs_without_rows(spark):
    from reportloom.operators import compare as A
    rows = _measured((1, 0, "Iron", 1.0), (2, 0, "Iron", 1.0005), (1, 1, "Zinc", 10), (2, 1, "Zinc", 25000000),
                     (1, 2, "Lead", 3), (2, 2, "Gold", 4), (1, 3, "Tin", 2.5), (2, 3, "Tin", 2.50))
    pairs = spark.createDataFrame([(7, 1, 2), (8, 3, 4)], "pair_id long, doc_a long, doc_b long")
    compared = A.compare_measurements(pairs, spark.createDataFrame(rows, MEASURED))
    titles = spark.createDataFrame([(1, "June"), (2, "July"), (3, "x"), (4, "y")], "doc_id long, title string")
    notes = {r["item"]: r for r in A.note_missing(compared, pairs, titles).collect()}
    assert "(+0.0005)" in notes["Iron"].change_note and "(+24999990.0)" in notes["Zinc"].change_note
    assert (notes["Lead"].change_type, notes["Gold"].change_type, notes["Tin"].change_type) == ("removed", "added", "unchanged")
    assert "June" in notes["Lead"].change_note and "July" in notes["Gold"].change_note
    terms = spark.createDataFrame([], "pair_id long, change_type string")
    done = {r.pair_id: r for r in A.comparison_summary(compared, terms, pairs).collect()}
    assert done[8].compared == 0 and done[8].summary.startswith("Compared 0 ")
    assert (done[7].changed, done[7].added, done[7].removed, done[7].unchanged) == (2, 1, 1, 1)


def test_recall_counts_six_ranks(spark):
    from reportloom.operators import evaluate as E
    cases = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, 2), (2, 9)], "query_id int, rank int")
    row = E.retrieval_eval(cases, hits).first()
    assert (row.recall_at_3, row.recall_at_6) == (0.3333, 0.3333)
