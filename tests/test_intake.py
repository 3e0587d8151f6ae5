"""Continuous intake into several tables: stopped batches, restarts, stored digests."""

import pytest
from pyspark.sql import DataFrameWriter

from pyspark.sql import functions as F

from reportloom.streaming import intake

TEXT = "Labs\nSodium: 138 mmol/L\nNotes\nSeen by Dr. Ann Lee on 2024-01-02.\n"


def _write(spark, path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def _stream(spark, path, schema="doc_id long, text string"):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _counts(spark, out):
    return {t: intake.read_intake(spark, out, t).groupBy("doc_id").count().collect() for t in intake.INTAKE_TABLES}


def test_a_stopped_batch_is_seen_once_or_not_at_all(spark, tmp_path, monkeypatch):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write(spark, inbox, [(1, TEXT), (2, TEXT + "More."), (3, "x")])
    intake.start_ingest(_stream(spark, inbox), out, out + "/cp").awaitTermination()
    _write(spark, inbox, [(4, TEXT)])
    real = DataFrameWriter.parquet

    def stops(self, path, *rest, **options):
        if "/measurements/batch=" in path:
            raise RuntimeError("stopped")
        return real(self, path, *rest, **options)
    monkeypatch.setattr(DataFrameWriter, "parquet", stops)
    with pytest.raises(Exception, match="stopped"):
        intake.start_ingest(_stream(spark, inbox), out, out + "/cp").awaitTermination()
    monkeypatch.setattr(DataFrameWriter, "parquet", real)
    # sections of the second batch are on disk, and no table shows them
    assert spark.read.parquet(out + "/sections").filter("doc_id = 4").count() > 0
    for rows in _counts(spark, out).values():
        assert {r.doc_id for r in rows} <= {1, 2, 3}
    before = {(t, r.doc_id): r["count"] for t, rows in _counts(spark, out).items() for r in rows}
    for _ in range(2):
        intake.start_ingest(_stream(spark, inbox), out, out + "/cp").awaitTermination()
    after = {(t, r.doc_id): r["count"] for t, rows in _counts(spark, out).items() for r in rows}
    assert {k: n for k, n in after.items() if k[1] != 4} == before
    assert {k[0]: n for k, n in after.items() if k[1] == 4} == {k[0]: n for k, n in after.items() if k[1] == 1}
    assert {k[0] for k in after if k[1] == 3} == {"status", "pages"}


def test_copies_of_long_ago(spark, tmp_path):
    schema = "file_id long, owner_id string, sha256 string"
    first, second, out = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "out")
    digest = [f"{i:02x}" * 32 for i in range(256)]
    _write(spark, first, [(i, "o", digest[i % 8]) for i in range(10, 30)] + [(40, "p", digest[0])], schema)
    intake.start_uploads(_stream(spark, first, schema), out, out + "/cp1").awaitTermination()
    _write(spark, second, [(1, "o", digest[3]), (2, "q", digest[3]), (3, "o", digest[200]), (4, "o", digest[200])], schema)
    _write(spark, second, [(0, "o", digest[200]), (5, "o", digest[0])], schema)
    for _ in range(2):  # another stream, restarted once
        intake.start_uploads(_stream(spark, second, schema), out, out + "/cp2").awaitTermination()
    got = {(r.file_id, r.owner_id): r.existing_id for r in intake.read_intake(spark, out, "uploads").collect()}
    first_of = {d: min(i for i in range(10, 30) if i % 8 == d) for d in range(8)}
    want = {(i, "o"): None if first_of[i % 8] == i else first_of[i % 8] for i in range(10, 30)} | {(40, "p"): None}
    assert {k: v for k, v in got.items() if k in want} == want
    assert got[1, "o"] == first_of[3] and got[2, "q"] is None and got[5, "o"] == first_of[0]
    # files of one stream come in the order Spark lists them: 3 is first unless 0 came before
    assert (got[3, "o"], got[4, "o"], got[0, "o"]) in {(None, 3, 3), (0, 0, None)}
    assert len(got) == len(want) + 6


def _folder_table(spark, tmp_path):
    """``documents`` as a folder of part files, beside a table that is one file and one of a like name."""
    rows = [(i, TEXT + "More. " * (i % 3), "ab"[i % 2]) for i in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    table.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    table.limit(5).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet2")
    return str(tmp_path), rows


def test_a_table_in_a_folder_is_a_stream(spark, tmp_path):
    sf_dir, rows = _folder_table(spark, tmp_path / "in")
    out = str(tmp_path / "out")
    docs = intake.stream_table(spark, sf_dir, "documents").select("doc_id", "text")
    intake.start_ingest(docs, out, out + "/cp").awaitTermination()
    assert sorted(r.doc_id for r in intake.read_intake(spark, out, "status").collect()) == [r[0] for r in rows]


def test_copies_of_a_table_in_a_folder(spark, tmp_path):
    sf_dir, rows = _folder_table(spark, tmp_path / "in")
    uploads = intake.stream_table(spark, sf_dir, "documents").selectExpr(
        "source as owner_id", "sha2(text, 256) as sha256", "timestamp_seconds(doc_id + 1700000000) as uploaded_at")
    done = intake.run_to_table(intake.stream_dedup(uploads, "10000 days"), f"{tmp_path}/rows", f"{tmp_path}/cp")
    assert done.count() == len({(r[1], r[2]) for r in rows})


def test_a_batch_of_one_file_is_parsed_by_all_cores(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write(spark, inbox, [(i, TEXT) for i in range(40)])
    intake.start_ingest(_stream(spark, inbox), out, out + "/cp").awaitTermination()
    sections = intake.read_intake(spark, out, "sections")
    assert sections.count() == 80
    assert len(sections.inputFiles()) >= spark.sparkContext.defaultParallelism > 1


def test_no_upload_is_too_late_without_a_delay(spark, tmp_path):
    from reportloom.checks.registry import QUERIES
    import reportloom.checks.operations  # noqa: F401  (registers the query)
    ids = [-2_000_000_000, 1, 2, 10**9, 10**10, None]
    rows = [(i, f"text {k // 2}", "s") for k, i in enumerate(ids)] + [(5, None, None), (6, None, None), (-2_000_000_001, "early", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["w2_stream_dedup"](spark, str(tmp_path)).collect()
    assert len(got) == len({(r.owner_id, r.sha256) for r in got}) == 5
    one = str(tmp_path / "one")
    _write(spark, one, [(-2_000_000_000, "a"), (1, "b")])
    _write(spark, one, [(10**10, "a"), (2, "c")])
    uploads = _stream(spark, one).selectExpr("'o' as owner_id", "text as sha256", "timestamp_seconds(doc_id + 1700000000) as uploaded_at")
    done = intake.run_to_table(intake.stream_dedup(uploads, None), f"{tmp_path}/rows", f"{tmp_path}/cp")
    assert sorted(r.sha256 for r in done.collect()) == ["a", "b", "c"]


def test_intake_cuts_plain_reports_in_batches_as_the_columns_do(spark):
    from reportloom.operators import chunk as C
    from reportloom.plans import ingest
    texts = [TEXT, TEXT + "Labs\nSodium: 3 mmol/L\n1 / 2", "Élan\n\nLabs\nSodium: 3", "a  b", "", None, "12", "x" * 4000 + "\n\nLabs\nx", "tiny"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = ingest.prepare_batch(rows)
    assert "MapInArrow" in made._jdf.queryExecution().toString()
    got = {r.doc_id: (r.pages, r.gate, r.sections, r.chunks) for r in made.collect()}
    columns = ingest.prepare(rows).select("doc_id", "body", C.document_chunks(F.col("body.sections")).alias("chunks"))
    assert got == {r.doc_id: (r.body.pages, r.body.gate, r.body.sections, r.chunks) for r in columns.collect()}
