"""Continuous intake: new documents, duplicate uploads and request rates.

A batch goes into several tables, each with a folder of its own for the batch, and becomes visible
to readers (``read_intake``) by one record written last. A batch that was stopped halfway is
written again under the same name when the stream restarts from its checkpoint; one that has its record is
left alone. So no reader sees half a batch, or one twice.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from reportloom.functions.skew import salted_lookup
from reportloom.operators import chunk as C, extract as X, pages as P, structure as T
from reportloom.plans import ingest
from reportloom.plans.store import is_folder, path_exists
from reportloom.session import spread
from reportloom.sources.files import decode_text, validate_manifest


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table, one file or a folder of part files, as a stream of its files."""
    table = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(table).schema)
    if is_folder(spark, table):
        return reader.parquet(table)
    # a source lists the files of a folder: the table's own is picked among its neighbours
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_text_files(spark: SparkSession, path: str) -> DataFrame:
    """New .txt files as documents; files that break a manifest rule carry the reason."""
    files = (spark.readStream.format("binaryFile").option("pathGlobFilter", "*.txt")
             .schema("path string, modificationTime timestamp, length bigint, content binary").load(path))
    named = files.select(
        F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("length").alias("size"), decode_text(F.col("content")).alias("text"))
    return validate_manifest(named)


def _batch_name(spark: SparkSession, checkpoint: str, epoch: int) -> str:
    """Name of a batch: the stream's own id, which its checkpoint keeps, and the batch's number."""
    return f"{json.loads(spark.read.text(f'{checkpoint}/metadata').first()[0])['id']}-{epoch}"


def _each_batch(stream: DataFrame, out: str, checkpoint: str, tables_of):
    """Write ``tables_of(batch)`` of every batch below ``out``, and its record last."""
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        name = _batch_name(spark, checkpoint, epoch)
        record = f"{out}/commits/batch={name}"
        if path_exists(spark, record):
            return
        tables, done = tables_of(batch)
        for table, rows in tables.items():
            writer = rows.write.mode("overwrite")
            (writer.partitionBy("hash_bucket") if "hash_bucket" in rows.columns else writer).parquet(f"{out}/{table}/batch={name}")
        spark.createDataFrame([(epoch, list(tables))], "epoch long, tables array<string>").write.mode("overwrite").parquet(record)
        done()

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def committed(spark: SparkSession, out: str) -> DataFrame | None:
    """Names of the batches that are complete."""
    if not path_exists(spark, f"{out}/commits"):
        return None
    return spark.read.parquet(f"{out}/commits").select(F.col("batch").cast("string").alias("batch"))


def read_intake(spark: SparkSession, out: str, table: str) -> DataFrame:
    """Rows of a table from complete batches; folders of others are not read."""
    rows = spark.read.parquet(f"{out}/{table}").withColumn("batch", F.col("batch").cast("string"))
    known = committed(spark, out)
    return (rows.filter("false") if known is None else rows.join(known, "batch", "left_semi")).drop("batch")


INTAKE_TABLES = ("status", "pages", "sections", "entities", "measurements", "chunks")


def start_ingest(documents: DataFrame, out: str, checkpoint: str):
    """Derive all tables (``INTAKE_TABLES``) of arriving documents and append them below ``out``.

    A batch is parsed once, by all cores, however few files it arrived in; documents that fail leave a status,
    and pages where they have any.
    """
    def tables_of(batch: DataFrame):
        accepted = batch.filter("reject_reason is null") if "reject_reason" in batch.columns else batch
        prepared = ingest.prepare_batch(spread(accepted.select("doc_id", "text"))).persist()
        status = prepared.select("doc_id", "gate.status", "gate.message")
        if "reject_reason" in batch.columns:
            status = status.unionByName(batch.filter("reject_reason is not null").select(
                "doc_id", F.lit("failed").alias("status"), F.col("reject_reason").alias("message")))
        good = prepared.filter("gate.status = 'completed'")
        sections = T.explode_sections(good, F.col("sections"))
        return {"status": status, "pages": P.explode_pages(prepared, F.col("pages")), "sections": sections,
                "entities": X.extract_entities(sections), "measurements": X.extract_measurements(sections),
                "chunks": C.explode_chunks(good, F.col("chunks"))}, prepared.unpersist

    return _each_batch(documents, out, checkpoint, tables_of)


def _hash_bucket(sha256: Column) -> Column:
    """The first byte of a hexadecimal digest."""
    return F.conv(F.left(sha256, F.lit(2)), 16, 10).cast("int")


def start_uploads(uploads: DataFrame, out: str, checkpoint: str):
    """Mark arriving ``file_id, owner_id, sha256`` with the first upload of the same content by the same owner.

    Digests of all earlier batches are kept in the table ``hashes`` in buckets of their first
    byte, however long ago they came; a batch reads the buckets of its own digests only, and
    appends those that are new. ``uploads`` gets every file with ``existing_id`` (null for a first
    upload). Within a batch the least file id is the first.
    """
    keys = ["owner_id", "sha256"]

    def tables_of(batch: DataFrame):
        files = batch.select("file_id", *keys).withColumn("hash_bucket", _hash_bucket(F.col("sha256"))).persist()
        spark = batch.sparkSession
        firsts = files.groupBy(*keys, "hash_bucket").agg(F.min("file_id").alias("_least"), F.count("*").alias("_n"))
        if path_exists(spark, f"{out}/hashes"):
            these = [r[0] for r in files.select("hash_bucket").distinct().collect()]
            known = read_intake(spark, out, "hashes").filter(F.col("hash_bucket").isin(these)).select(
                *keys, F.col("file_id").alias("_known"))
            firsts = firsts.join(known, keys, "left")
        else:
            firsts = firsts.withColumn("_known", F.lit(None).cast(files.schema["file_id"].dataType))
        firsts = firsts.persist()
        first = F.coalesce("_known", "_least")
        copied = firsts.filter("_n > 1 or _known is not null").select(*keys, first.alias("_first"))
        marked = salted_lookup(files.drop("hash_bucket"), copied, keys, "file_id").withColumn(
            "existing_id", F.when(F.col("_first") != F.col("file_id"), F.col("_first"))).drop("_first")
        new = firsts.filter("_known is null").select(*keys, F.col("_least").alias("file_id"), "hash_bucket")

        def done():
            files.unpersist()
            firsts.unpersist()
        return {"uploads": marked, "hashes": new}, done

    return _each_batch(uploads, out, checkpoint, tables_of)


def stream_dedup(files: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """First upload of a content per owner; later copies inside the delay are dropped, all of them without a delay.

    With a delay, uploads that the watermark has passed are dropped as late, those before 1970 always.
    """
    keys = ["owner_id", "sha256"]
    if delay is None:
        return files.dropDuplicates(keys)
    return files.withWatermark("uploaded_at", delay).dropDuplicatesWithinWatermark(keys)


def rate_violations(events: DataFrame, per_minute: int, delay: str = "10 minutes") -> DataFrame:
    """Actors with more than ``per_minute`` actions in one minute."""
    counted = (events.withWatermark("ts", delay)
               .groupBy(F.window("ts", "1 minute").alias("w"), "user_id").agg(F.count("*").alias("actions")))
    return counted.filter(F.col("actions") > per_minute).select(
        F.col("w.start").alias("minute"), "user_id", "actions")


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process everything that is available now into Parquet and read it back."""
    query = (stream.writeStream.format("parquet").option("path", path).outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
