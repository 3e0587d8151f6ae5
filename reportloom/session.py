"""Session settings and small helpers that depend on the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a few hundred kilobytes of text are already seconds of pattern matching,
    # so small partitions must not be merged into one task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
    # plain Unicode case mapping has a fast path for ASCII text
    "spark.sql.icu.caseMappings.enabled": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build(app: str = "reportloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(scan: DataFrame) -> DataFrame:
    """Even out a plain file scan that has fewer splits than there are cores.

    A large table has more splits than cores and is returned as it is, without a
    shuffle. Only for scans: counting the partitions of a scan runs no job.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
