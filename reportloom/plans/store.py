"""Written intermediate tables.

Tables used several times are written once to the shared folder that the session
names in ``spark.checkpoint.dir``. A written table survives the loss of executors
and cuts the lineage. Where the setting is missing, only a local session may fall
back to a folder of its own.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"

_OWN: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder all executors share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = tempfile.mkdtemp(prefix="spark-reportloom-")
    return _OWN[key]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and read it back."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def path_exists(spark: SparkSession, where: str) -> bool:
    files, path = _hadoop(spark, where)
    return files.exists(path)


def is_folder(spark: SparkSession, where: str) -> bool:
    files, path = _hadoop(spark, where)
    return files.getFileStatus(path).isDirectory()


def folders(spark: SparkSession, where: str) -> list[str]:
    """Names of the folders right below ``where``."""
    files, path = _hadoop(spark, where)
    return sorted(f.getPath().getName() for f in files.listStatus(path) if f.isDirectory())


def delete_path(spark: SparkSession, where: str) -> None:
    files, path = _hadoop(spark, where)
    files.delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read again."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            delete_path(table.sparkSession, folder)


_STORED: dict[tuple, object] = {}


def stored(spark: SparkSession, *key, build):
    """The result of ``build()``, made once per session and key.

    Derived tables are written when documents come in and read by every later
    question; this is the same for a session: built once, then read.
    """
    full = (spark.sparkContext.applicationId, *key)
    if full not in _STORED:
        _STORED[full] = build()
    return _STORED[full]
