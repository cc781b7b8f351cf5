"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

_TEMPORARY: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. A local session that names none gets a temporary folder; on a
    cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        app = spark.sparkContext
        if not app.master.startswith("local") or app.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        at = _TEMPORARY.get(app.applicationId) or tempfile.mkdtemp(prefix="tesserae-")
        _TEMPORARY[app.applicationId] = at
    return at.rstrip("/")


def hadoop_path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def temporary(spark: SparkSession, label: str) -> str:
    """A new folder's place in the shared folder; it goes when the driver ends."""
    at = f"{shared_dir(spark)}/tesserae/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, at))
    return at


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back; it goes when the driver ends."""
    spark = df.sparkSession
    at = temporary(spark, label)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@atexit.register
def drop_staged() -> None:
    """Deletes what this driver has staged."""
    while _WRITTEN:
        spark, at = _WRITTEN.pop()
        try:
            path, fs = hadoop_path(spark, at)
            fs.delete(path, True)
        except Exception:  # the session's JVM has gone before: the folder is left to its owner
            return


def small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows that the caller holds, as a local relation: no job and no Python worker reads it,
    and the optimizer knows its size."""
    fields = to_arrow_schema(_parse_datatype_string(schema))
    columns = list(zip(*rows)) or [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields), _parse_datatype_string(schema))
