"""Tables that cut lineage: written once to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where the setting is missing and the master is local (tests, benches)
    a temporary folder takes its place; a cluster without the setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-cut-")
    return _OWN[app]


def require(df: DataFrame, condition: Column, message: Column) -> DataFrame:
    """``df``, or an error when a row is read that does not meet ``condition``; as a filter it survives column pruning."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def new_path(spark: SparkSession, kind: str) -> str:
    """A path in the shared folder that ``clear`` removes."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Remove every table that this application has cut so far; call it when no result that reads them is needed any more."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(made)


def cut(df: DataFrame, batch_rows: int | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; ``compression`` names another codec than the session's.

    The result has no lineage: a lost executor costs the tasks it ran, not a
    recomputation of what lies before the cut. ``batch_rows`` bounds the rows
    that a Python worker gets at once while this table is made.
    """
    spark = df.sparkSession
    path = new_path(spark, "cut")
    before = spark.conf.get(BATCH)
    if batch_rows:
        spark.conf.set(BATCH, str(batch_rows))
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)
