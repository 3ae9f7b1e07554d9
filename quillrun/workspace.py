"""A folder that all executors see, and tables written there to cut a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where that is unset and the
    master is local, as in tests, is a folder of our own made and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    base = spark.sparkContext.getCheckpointDir()
    if base:
        return base.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="quillrun-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over as many tasks as the session shuffles into, by a hash of keys. For much
    work on rows of few bytes: by its bytes such a table is read, and a shuffle of
    it folded, into one or two tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
