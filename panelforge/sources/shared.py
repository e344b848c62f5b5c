"""Tables in the folder that driver and executors share, for steps that go in rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_path(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; in local mode without the setting a temporary folder stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="panelforge-"))
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written to the shared folder (at ``path``, or a new one) and read back, so that its lineage ends there."""
    path = path or shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
