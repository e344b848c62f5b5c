"""Files in and out: typed JSON lines, Parquet, quarantined rows as CSV, and a table's order-free fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a declared schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_parquet(df: DataFrame, path: str, *by: str) -> None:
    df.write.partitionBy(*by).option("compression", "zstd").parquet(path)


def write_quarantine(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def fingerprint(df: DataFrame) -> DataFrame:
    """(n, digest): sha256 over schema, row count and the sum of row hashes, whatever the order of rows."""
    total = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"))
    return total.select("n", F.sha2(F.concat_ws("|", F.lit(df.schema.json()), F.col("n").cast("string"), F.col("s").cast("string")).cast("binary"), 256).alias("digest"))
