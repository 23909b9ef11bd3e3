"""Reading the model tables of a directory, one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key, the first of ``order``. The rank limit is applied before the shuffle, so a hot key costs one row a task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def current_memory(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Current rows of ``tm_exact``: the latest ``updated_at`` of each ``source_hash``; ties fall to the larger texts."""
    need = list(dict.fromkeys(["source_hash", "source_norm", "target_text", "updated_at", *columns]))
    df = table(spark, sf_dir, "tm_exact").select(*need)
    order = [F.col("updated_at").desc_nulls_last(), F.col("source_norm").desc_nulls_last(), F.col("target_text").desc_nulls_last()]
    return keep_latest(df, ["source_hash"], order)
