"""Small tables over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_dealt(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table. One that has fewer parts than there are cores, as a small one in a single row group, is dealt to
    as many; larger tables, which have more, are read where they lie.
    """
    df, cores = spark.read.parquet(path), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
