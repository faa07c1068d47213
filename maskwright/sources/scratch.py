"""Written intermediates of the library's operators, in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where that is unset, a local session gets a folder of
    its own and a cluster is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}/{name}-{uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """The frame as a Parquet table, so that nothing after it is computed twice or depends on lost tasks."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Deletes the files of a frame that ``written`` returned and that nothing reads any more."""
    hadoop = df.sparkSession.sparkContext
    base = df.sparkSession.conf.get("spark.checkpoint.dir").rstrip("/").split(":", 1)[-1].lstrip("/")
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if folder.split(":", 1)[-1].lstrip("/").startswith(base):
            path = hadoop._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop._jsc.hadoopConfiguration()).delete(path, True)
