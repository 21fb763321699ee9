"""Written tables: cut points of plans whose parts are read several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of spark.checkpoint.dir, else of ``setCheckpointDir``;
    on a local master else the warehouse. A cluster without either gets an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = spark.conf.get("spark.sql.warehouse.dir")
    return named.rstrip("/") + "/written"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, which goes when the driver ends.

    It is computed once, however often it is read, and a lost executor costs no more than the running stage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
