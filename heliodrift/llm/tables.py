"""Intermediate tables in the shared folder: they cut the lineage and outlive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from heliodrift.session import shared_folder


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read again.

    Readers prune its columns. The files go when the driver's JVM ends.
    """
    spark = df.sparkSession
    place = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(place)
    return spark.read.schema(df.schema).parquet(place)
