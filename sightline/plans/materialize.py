"""Cutting a plan: results that several later steps read are written once to the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import workspace

#: Rows of at most this many bytes in all may be broadcast.
BROADCAST_BYTES = 32 << 20


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: columnar, so that later readers prune columns, and safe when executors are lost."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *key: str) -> DataFrame:
    """df over all cores, if it is read in fewer tasks than there are: a small table in one file would else be worked on by one. Hashed by key, so that a retry gives the same."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df.rdd.getNumPartitions() < cores else df


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its counted rows fit in limit bytes, else unmarked: the join then shuffles, with AQE splitting its skew."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df
