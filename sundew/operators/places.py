"""The place of every row in an order, without bringing the rows to one task."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names and all executors share. Only a local session, whose executors are the
    driver, may leave it unset and gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder. Spark deletes the files when no plan refers to them any more."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def positions(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """``df`` with the 0-based place of each row in the given order.

    Rows are dealt by range and numbered within partitions; only one count for each partition meets in one place.
    """
    dealt = checkpoint(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__row", within).join(sums, "__part").withColumn(name, F.col("__row") - 1 + F.col("__before")).drop("__part", "__row", "__before")


def running_sums(df: DataFrame, sums: dict[str, Column], *order) -> DataFrame:
    """``df`` with the sum of each named value over a row and all rows before it in the given order, found like places."""
    dealt = checkpoint(df.repartitionByRange(*order).withColumns({f"__v_{n}": v for n, v in sums.items()}).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("__part").agg(*[F.sum(f"__v_{n}").alias(f"__p_{n}") for n in sums])
    parts = parts.select("__part", *[F.coalesce(F.sum(f"__p_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])  # one row for each partition
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumns({f"__s_{n}": F.sum(f"__v_{n}").over(within) for n in sums}).join(parts, "__part")
    return summed.withColumns({n: F.col(f"__s_{n}") + F.col(f"__b_{n}") for n in sums}).drop("__part", *[f"__{k}_{n}" for n in sums for k in "vsb"])
