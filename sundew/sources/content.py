"""Nodes, access lists, hierarchy and change log as tables, and the sinks that keep them: upsert, delete, merge, snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as nodes: dbid, text, locale, source, size, aclid, owner."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("dbid"), "text", F.col("lang").alias("locale"), "source", F.col("n_chars").alias("size"), (F.col("doc_id") % 16).alias("aclid"), F.concat(F.lit("user"), (F.col("doc_id") % 7).cast("string")).alias("owner"))


def access_lists(spark: SparkSession) -> DataFrame:
    """aclid, readers, denied: sixteen lists by arithmetic on their number."""
    group = lambda c: F.concat(F.lit("GROUP_R"), c.cast("string"))
    a = F.col("aclid")
    return spark.range(16).withColumnRenamed("id", "aclid").select("aclid", F.array_distinct(F.array(group(a % 5), group(a * 3 % 7))).alias("readers"), F.when(a % 4 == 0, F.array(F.lit("GROUP_D1"))).otherwise(F.array().cast("array<string>")).alias("denied"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, paths: region, nation, customer and order as one tree. The upper levels are small tables that Spark
    broadcasts below its own threshold."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    up = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    both = o.join(up, o.o_custkey == up.c_custkey)
    return both.select("o_orderkey", "o_custkey", "r_name", "n_name", "c_name", F.array(F.concat_ws("/", F.lit(""), "r_name", "n_name", "c_name", F.col("o_orderkey").cast("string"))).alias("paths"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log: tx, commit time, node, what (an error event deletes), value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("tx"), F.col("ts").alias("commit"), F.col("user_id").alias("dbid"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("what"), "event_type", "value")


def latest(df: DataFrame, key: str, *newest: Column) -> DataFrame:
    """One row for each key: the newest."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*newest))).where("__n = 1").drop("__n")


def upsert(now: DataFrame, more: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of both, the newest of each key; writing the same rows again changes nothing."""
    return latest(now.unionByName(more), key, F.desc(order))


def delete(now: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return now.join(gone.select(key).distinct(), key, "left_anti")


def merge_fields(now: DataFrame, more: DataFrame, key: str, clear: tuple[str, ...] = ()) -> DataFrame:
    """Field-level updates: a new value where there is one, else the old one. A null says nothing of its field, but for the
    fields named in ``clear``, which an updated row's null empties."""
    new = more.select(F.col(key), F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in more.columns if c != key])
    both = now.join(new, key, "full")
    value = lambda c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)) if c in clear else F.coalesce(f"__{c}", c)
    return both.select(key, *[value(c).alias(c) if c in more.columns else F.col(c) for c in now.columns if c != key])


def unique_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.array_distinct(c) for c in columns})


def next_commit(log: DataFrame, after) -> DataFrame:
    return log.where(F.col("commit") >= F.lit(after)).agg(F.min("commit").alias("commit"))


def transactions(log: DataFrame, since=None, until=None, first: int | None = None, last: int | None = None, most: int | None = None) -> DataFrame:
    """Transactions from one commit time (inclusive) to another (exclusive) and from one id to another, oldest first; ``most`` of
    them. Filters on the log's own columns reach its files."""
    for at, bounds in (("commit", (since, until)), ("tx", (first, last))):
        low, high = bounds
        if low is not None:
            log = log.where(F.col(at) >= F.lit(low))
        if high is not None:
            log = log.where(F.col(at) < F.lit(high))
    return log if most is None else log.orderBy("commit", "tx").limit(most)


def acl_changes(log: DataFrame, lists: DataFrame) -> DataFrame:
    """change_set, aclid, readers, denied: each change set's lists as they stand."""
    return log.select("change_set", "aclid").distinct().join(lists, "aclid").select("change_set", "aclid", "readers", "denied")


def snapshot(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/version={version}")


def restore(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/version={version}")
