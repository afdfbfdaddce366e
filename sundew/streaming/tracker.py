"""Change tracking: a log of transactions keeps tables in step, in batch form and with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.places import shared_root
from ..sources.content import changes, latest, table


def due(log: DataFrame, now: Column, lag_seconds: int = 1) -> DataFrame:
    """Transactions that are old enough; later ones are read again in the next cycle."""
    return log.where(F.col("commit") <= now - F.expr(f"INTERVAL {lag_seconds} SECONDS"))


def holes(log: DataFrame, indexed: DataFrame, last: Column, hours: int = 1) -> DataFrame:
    """Transactions of the last hours before ``last`` that are not indexed yet."""
    recent = log.where((F.col("commit") >= last - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("commit") <= last))
    return recent.join(indexed.select("tx"), "tx", "left_anti")


def current(log: DataFrame) -> DataFrame:
    """The nodes after all transactions: the newest update of each; nodes whose newest change deletes them are gone."""
    return latest(log, "dbid", F.desc("commit"), F.desc("tx")).where("what = 'update'")


def routes(log: DataFrame) -> DataFrame:
    """Adds route: node, unindexed or error, by what a change is."""
    route = F.when(F.col("what") == "delete", "error").when(F.col("event_type") == "view", "unindexed").otherwise("node")
    return log.withColumn("route", route)


def cascade(tree: DataFrame, moved: DataFrame) -> DataFrame:
    """Descendants (node, ancestors, tx) of moved nodes (ancestor, moved_tx) that are older than the move; all descendants where
    the tree has no ``tx``."""
    older = F.col("tx") < F.col("moved_tx") if "tx" in tree.columns else F.lit(True)
    each = tree.select("*", F.explode("ancestors").alias("ancestor"))
    return each.join(moved, "ancestor").where(older).groupBy("node").agg(F.max("moved_tx").alias("tx"))


#: Verdicts on a node, the worst first.
VERDICTS = ("ERROR", "ABSENT", "STALE", "ORPHAN", "UNINDEXED", "UNVERIFIED", "INDEXED")


def verdicts(known: DataFrame, held: DataFrame) -> DataFrame:
    """dbid, verdict of nodes of the repository (dbid, tx) and of the index (dbid, tx; kind: node, error or unindexed, node
    where the column is absent). A node that the repository could not be asked for (tx null) is UNVERIFIED."""
    kind = F.col("kind") if "kind" in held.columns else F.lit("node")
    both = known.select("dbid", F.lit(True).alias("is_known"), F.col("tx").alias("want")).join(held.select("dbid", kind.alias("kind"), F.col("tx").alias("have")), "dbid", "full")
    verdict = F.when(F.col("kind") == "error", "ERROR").when(F.col("is_known").isNull(), "ORPHAN").when(F.col("kind").isNull(), "ABSENT").when(F.col("kind") == "unindexed", "UNINDEXED")
    verdict = verdict.when(F.col("want").isNull(), "UNVERIFIED").when(F.col("have") < F.col("want"), "STALE").otherwise("INDEXED")
    return both.select("dbid", verdict.alias("verdict"))


def worst(judged: DataFrame) -> DataFrame:
    """dbid, verdict: the worst of a node's verdicts over all cores."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col("verdict"))
    return judged.groupBy("dbid").agg(F.min_by("verdict", rank).alias("verdict"))


def purge(now: DataFrame, **of: list) -> DataFrame:
    """The table without the rows that have one of the given values: ``purge(nodes, tx=[4, 9])``, ``purge(nodes, aclid=[3])``."""
    for column, values in of.items():
        now = now.where(~F.coalesce(F.col(column).isin(*values), F.lit(False)))
    return now


def reindex(now: DataFrame, source: DataFrame, key: str, which: Column) -> DataFrame:
    """The table with the rows that ``which`` selects taken from the source again; rows that the source lacks are gone."""
    hit = F.coalesce(which, F.lit(False))
    return now.where(~hit).unionByName(source.where(hit).join(now.where(~hit).select(key), key, "left_anti"))


def model_changes(held: DataFrame, given: DataFrame) -> DataFrame:
    """name, change (new, changed, removed) of models (name, checksum); they are loaded before nodes."""
    both = held.select("name", F.col("checksum").alias("a")).join(given.select("name", F.col("checksum").alias("b")), "name", "full")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select("name", change.alias("change")).where("change is not null")


def content_states(nodes: DataFrame, markers: DataFrame) -> DataFrame:
    """dbid, status: nodes (dbid, text) whose marker (dbid, wanted, held) is outdated are Clean once their text is read, without
    a text Irrecoverable; others keep Clean, and nodes without a marker are New."""
    both = nodes.select("dbid", "text").join(markers, "dbid", "left")
    status = F.when(F.col("wanted").isNull(), "New").when((F.coalesce("held", F.lit(-1)) < F.col("wanted")) & F.col("text").isNull(), "Irrecoverable").otherwise("Clean")
    return both.select("dbid", status.alias("status"))


def consistency(log: DataFrame, server_tx: int | None) -> DataFrame:
    """last_tx, last_time, and remaining: what the repository is ahead by, 0 at least, -1 where it does not say."""
    ahead = F.lit(-1).cast("long") if server_tx is None else F.greatest(F.lit(0).cast("long"), F.lit(server_tx).cast("long") - F.max("tx"))
    return log.agg(F.max("tx").alias("last_tx"), F.max("commit").alias("last_time"), ahead.alias("remaining"))


def log_query(spark: SparkSession, folder: str, user: str, query: str, parsed: str, hits: int, at) -> None:
    """Appends one line to the query log."""
    row = spark.createDataFrame([(user, query, parsed, hits, at)], "user string, query string, parsed string, hits long, at timestamp")
    row.coalesce(1).write.mode("append").parquet(folder)


def repair(errors: DataFrame, tries: int = 10) -> DataFrame:
    """dbid, attempts, outcome of failed nodes: retried until a later change succeeds, given up after ``tries``."""
    outcome = F.when(F.col("fixed"), "repaired").when(F.col("attempts") >= tries, "failed").otherwise("retry")
    return errors.select("dbid", "attempts", outcome.alias("outcome"))


def progress(samples: DataFrame, key: str, band: float = 0.1) -> DataFrame:
    """key, rate, eta, trend from samples (key, at in seconds, done, remaining): the least-squares slope of ``done``, the
    seconds left at this rate, and whether the newer half of the samples is faster than the older one by more than
    ``band``. A falling or unknown count gives nulls, as does a half with fewer than two samples for the trend.

    Samples are the readings of one counter, so a key has few; a count over events comes before.
    """
    own = Window.partitionBy(key)
    place, n = F.row_number().over(own.orderBy("at")), F.count("*").over(own)
    halves = samples.withColumn("__old", place <= F.floor(n / 2))
    x, y = F.col("at").cast("double"), F.col("done").cast("double")

    def slope(which: Column) -> Column:
        """Null where there are fewer than two samples or any has no count."""
        fine = (F.count_if(which) >= 2) & (F.count_if(which & y.isNull()) == 0)
        return F.when(fine, F.regr_slope(F.when(which, y), F.when(which, x)))

    found = halves.groupBy(key).agg(slope(F.lit(True)).alias("rate"), slope(F.col("__old")).alias("older"), slope(~F.col("__old")).alias("newer"), F.max_by("remaining", "at").alias("remaining"))
    known = F.col("rate") >= 0
    eta = F.when(F.col("remaining") <= 0, F.lit(0)).when(F.col("rate") > 0, F.ceil(F.col("remaining") / F.col("rate"))).cast("long")
    trend = F.when(F.col("newer") > F.col("older") * (1 + band), "RISING").when(F.col("newer") < F.col("older") * (1 - band), "FALLING").otherwise("STEADY")
    fair = known & (F.col("older") >= 0) & (F.col("newer") >= 0)
    return found.select(key, F.when(known, F.col("rate")).alias("rate"), F.when(known, eta).alias("eta"), F.when(fair, trend).alias("trend"))


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as a stream over the files of ``events``; new files are new transactions."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parque[t]")
    return e.select(F.col("event_id").alias("tx"), F.col("ts").cast("timestamp").alias("commit"), F.col("user_id").alias("dbid"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("what"), "event_type", "value")


#: Parts of the table of nodes; a batch writes those anew that it touches.
BUCKETS = 64


def _manifest(spark: SparkSession, folder: str, below: int) -> DataFrame | None:
    """bucket, version: the last complete version of each bucket that batches before ``below`` left."""
    try:
        done = spark.read.schema("bucket int, version long").parquet(f"{folder}/done").where(F.col("version") < below)
    except AnalysisException:  # nothing is complete yet
        return None
    return done.groupBy("bucket").agg(F.max("version").alias("version"))  # BUCKETS rows


def current_table(spark: SparkSession, folder: str, schema, below: int = 1 << 62) -> DataFrame:
    """The table as its complete versions leave it; what a failed batch wrote is not read."""
    manifest = _manifest(spark, folder, below)
    if manifest is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, *_parse("bucket int, version long").fields])).parquet(f"{folder}/nodes")
    return rows.join(F.broadcast(manifest), ["bucket", "version"], "left_semi").select(*schema.names)


def _parse(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def follow(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the tracker until the log is used up; returns the newest change of each node. Transactions may come in any order
    and again, as the newest change wins.

    A batch writes the buckets that it touches as a version of its own number, and then its marker. A batch that failed, or
    that runs again after a restart, starts from the versions before it and writes over what it left, so it changes nothing
    twice, and a run that goes on in the same folder finds the table of the last one.
    """
    spark, schema = stream.sparkSession, stream.schema
    bucket = F.pmod(F.xxhash64("dbid"), F.lit(BUCKETS)).cast("int")

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        touched = [r[0] for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # BUCKETS at most
        if touched:
            old = current_table(spark, folder, schema, number).where(bucket.isin(*touched))
            newest = latest(batch.unionByName(old), "dbid", F.desc("commit"), F.desc("tx")).withColumn("bucket", bucket)
            newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/nodes/version={number}")
            spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/version={number}")
        batch.unpersist()

    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start()
    query.awaitTermination()
    return current_table(spark, folder, schema)


def working_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/tracker-{uuid.uuid4().hex}"


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that the stream leaves."""
    return follow(log_stream(spark, sf_dir), working_folder(spark)).where("what = 'update'").select("dbid", "tx", "value")
