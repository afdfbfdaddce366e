"""Further facets and statistics, sources of the tracker, maintenance and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facets as C
from ..operators.projection import restored
from ..sources.content import access_lists, acl_changes, changes, nodes, table, transactions
from ..streaming import tracker as S
from .registry import ACL, query

c = F.col


@query("SELECT source AS value, count(*) AS cnt FROM documents WHERE contains(lower(source), 'rc2') GROUP BY 1 ORDER BY 1 LIMIT 3 OFFSET 1")
def facet_contains(spark, sf_dir):
    """Values that contain a text in any case, in the order of the index, from the second on."""
    return C.field_facet(table(spark, sf_dir, "documents"), c("source"), contains="RC2", ignore_case=True, sort="index", limit=3, offset=1)


@query("SELECT b.k * 10.0::DOUBLE + 5 AS bucket, count(l_quantity) AS cnt FROM range(3) b(k) LEFT JOIN lineitem ON l_quantity > b.k * 10 + 5 AND l_quantity <= b.k * 10 + 15 AND l_quantity <= 30 GROUP BY 1 UNION ALL SELECT 4.0, count(*) FROM lineitem WHERE l_quantity < 5 UNION ALL SELECT 3.0, count(*) FROM lineitem WHERE l_quantity >= 30 UNION ALL SELECT 2.0, count(*) FROM lineitem WHERE l_quantity > 5 AND l_quantity <= 30")
def facet_range_other(spark, sf_dir):
    """Upper bounds inside, a hard end, and what lies before, after and between."""
    return C.range_facet(table(spark, sf_dir, "lineitem"), c("l_quantity"), 5, 30, 10, other=True, upper=True, hardend=True)


@query("SELECT b.m AS bucket, count(o_orderkey) AS cnt FROM (SELECT unnest(generate_series(TIMESTAMP '1994-01-01', TIMESTAMP '1999-11-01', INTERVAL 2 MONTH)) AS m) b LEFT JOIN orders ON o_orderdate >= b.m AND o_orderdate < b.m + INTERVAL 2 MONTH AND o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1")
def facet_range_month(spark, sf_dir):
    """Calendar buckets of two months, the empty ones too."""
    return C.month_facet(table(spark, sf_dir, "orders"), c("o_orderdate"), "1994-01-01", "2000-01-01", 2)


@query("SELECT o_orderstatus, NULL AS o_orderpriority, count(*) AS cnt, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 6) AS mean, 1 AS level FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, o_orderpriority, count(*), min(o_totalprice), max(o_totalprice), round(avg(o_totalprice), 6), 2 FROM orders GROUP BY 1, 2")
def pivot_stats(spark, sf_dir):
    return C.pivot_stats(table(spark, sf_dir, "orders"), c("o_totalprice"), "o_orderstatus", "o_orderpriority")


@query("SELECT l_returnflag, l_linestatus, floor(l_quantity / 20) * 20.0 AS bucket, count(*) AS cnt FROM lineitem GROUP BY 1, 2, 3")
def pivot_ranges(spark, sf_dir):
    return C.pivot_ranges(table(spark, sf_dir, "lineitem"), c("l_quantity"), 0, 20, "l_returnflag", "l_linestatus")


@query("SELECT count(DISTINCT l_quantity) AS count_distinct, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.999) AS p99_9 FROM lineitem")
def stats_percentiles(spark, sf_dir):
    return C.value_stats(table(spark, sf_dir, "lineitem"), c("l_quantity"), [0.25, 0.5, 0.999])


@query("SELECT count(DISTINCT o_orderpriority) AS count_distinct, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS distinct_values FROM orders")
def stats_distinct(spark, sf_dir):
    return C.value_stats(table(spark, sf_dir, "orders"), c("o_orderpriority"))


@query("SELECT 'cm:creator' AS field, source AS value, count(*) AS cnt FROM documents GROUP BY 2 UNION ALL SELECT 'sys:locale', lang, count(*) FROM documents GROUP BY 2")
def facet_names(spark, sf_dir):
    """Counts of several fields under the names of the request."""
    d = table(spark, sf_dir, "documents")
    both = [C.field_facet(d, c(x)).select(F.lit(x).alias("field"), "value", "cnt") for x in ("source", "lang")]
    return restored(both[0].unionAll(both[1]), {"source": "cm:creator", "lang": "sys:locale"})


@query("SELECT min(user_id) AS first_node, max(user_id) AS last_node, count(DISTINCT user_id) AS nodes, max(event_id) AS last_tx, arg_max(ts, event_id) AS last_commit FROM events")
def id_range(spark, sf_dir):
    log = changes(spark, sf_dir)
    return log.agg(F.min("dbid").alias("first_node"), F.max("dbid").alias("last_node"), F.count_distinct("dbid").alias("nodes"), F.max("tx").alias("last_tx"), F.max_by("commit", "tx").alias("last_commit"))


@query("SELECT event_id AS tx FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' AND event_id >= 20 ORDER BY ts, event_id LIMIT 50")
def transactions_window(spark, sf_dir):
    """One fetch of the tracker: from a time to a time, from an id on, at most so many."""
    from datetime import datetime

    return transactions(changes(spark, sf_dir), datetime(2024, 1, 3), datetime(2024, 1, 20), first=20, most=50).select("tx")


@query("WITH " + ACL + "SELECT DISTINCT user_id % 10 AS change_set, aclid, CASE WHEN readers[1] = readers[2] THEN [readers[1]] ELSE readers END AS readers, denied FROM events JOIN acl ON aclid = user_id % 16 WHERE event_type = 'signup'")
def acl_change_sets(spark, sf_dir):
    """Lists of each change set with their readers and denied authorities."""
    log = changes(spark, sf_dir).where("event_type = 'signup'").select((c("dbid") % 10).alias("change_set"), (c("dbid") % 16).alias("aclid"))
    return acl_changes(log, access_lists(spark))


@query("SELECT doc_id AS dbid, CASE WHEN want IS NULL THEN 'New' WHEN want > coalesce(have, -1) AND n_chars < 200 THEN 'Irrecoverable' ELSE 'Clean' END AS status FROM documents LEFT JOIN (SELECT user_id, max(event_id) FILTER (event_type = 'click') AS want, max(event_id) FILTER (event_type = 'purchase') AS have FROM events GROUP BY 1) m ON doc_id = user_id")
def content_states(spark, sf_dir):
    """Clicks ask for content, purchases say what is held; texts below 200 characters count as gone."""
    at = lambda kind: F.max(F.when(c("event_type") == kind, c("tx")))
    markers = changes(spark, sf_dir).groupBy("dbid").agg(at("click").alias("wanted"), at("purchase").alias("held"))
    n = nodes(spark, sf_dir).select("dbid", F.when(c("size") >= 200, c("text")).alias("text"))
    return S.content_states(n, markers)


@query("SELECT h.c_nationkey AS node, max(t) AS tx FROM (SELECT DISTINCT c_nationkey, c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) h JOIN (VALUES ('ASIA', 60), ('EUROPE', 40), ('ASIA', 20)) m(name, t) ON h.r_name = m.name WHERE h.c_custkey < m.t GROUP BY 1")
def cascade_by_age(spark, sf_dir):
    """Only descendants that are older than the move are written again; the newest move counts."""
    k, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    tree = k.join(n, c("c_nationkey") == c("n_nationkey")).join(r, c("n_regionkey") == c("r_regionkey")).select(c("c_nationkey").alias("node"), c("c_custkey").alias("tx"), F.array("r_name").alias("ancestors"))
    moved = spark.createDataFrame([("ASIA", 60), ("EUROPE", 40), ("ASIA", 20)], "ancestor string, moved_tx int")
    return S.cascade(tree, moved)


@query("SELECT CASE WHEN a.name IS NULL THEN b.name ELSE a.name END AS name, CASE WHEN a.name IS NULL THEN 'new' WHEN b.name IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT n_name AS name, n_regionkey AS x FROM nation WHERE n_nationkey < 20) a FULL JOIN (SELECT n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN -1 ELSE n_regionkey END AS x FROM nation WHERE n_nationkey >= 5) b USING (name) WHERE a.x IS DISTINCT FROM b.x")
def models_diff(spark, sf_dir):
    """Models that are new, changed or gone."""
    n = table(spark, sf_dir, "nation")
    held = n.where("n_nationkey < 20").select(c("n_name").alias("name"), c("n_regionkey").alias("checksum"))
    given = n.where("n_nationkey >= 5").select(c("n_name").alias("name"), F.when(c("n_nationkey") % 4 == 0, -1).otherwise(c("n_regionkey")).alias("checksum"))
    return S.model_changes(held, given)


@query("SELECT s_suppkey, s_name FROM supplier WHERE NOT (s_suppkey IN (1, 4) OR s_nationkey IN (2, 3))")
def maintenance_purge(spark, sf_dir):
    """Nodes and lists purged by number."""
    return S.purge(table(spark, sf_dir, "supplier"), s_suppkey=[1, 4], s_nationkey=[2, 3]).select("s_suppkey", "s_name")


@query("SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN s_acctbal ELSE 0 END AS s_acctbal FROM supplier WHERE NOT (s_nationkey < 12 AND s_suppkey % 3 = 0)")
def maintenance_reindex(spark, sf_dir):
    """What a query selects is taken from the source again; what the source lost is gone."""
    source = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select("s_suppkey", "s_nationkey", "s_acctbal")
    now = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", F.lit(0.0).alias("s_acctbal"))
    return S.reindex(now, source, "s_suppkey", c("s_nationkey") < 12).select("s_suppkey", "s_acctbal")


@query("WITH k AS (SELECT user_id AS dbid, CASE WHEN user_id % 11 = 0 THEN NULL ELSE max(event_id) END AS want FROM events GROUP BY 1), h AS (SELECT user_id + 5 AS dbid, max(event_id) + 300 AS have, CASE (user_id + 5) % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'unindexed' ELSE 'node' END AS kind FROM events GROUP BY 1) SELECT coalesce(k.dbid, h.dbid) AS dbid, CASE WHEN kind = 'error' THEN 'ERROR' WHEN k.dbid IS NULL THEN 'ORPHAN' WHEN kind IS NULL THEN 'ABSENT' WHEN kind = 'unindexed' THEN 'UNINDEXED' WHEN want IS NULL THEN 'UNVERIFIED' WHEN have < want THEN 'STALE' ELSE 'INDEXED' END AS verdict FROM k FULL JOIN h ON k.dbid = h.dbid")
def verdict_kinds(spark, sf_dir):
    """All seven verdicts."""
    log = changes(spark, sf_dir).groupBy("dbid").agg(F.max("tx").alias("tx"))
    known = log.select("dbid", F.when(c("dbid") % 11 != 0, c("tx")).alias("tx"))
    held = log.select((c("dbid") + 5).alias("dbid"), (c("tx") + 300).alias("tx"))
    kind = F.when(c("dbid") % 7 == 0, "error").when(c("dbid") % 7 == 1, "unindexed").otherwise("node")
    return S.verdicts(known, held.withColumn("kind", kind))


@query("WITH v AS (SELECT user_id AS dbid, CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 3 ELSE 7 END AS r FROM events) SELECT dbid, CASE min(r) WHEN 1 THEN 'ERROR' WHEN 3 THEN 'STALE' ELSE 'INDEXED' END AS verdict FROM v GROUP BY 1")
def verdict_worst(spark, sf_dir):
    """The worst of a node's verdicts."""
    judged = changes(spark, sf_dir).select("dbid", F.when(c("event_type") == "error", "ERROR").when(c("event_type") == "view", "STALE").otherwise("INDEXED").alias("verdict"))
    return S.worst(judged)


@query("SELECT max(event_id) AS last_tx, -1::BIGINT AS remaining FROM events")
def consistency_unknown(spark, sf_dir):
    """What remains is -1 where the repository does not say how far it is."""
    return S.consistency(changes(spark, sf_dir), None).select("last_tx", "remaining")
