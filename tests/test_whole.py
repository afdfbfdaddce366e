"""Whole jobs on tables that are larger than the small test tables, or of another shape."""

from __future__ import annotations

import math
import os
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sundew.functions import analysis, fields, text
from sundew.operators import facets, projection, ranking
from sundew.plans import catalog, dictionary, registry
from sundew.sources import content
from sundew.sources.content import changes
from sundew.streaming import tracker


def test_reconcile_sees_documents_from_600_on(spark, tmp_path):
    spark.createDataFrame([(i, int(u), "view", 1.0) for i, u in enumerate((50, 150, 600, 5000))], "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp'2024-01-01' AS ts").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(1200).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.dbid: r.state for r in catalog.queries()["reconcile"](spark, str(tmp_path)).collect()}
    assert got == {i: "missing" for i in range(1200) if i not in (550, 650, 1100)} | {5500: "extra"}


def test_rerank_places_more_than_a_million_rows(spark):
    n = 1_000_500
    scored = spark.range(n, numPartitions=4).selectExpr("id AS k", "double(id % 1000) AS score")
    second = spark.createDataFrame([(999, 5.0)], "k long, score double")
    made = ranking.rerank(scored, second, "k", docs=3, elevated=[7])
    got = made.selectExpr("count(*) AS n", "count(DISTINCT place) AS places", "max(place) AS last").first()
    assert tuple(got) == (n, n, n)
    assert [r.k for r in made.where("place <= 5").orderBy("place").collect()] == [7, 999, 1999, 2999, 3999]


def test_sorts_place_every_row(spark, tmp_path):
    spark.range(1500).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(1000, 1500).selectExpr("id AS doc_id", "(1499 - id) DIV 100 AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    spark.range(300).selectExpr("id AS o_orderkey", "string(id % 3) AS o_orderpriority", "double(id % 7) AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    nulls = {r.doc_id: r.place for r in catalog.queries()["sort_nulls"](spark, str(tmp_path)).collect()}
    assert nulls == {i: n for n, i in enumerate([*range(1000), *sorted(range(1000, 1500), key=lambda i: ((1499 - i) // 100, i))], 1)}
    multi = {r.o_orderkey: r.place for r in catalog.queries()["sort_multi"](spark, str(tmp_path)).collect()}
    assert multi == {i: n for n, i in enumerate(sorted(range(300), key=lambda i: (str(i % 3), -(i % 7), i)), 1)}


def test_stream_takes_files_in_any_order(spark, tmp_path):
    day = datetime(2024, 1, 1)
    parts = [[(100 * f + i, day + timedelta(days=f, minutes=i), i + 15 * f, "error" if (i + f) % 6 == 0 else "view", float(f)) for i in range(20)] for f in range(12)]
    parts[0].append(parts[3][4])  # a transaction again
    for place, f in enumerate((11, 2, 8, 1, 9, 10, 4, 6, 0, 3, 5, 7)):
        spark.createDataFrame(parts[f], "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/made{f}")
        (made,) = Path(f"{tmp_path}/made{f}").glob("*.parquet")
        (tmp_path / "events.parquet").mkdir(exist_ok=True)
        made.rename(tmp_path / "events.parquet" / f"part{f}.parquet")
        os.utime(tmp_path / "events.parquet" / f"part{f}.parquet", (1_700_000_000 + 60 * place,) * 2)
    got = sorted(tuple(r) for r in catalog.queries()["track_stream"](spark, str(tmp_path)).collect())
    assert got == sorted(tuple(r) for r in catalog.queries()["track_upsert"](spark, str(tmp_path)).collect())
    newest = {}
    for e in sorted((e for p in parts for e in p), key=lambda e: (e[1], e[0])):
        newest[e[2]] = e
    assert got == sorted((k, e[0], e[4]) for k, e in newest.items() if e[3] != "error")


def test_size_buckets_are_filled_by_rows(spark):
    sizes = [(v,) for v in [5] * 3000 + list(range(100, 7100))] + [(None,)]
    made = facets.size_histogram(spark.createDataFrame(sizes, "n long"), F.col("n"))
    got = {r.bucket: (r.low, r.high, r.cnt) for r in made.collect()}
    assert got == {1: (5, 5, 3000)} | {b: (100 + 1000 * (b - 4), 1099 + 1000 * (b - 4), 1000) for b in range(4, 11)}


def test_names_of_queries_are_refused_twice():
    assert {"progress_slope", "progress_rate"} <= set(catalog.oracle_sql())
    with pytest.raises(ValueError, match="progress_rate"):
        registry.query("SELECT 1")(catalog.queries()["progress_rate"])


def _log(spark, folder, name, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def test_tracker_goes_on_after_a_restart_and_a_failed_batch(spark, tmp_path, monkeypatch):
    day, src, folder = datetime(2024, 1, 1), str(tmp_path / "src"), str(tmp_path / "state")
    rows = lambda n, at, kind: [(at * 1000 + i, day + timedelta(days=at, minutes=i), i, kind, float(at)) for i in range(*n)]
    current = lambda: sorted(tuple(r) for r in tracker.current(changes(spark, src)).select("dbid", "tx", "value").collect())
    found = lambda made: sorted(tuple(r) for r in made.where("what = 'update'").select("dbid", "tx", "value").collect())
    _log(spark, src, "a", rows((0, 150), 1, "view"))
    assert len(found(tracker.follow(tracker.log_stream(spark, src), folder))) == 150
    _log(spark, src, "b", rows((140, 160), 2, "click") + rows((0, 5), 3, "error"))
    # The next batch writes its nodes and dies before its marker.
    real = tracker.latest

    def torn(*args):
        made = real(*args)
        made.withColumn("bucket", F.lit(0)).limit(3).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/nodes/version=1")
        raise RuntimeError("lost")

    monkeypatch.setattr(tracker, "latest", torn)
    with pytest.raises(Exception, match="lost"):
        tracker.follow(tracker.log_stream(spark, src), folder)
    monkeypatch.setattr(tracker, "latest", real)
    assert len(found(tracker.current_table(spark, folder, tracker.log_stream(spark, src).schema))) == 150
    assert found(tracker.follow(tracker.log_stream(spark, src), folder)) == current()
    assert found(tracker.follow(tracker.log_stream(spark, src), folder)) == current()  # nothing new


def test_phrases_keep_their_order_below_a_slop_of_two(spark):
    df = spark.createDataFrame([("The quick brown fox jumped",), ("fox then some more words quick",), ("a b a",)], "text string").withColumn("t", text.tokens("text"))
    hits = lambda words, slop: [r.text[:3] for r in df.where(text.phrase(F.col("t"), words, slop)).collect()]
    assert hits(["quick", "fox"], 0) == [] and hits(["quick", "fox"], 1) == ["The"] and hits(["fox", "quick"], 1) == []
    assert hits(["fox", "quick"], 2) == ["The"] and hits(["fox", "quick"], 4) == ["The", "fox"]
    assert hits(["a", "a"], 0) == [] and hits(["a", "a"], 1) == ["a b"] and hits(["b", "b"], 3) == []
    assert hits(["quick", "brown", "jumped"], 1) == ["The"] and hits(["quick", "jumped", "fox"], 1) == []


def test_analysis(spark):
    df = spark.createDataFrame([("The Foxes' PowerShot500 \u00c9t\u00e9 \u65e5\u672c", "en_US"), ("die H\u00e4user und der", "de"), ("plain the", "xx")], "text string, locale string")
    got = [r[0] for r in df.select(analysis.analyzed("text", F.col("locale"))).collect()]
    assert got == [["fox", "powershot500", "\u00e9t\u00e9", "\u65e5\u672c"], ["h\u00e4us"], ["plain", "the"]]
    assert df.select(analysis.word_parts("text")).first()[0] == ["the", "foxes", "power", "shot", "500", "\u00e9t\u00e9", "\u65e5\u672c"]
    assert analysis.query_locales("de_CH", "LOCALE_AND_ALL") == ["de_CH", "de", ""]


def test_refused_queries(spark):
    one = spark.createDataFrame([(1, "a", "x:1"), (2, "b", "x:2"), (2, "c", "x:3")], "dbid long, text string, reference string")
    with pytest.raises(ValueError, match="advanced joins"):
        projection.one_selector(one, one)
    assert projection.one_selector(one) is one
    with pytest.raises(NotImplementedError):
        fields.over_all([F.col("text")], "term", lambda h: h)
    with pytest.raises(ValueError, match="several"):
        ranking.one_node(one, "dbid", "2")
    with pytest.raises(ValueError, match="no node"):
        ranking.one_node(one, "dbid", "x:9")
    assert ranking.one_node(one, "dbid", "x:3").count() == 1
    d = dictionary.part_types()
    d.properties["tags"] = dictionary.Property("tags", multiple=True)
    with pytest.raises(ValueError, match="sorted"):
        d.sort_column("tags")


def test_dictionary_of_models():
    d = dictionary.from_json(['{"types": [{"name": "b", "parent": "a"}, {"name": "x", "parent": "nowhere"}]}', '{"types": [{"name": "a"}, {"name": "c", "parent": "b", "included": false}]}'])
    assert d.names() == ["a", "b", "c"] and d.closure("a") == ["a", "b"] and d.get("c") == {"name": "c", "parent": "b", "included": False}
    assert d.errors == ["x: unknown parent nowhere"] and d.get("none") == {}
    with pytest.raises(ValueError, match="subtypes"):
        d.remove("b")
    d.remove("c")
    assert d.names() == ["a", "b"]


def test_merge_clears_named_fields_only(spark):
    now = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k long, x string, y string")
    more = spark.createDataFrame([(1, None, None), (3, "n", None)], "k long, x string, y string")
    got = lambda **o: sorted(tuple(r) for r in content.merge_fields(now, more, "k", **o).collect())
    assert got() == [(1, "a", "b"), (2, "c", "d"), (3, "n", None)]
    assert got(clear=("y",)) == [(1, "a", None), (2, "c", "d"), (3, "n", None)]


def test_query_log_and_snapshots(spark, tmp_path):
    for i in range(2):
        tracker.log_query(spark, f"{tmp_path}/qlog", "ann", "cm:name:a", "NAME:a", i, datetime(2024, 1, 1 + i))
    assert sorted(r.hits for r in spark.read.parquet(f"{tmp_path}/qlog").collect()) == [0, 1]
    df = spark.range(3)
    content.snapshot(df, f"{tmp_path}/s", 1)
    content.snapshot(df.limit(1), f"{tmp_path}/s", 2)
    assert [content.restore(spark, f"{tmp_path}/s", v).count() for v in (1, 2)] == [3, 1]


def test_collated_order(spark):
    rows = [("z",), ("\u00e5",), (None,), ("a",), ("B",)]
    df = spark.createDataFrame(rows, "n string")
    assert [r.n for r in df.orderBy(ranking.collated(F.col("n"), "sv")).collect()] == [None, "a", "B", "z", "\u00e5"]
    assert [r.n for r in df.orderBy(ranking.collated(F.col("n"), "fr").desc()).collect()] == ["z", "B", "\u00e5", "a", None]


def test_cascade_reaches_orders_of_any_key(spark, tmp_path):
    spark.createDataFrame([(0, "R")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(1, "NATION_1", 0), (3, "NATION_3", 0)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, "a", 1), (2, "b", 3)], "c_custkey long, c_name string, c_nationkey long").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(5, 1), (899_999, 1), (900_000, 1), (7_000_000, 1), (8_000_000, 2)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in catalog.queries()["cascade"](spark, str(tmp_path)).collect())
    assert got == [(k, 900_000) for k in (5, 899_999, 900_000, 7_000_000)]


def test_cascade_leaves_newer_nodes(spark):
    tree = spark.createDataFrame([(1, 5, ["a"]), (2, 30, ["a", "b"]), (3, 30, ["a"])], "node long, tx long, ancestors array<string>")
    moved = spark.createDataFrame([("a", 20), ("b", 40)], "ancestor string, moved_tx long")
    assert sorted(tuple(r) for r in tracker.cascade(tree, moved).collect()) == [(1, 20), (2, 40)]


def test_fingerprints_hash_every_shingle_once(spark):
    """Minima over shingles of a long text, repeats and parts included, and without lambdas, which Spark interprets for each shingle."""
    from hashlib import md5

    long = [f"w{i % 9001}" for i in range(10_000)]
    rows = [(1, long), (2, ["a", "b", "c", "d"]), (3, ["a", "b", "c", "d", "e"]), (4, None), (5, []), (6, ["x"] * 9)]
    made = ranking.fingerprints(spark.createDataFrame(rows, "k long, t array<string>"), "k", F.col("t"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan

    def want(words):
        h = [int(md5(" ".join(words[i : i + 5]).encode()).hexdigest()[:15], 16) % ranking.P for i in range(len(words) - 4)]
        return [min((x * a + b) % ranking.P for x in h) for a, b in map(ranking.coefficients, range(ranking.FUNCTIONS))]

    assert {r.k: list(r.signature) for r in made.collect()} == {k: want(t) for k, t in rows if k in (1, 3, 6)}


def test_more_like_shuffles_only_shared_terms(spark):
    """Other nodes' terms stay where they are; rows of one key count as one node."""
    rows = [(1, ["a", "a", "b"]), (1, ["c"]), (2, ["a", "x", "x"]), (2, ["a", "c"]), (3, ["b", "y"]), (4, ["z"]), (None, ["a"])]
    df = spark.createDataFrame(rows, "k long, t array<string>")
    made = ranking.more_like(df, "k", F.col("t"), 1)
    w = {"a": 2 * math.log(1 + 7 / 3), "b": math.log(1 + 7 / 2), "c": math.log(1 + 7 / 2)}
    assert [(r.k, r.score) for r in made.collect()] == [(2, round(w["a"] + w["c"], 6)), (3, round(w["b"], 6))]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 2 and "Aggregate [k" not in plan.split("LeftSemi")[-1].split("Generate")[0]


def test_word_contexts_shuffle_lists_and_miss_none(spark, monkeypatch):
    from collections import defaultdict

    texts = ["a b a b a", "", None, "?!", "B", "a \u00e9b a", "x a y", *[f"w{i % 50} the v{i}" for i in range(700)], *["same text again"] * 300]
    want = defaultdict(set)
    for t in texts:
        found = "".join(x if x.isascii() and x.isalnum() else " " for x in (t or "").lower()).split()
        for before, word, after in zip(["", *found], found, [*found[1:], ""], strict=False):
            want[word].add((before, after))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups go on from batch to batch
    try:
        made = ranking.word_contexts(rows, F.col("text"))
        assert {r.term: r.contexts for r in made.collect()} == {t: len(c) for t, c in want.items()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan and "contexts#" in plan
