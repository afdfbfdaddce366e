"""Queries on typed fields, types, presence, paths, permissions and joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions.text import holds, tokens
from ..operators import access as A
from ..sources.content import access_lists, hierarchy, nodes, table
from .dictionary import part_types
from .registry import ACL, TREE, query

NOW = datetime(2000, 6, 15, 12, 30)


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


_LINE = "SELECT l_orderkey, l_linenumber FROM lineitem WHERE "


@query(_LINE + "l_quantity BETWEEN 10 AND 12")
def numeric_range_incl(spark, sf_dir):
    return _lines(spark, sf_dir).where(X.number_range(F.col("l_quantity"), 10, 12)).select("l_orderkey", "l_linenumber")


@query(_LINE + "l_quantity > 10 AND l_quantity < 12")
def numeric_range_excl(spark, sf_dir):
    return _lines(spark, sf_dir).where(X.number_range(F.col("l_quantity"), 10, 12, (False, False))).select("l_orderkey", "l_linenumber")


@query(_LINE + "l_quantity <= 3")
def open_bound(spark, sf_dir):
    return _lines(spark, sf_dir).where(X.number_range(F.col("l_quantity"), "cheap", 3)).select("l_orderkey", "l_linenumber")


@query(_LINE + "false")
def bad_number_term(spark, sf_dir):
    return _lines(spark, sf_dir).where(X.number_equals(F.col("l_quantity"), "cheap")).select("l_orderkey", "l_linenumber")


_ORDER = "SELECT o_orderkey FROM orders WHERE "


@query(_ORDER + "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def date_year_resolution(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(X.date_equals(F.col("o_orderdate"), "1996", NOW)).select("o_orderkey")


@query(_ORDER + "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-04-01'")
def date_excl_lower(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(X.date_range(F.col("o_orderdate"), "1996", "1998-03", NOW, (False, True))).select("o_orderkey")


@query(_ORDER + "o_orderdate >= TIMESTAMP '2000-05-15' AND o_orderdate < TIMESTAMP '2000-06-16'")
def date_math(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(X.date_range(F.col("o_orderdate"), "NOW/DAY-1MONTH", "TODAY", NOW)).select("o_orderkey")


@query("SELECT o_orderkey, year(o_orderdate)::INT AS year, quarter(o_orderdate)::INT AS quarter, month(o_orderdate)::INT AS month, day(o_orderdate)::INT AS day_of_month, (dayofweek(o_orderdate) + 1)::INT AS day_of_week, dayofyear(o_orderdate)::INT AS day_of_year, hour(o_orderdate)::INT AS hour FROM orders WHERE dayofweek(o_orderdate) + 1 = 2 AND quarter(o_orderdate) = 3")
def date_parts(spark, sf_dir):
    part = lambda n: X.DATE_PARTS[n](F.col("o_orderdate"))
    o = table(spark, sf_dir, "orders").where((part("day_of_week") == 2) & (part("quarter") == 3))
    return o.select("o_orderkey", *[part(n).alias(n) for n in ("year", "quarter", "month", "day_of_month", "day_of_week", "day_of_year", "hour")])


def _presence(spark, sf_dir):
    """Documents with property lists: quality is set where there is a label, and null there for toxic ones."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    set_ = F.col("quality").isNotNull()
    return d.select("doc_id", F.when(set_, F.array(F.lit("lang"), F.lit("quality"))).otherwise(F.array(F.lit("lang"))).alias("properties"), F.when(F.col("toxic") == 1, F.array(F.lit("quality"))).otherwise(F.array().cast("array<string>")).alias("nulls"), (F.col("lang") == "en").alias("declares"))


_LABELLED = "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE "


@query(_LABELLED + "quality IS NOT NULL")
def presence_exists(spark, sf_dir):
    return _presence(spark, sf_dir).where(X.present(F.col("properties"), "quality")).select("doc_id")


@query(_LABELLED + "toxic = 1")
def presence_isnull(spark, sf_dir):
    return _presence(spark, sf_dir).where(X.explicit_null(F.col("nulls"), "quality")).select("doc_id")


@query(_LABELLED + "quality IS NOT NULL AND toxic = 0")
def presence_isnotnull(spark, sf_dir):
    return _presence(spark, sf_dir).where(X.not_null(F.col("properties"), F.col("nulls"), "quality")).select("doc_id")


@query(_LABELLED + "lang = 'en' AND quality IS NULL")
def presence_isunset(spark, sf_dir):
    return _presence(spark, sf_dir).where(X.unset(F.col("declares"), F.col("properties"), "quality")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE p_type IN ('ECONOMY', 'STANDARD')")
def type_closure(spark, sf_dir):
    return table(spark, sf_dir, "part").where(part_types().is_type(F.col("p_type"), "PRICED")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type = 'PROMO'")
def exact_type(spark, sf_dir):
    return table(spark, sf_dir, "part").where(part_types().is_type(F.col("p_type"), "x:promo", exact=True)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'MEDIUM', 'LARGE') OR p_brand = 'Brand#7'")
def aspect_filter(spark, sf_dir):
    d = part_types()
    d.put("Brand#7")
    aspects = F.array("p_type", "p_brand")
    return table(spark, sf_dir, "part").where(d.has_aspect(aspects, "sized") | d.has_aspect(aspects, "Brand#7", exact=True)).select("p_partkey")


def _tree(spark, sf_dir, predicate):
    return hierarchy(spark, sf_dir).where(predicate).select("o_orderkey")


_OF_TREE = TREE + "SELECT o_orderkey FROM h WHERE "


@query(_OF_TREE + "regexp_matches(p, '^/AFRICA/NATION_0/[^/]+/[^/]+$')")
def path_absolute(spark, sf_dir):
    return _tree(spark, sf_dir, X.path(F.col("paths"), "/AFRICA/NATION_0/*/*"))


@query(_OF_TREE + "p LIKE '/ASIA/%'")
def path_descendant(spark, sf_dir):
    return _tree(spark, sf_dir, X.path(F.col("paths"), "/ASIA//*"))


@query(_OF_TREE + "n_name = 'NATION_3' AND p LIKE '%/7%'")
def path_wildcard(spark, sf_dir):
    return _tree(spark, sf_dir, X.path(F.col("paths"), "//NATION_3/*/*") & F.exists("paths", lambda p: p.like("%/7%")))


@query(_OF_TREE + "n_name = 'NATION_5'")
def ancestor(spark, sf_dir):
    h = hierarchy(spark, sf_dir).withColumn("ancestors", F.array("r_name", "n_name", "c_name"))
    return h.where(holds(F.array_contains("ancestors", "NATION_5"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 17")
def parent(spark, sf_dir):
    return table(spark, sf_dir, "orders").where(F.col("o_custkey") == 17).select("o_orderkey")


@query(TREE + "SELECT value, count(*) AS cnt FROM (SELECT unnest(['0/' || r_name, '1/' || r_name || '/' || n_name]) AS value FROM h) GROUP BY 1")
def apath_levels(spark, sf_dir):
    levels = hierarchy(spark, sf_dir).select(F.explode(X.ancestor_paths(F.col("paths"))).alias("value"))
    return levels.where(F.col("value").rlike("^[01]/")).groupBy("value").agg(F.count("*").alias("cnt"))


@query(TREE + "SELECT o_orderkey FROM h WHERE c_name = 'Customer#000000005'")
def aname_suffix(spark, sf_dir):
    names = X.ancestor_names(F.col("paths"))
    return hierarchy(spark, sf_dir).where(F.exists(names, lambda s: s.startswith("1/Customer#000000005/"))).select("o_orderkey")


_PAGES = "SELECT doc_id FROM documents WHERE "


def _sited(spark, sf_dir):
    p = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/sites/team_x0020_"), F.col("source"))).when(F.col("doc_id") % 3 == 1, F.lit("/shared/x")).otherwise("/other")
    return table(spark, sf_dir, "documents").withColumn("sites", X.sites(F.array(p)))


@query(_PAGES + "doc_id % 3 <> 2")
def site_special(spark, sf_dir):
    return _sited(spark, sf_dir).where(X.site(F.col("sites"), "_ALL_SITES_")).select("doc_id")


@query(_PAGES + "doc_id % 3 = 0 AND source = 'src3'")
def site_name(spark, sf_dir):
    return _sited(spark, sf_dir).where(X.site(F.col("sites"), "team src3")).select("doc_id")


@query(_PAGES + "source = 'src4'")
def tag_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(X.tag(F.array("source", "lang"), "SRC4")).select("doc_id")


@query(_PAGES + "doc_id % 5 = 0")
def tenant_filter(spark, sf_dir):
    tenant = F.when(F.col("doc_id") % 5 == 0, "_DEFAULT_").otherwise(F.concat(F.lit("t"), (F.col("doc_id") % 5).cast("string")))
    return table(spark, sf_dir, "documents").where(X.tenant(tenant, "")).select("doc_id")


@query(_PAGES + "doc_id = 42")
def id_with_version(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where(X.versioned_id(F.col("doc_id").cast("string"), F.lit(None).cast("string"), "42;1.0")).select("doc_id")


WITH = "WITH " + ACL


def _auth(spark, sf_dir, authorities, **options):
    return A.readable(nodes(spark, sf_dir), access_lists(spark), authorities, **options).select("dbid")


@query(WITH + "SELECT dbid FROM n WHERE aclid IN (SELECT aclid FROM acl WHERE list_has_any(readers, ['GROUP_R1', 'GROUP_R6']))")
def acl_read(spark, sf_dir):
    return A.readers_of(nodes(spark, sf_dir), access_lists(spark), ["GROUP_R1", "GROUP_R6"]).select("dbid")


@query(WITH + "SELECT dbid FROM n WHERE aclid IN (SELECT aclid FROM acl WHERE list_contains(readers, 'GROUP_R2')) AND aclid NOT IN (SELECT aclid FROM acl WHERE list_contains(denied, 'GROUP_D1'))")
def acl_deny(spark, sf_dir):
    return _auth(spark, sf_dir, ["GROUP_R2", "GROUP_D1"])


@query(WITH + "SELECT dbid FROM n WHERE aclid IN (SELECT aclid FROM acl WHERE list_contains(readers, 'GROUP_R4')) OR owner = 'user3'")
def acl_owner(spark, sf_dir):
    return _auth(spark, sf_dir, ["user3", "GROUP_R4"])


@query(WITH + "SELECT dbid FROM n WHERE aclid IN (SELECT aclid FROM acl WHERE list_contains(readers, 'GROUP_R2'))")
def acl_any_deny_off(spark, sf_dir):
    return _auth(spark, sf_dir, ["GROUP_R2", "GROUP_D1"], any_deny=False)


@query(WITH + "SELECT dbid FROM n")
def acl_global(spark, sf_dir):
    return _auth(spark, sf_dir, ["ROLE_ADMINISTRATOR", "GROUP_D1"])


@query(WITH + "SELECT dbid FROM n WHERE aclid IN (SELECT aclid FROM acl WHERE list_contains(denied, 'GROUP_D1'))")
def acl_denied(spark, sf_dir):
    return A.denied_to(nodes(spark, sf_dir), access_lists(spark), ["GROUP_D1"]).select("dbid")


@query("SELECT d.doc_id AS dbid, l.quality AS q FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 1 AND d.n_chars > 2000")
def cmis_inner_join(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.where("n_chars > 2000").join(labels.where("quality = 1"), "doc_id").select(F.col("doc_id").alias("dbid"), F.col("quality").alias("q"))


@query("SELECT d.doc_id AS dbid, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'de'")
def cmis_left_join(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.where("lang = 'de'").join(labels, "doc_id", "left").select(F.col("doc_id").alias("dbid"), F.col("quality").alias("q"))


@query("SELECT DISTINCT conv_id FROM conversations WHERE role IN ('system', 'tool') OR turn = 5")
def cmis_any_in(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"), F.max((F.col("turn") == 5).cast("int")).alias("five"))  # roles are few
    return c.where(F.arrays_overlap("roles", F.array(F.lit("system"), F.lit("tool"))) | (F.col("five") == 1)).select("conv_id")


@query("SELECT doc_id AS dbid, lang AS locale FROM documents WHERE list_contains(regexp_split_to_array(lower(text), '[^a-z0-9]+'), 'ering') AND lang <> 'de' ORDER BY dbid")
def cmis_contains(spark, sf_dir):
    n = nodes(spark, sf_dir).where(holds(F.array_contains(tokens("text"), "ering")) & (F.col("locale") != "de"))
    return n.select("dbid", "locale").orderBy("dbid")
