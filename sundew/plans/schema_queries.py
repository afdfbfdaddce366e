"""Projection, names of the model, and predicates that the model or the tree defines."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from ..functions import analysis as A
from ..functions import fields as X
from ..functions.text import any_of, complement, first_token_range, holds, prefix, term, tokens
from ..operators import projection as P
from ..operators.access import of_tenants
from ..sources.content import changes, hierarchy, nodes, table, unique_values
from .dictionary import part_types
from .registry import TREE, query

c = F.col


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT 'doc' || doc_id AS id, doc_id AS dbid FROM documents")
def select_default(spark, sf_dir):
    """Without a field map only ids come back, whatever was asked for."""
    n = nodes(spark, sf_dir).withColumn("id", F.concat(F.lit("doc"), c("dbid").cast("string")))
    return P.default_fields(n, ["id", "DBID", "text", "owner"])


@query('SELECT p_name AS name, p_retailprice AS price FROM part')
def select_mapped(spark, sf_dir):
    return P.mapped_fields(_parts(spark, sf_dir), part_types(), ["name", "price", "unknown"])


@query('SELECT p_name AS name, p_brand AS brand, p_size AS size, p_retailprice AS price FROM part')
def select_all_mapped(spark, sf_dir):
    return P.mapped_fields(_parts(spark, sf_dir), part_types(), ["*"])


@query('SELECT p_brand AS brand, p_name AS name, p_size AS size, p_retailprice AS price FROM part')
def select_doc_values(spark, sf_dir):
    """Properties that keep column values: numbers, and text with an untokenised form."""
    return P.mapped_fields(_parts(spark, sf_dir), part_types(), ["*"], values_only=True)


@query("SELECT p_partkey, p_name AS cm_name, CASE WHEN p_brand = p_type THEN [p_brand] ELSE [p_brand, p_type] END AS \"cm:tags\", [p_type] AS titles FROM part")
def rename_dedup(spark, sf_dir):
    """Underscores for colons in single values, sets for lists, texts without their locale's marker."""
    marked = F.concat(F.lit("\x00en\x00"), c("p_name"))
    df = _parts(spark, sf_dir).select("p_partkey", marked.alias("cm:name"), F.array("p_brand", "p_type", "p_brand").alias("cm:tags"), F.create_map(F.lit("en"), c("p_type"), F.lit("de"), c("p_type")).alias("titles"))
    return P.response(df)


@query("SELECT * FROM (VALUES ('p_name', 'name'), ('p_retailprice', 'price'), ('p_name__size', 'name.size'), ('other', NULL)) t(field, property)")
def field_names(spark, sf_dir):
    """Fields of the schema under the names of the model."""
    d = part_types()
    return spark.createDataFrame([(f, d.model_name(f)) for f in ("p_name", "p_retailprice", "p_name__size", "other")], "field string, property string")


@query("SELECT p_partkey AS id, upper(p_name) AS title FROM part WHERE upper(p_name) LIKE 'RED%'")
def cmis_alias_where(spark, sf_dir):
    """Aliases of the select list hold in the condition, so the list is projected first."""
    return _parts(spark, sf_dir).select(c("p_partkey").alias("id"), F.upper("p_name").alias("title")).where(c("title").like("RED%"))


@query("SELECT event_id AS tx, user_id AS dbid FROM events WHERE user_id IN (3, 5) AND event_id % 16 = 4 UNION ALL SELECT event_id, user_id FROM events WHERE event_id = 7")
def numeric_ids(spark, sf_dir):
    """Terms on number fields: node, list and transaction."""
    log = changes(spark, sf_dir).withColumn("aclid", c("tx") % 16)
    by_node = reduce(or_, [X.number_equals(c("dbid"), n) for n in (3, "5")])
    hit = (by_node & X.number_equals(c("aclid"), 4)) | X.number_equals(c("tx"), 7)
    return log.where(hit).select("tx", "dbid")


@query("SELECT n_nationkey AS node, false AS is_root, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AS is_container FROM nation UNION ALL SELECT r_regionkey + 1000, true, EXISTS (SELECT 1 FROM nation WHERE n_regionkey = r_regionkey) FROM region UNION ALL SELECT c_custkey + 10000, false, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) FROM customer")
def node_flags(spark, sf_dir):
    """Root and container by the tree: a root has no parent, a container is a parent."""
    r, n, k, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    parts = [(r, c("r_regionkey") + 1000, None), (n, c("n_nationkey"), c("n_regionkey") + 1000), (k, c("c_custkey") + 10000, c("c_nationkey"))]
    tree = [df.select(key.cast("long").alias("node"), (F.lit(None) if up is None else up).cast("long").alias("parent")) for df, key, up in parts]
    all_ = reduce(lambda a, b: a.unionAll(b), tree)
    parents = all_.select(c("parent").alias("p")).unionAll(o.select((c("o_custkey") + 10000).alias("p"))).where("p is not null").distinct()
    return all_.join(parents, c("node") == c("p"), "left").select("node", c("parent").isNull().alias("is_root"), c("p").isNotNull().alias("is_container"))


@query("SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'MEDIUM', 'LARGE') OR p_brand = 'Brand#3'")
def class_filter(spark, sf_dir):
    """A class is a type or an aspect."""
    d = part_types()
    d.put("Brand#3", "sized")
    return _parts(spark, sf_dir).where(d.is_class(c("p_type"), F.array("p_brand"), "sized")).select("p_partkey")


@query(TREE + "SELECT o_orderkey FROM h WHERE n_name = 'NATION_7' AND r_name || '/' || n_name = '" + "ASIA/NATION_7' OR c_name = 'Customer#000000009'")
def name_paths(spark, sf_dir):
    """Exact terms on paths of names from the root (NPATH) and up from the parent (PNAME)."""
    npath, pname = X.ancestor_paths(c("paths")), X.ancestor_names(X.parent_paths(c("paths")))
    hit = holds(F.array_contains(npath, "1/ASIA/NATION_7")) | holds(F.array_contains(pname, "0/Customer#000000009"))
    return hierarchy(spark, sf_dir).where(hit).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (3, 33)")
def qname(spark, sf_dir):
    return hierarchy(spark, sf_dir).where(X.last_step(c("paths"), "3") | X.last_step(c("paths"), "33")).select("o_orderkey")


@query("SELECT p_partkey, p_name = 'red widget' AS identifier, list_contains(string_split(p_name, ' '), 'red') AS words, len(list_filter(string_split(p_name, ' '), lambda t: starts_with(t, 'wid'))) > 0 AS starts, p_name LIKE '%d w%' AS alike, len(list_filter(string_split(p_name, ' '), lambda t: levenshtein(t, 'widgex') <= 1)) > 0 AS close, len(list_filter(string_split(p_name, ' '), lambda t: regexp_full_match(t, 'b.*t'))) > 0 AS wild FROM part")
def property_modes(spark, sf_dir):
    """One property under every mode of analysis."""
    value, held = c("p_name"), tokens("p_name")
    asked = [("identifier", "red widget", "IDENTIFIER"), ("words", "red", "DEFAULT"), ("starts", "wid", "PREFIX"), ("alike", "%d w%", "LIKE"), ("close", "widgex", "FUZZY"), ("wild", "b*t", "WILD")]
    return _parts(spark, sf_dir).select("p_partkey", *[A.property_term(value, held, w, mode).alias(name) for name, w, mode in asked])


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def prop_star(spark, sf_dir):
    """``quality:*``: the property has a value."""
    d = _documents(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.where(X.any_value(c("quality"), "**")).select("doc_id")


@query("SELECT p_partkey FROM part WHERE len(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_brand || ' ' || p_type), '[^a-z0-9]+'), lambda t: starts_with(t, 'pro') OR starts_with(t, 'bi'))) > 0")
def all_prefix(spark, sf_dir):
    """A prefix over all attributes; a term over all of them is refused."""
    held = [tokens(x) for x in ("p_name", "p_brand", "p_type")]
    hit = X.over_all(held, "prefix", lambda h: prefix(h, "pro")) | X.over_all(held, "prefix", lambda h: prefix(h, "bi"))
    return _parts(spark, sf_dir).where(hit).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%widget%' OR lower(p_brand) = 'widget'")
def datatype_field(spark, sf_dir):
    """A word in any property of kind text."""
    d = part_types()
    return _parts(spark, sf_dir).where(any_of([term(d.read(p.name, "fts"), "widget") for p in d.of_kind("text")])).select("p_partkey")


@query("SELECT doc_id AS dbid FROM documents WHERE n_chars BETWEEN 500 AND 2000 AND lang = 'fr' AND source <> 'src1'")
def content_metadata(spark, sf_dir):
    """Size, locale, encoding and mimetype of a content as fields of its struct."""
    kind = F.when(c("source") == "src1", "application/pdf").otherwise("text/plain")
    content = F.struct(c("size").alias("size"), kind.alias("mimetype"), F.lit("UTF-8").alias("encoding"), c("locale").alias("locale"))
    n = nodes(spark, sf_dir).withColumn("content", content)
    hit = X.number_range(c("content.size"), 500, 2000) & holds(c("content.mimetype") == "text/plain") & holds(c("content.locale") == "fr") & holds(F.lower("content.encoding") == "utf-8")
    return n.where(hit).select("dbid")


@query("SELECT p_partkey FROM part WHERE (p_partkey % 2 = 0 AND string_split(p_name, ' ')[1] >= 'big' AND string_split(p_name, ' ')[1] <= 'old') OR (p_partkey % 2 = 1 AND lower(p_type) >= 'big' AND lower(p_type) <= 'old')")
def mltext_range(spark, sf_dir):
    """A range over the first word of the texts of the query's locale."""
    texts = F.when(c("p_partkey") % 2 == 0, F.create_map(F.lit("en"), c("p_name"), F.lit("de"), F.lit("zzz"))).otherwise(F.create_map(F.lit("en"), c("p_type"), F.lit("fr"), F.lit("big")))
    return _parts(spark, sf_dir).where(holds(F.exists(A.texts_for(texts, "en_GB", "LOCALE_AND_LANGUAGE"), lambda t: first_token_range(tokens(t), "big", "old")))).select("p_partkey")


@query("SELECT event_id AS tx FROM events WHERE event_id >= 100 AND event_id < 250 AND event_type = 'click'")
def cascade_tx_range(spark, sf_dir):
    cascading = F.when(c("event_type") == "click", c("tx"))
    return changes(spark, sf_dir).where(X.number_range(cascading, 100, 250, (True, False))).select("tx")


@query("SELECT p_partkey FROM part WHERE upper(p_name) = 'RED WIDGET'")
def wrong_case(spark, sf_dir):
    """The literal of the second function has the wrong case, so it matches nothing."""
    return _parts(spark, sf_dir).where(A.cased_equals(c("p_name"), "UPPER", "RED WIDGET") | A.cased_equals(c("p_type"), "LOWER", "PROMO")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE (p_name LIKE '%red%' OR p_type = 'PROMO') AND NOT (list_contains(string_split(p_name, ' '), 'bolt') AND p_brand LIKE 'Brand%')")
def templates(spark, sf_dir):
    fields = {"name": tokens("p_name"), "brand": tokens("p_brand"), "type": tokens("p_type")}
    wanted = A.template(fields, "%(name OR type)", ["red", "promo"])
    unwanted = A.template(fields, "%(name)", ["bolt"]) & A.template(fields, "%(brand AND brand)", ["brand"])
    return _parts(spark, sf_dir).where(wanted & complement(unwanted)).select("p_partkey")


@query("SELECT doc_id AS dbid FROM documents WHERE source IN ('src1', 'src2') AND n_chars >= 300 AND n_chars < 3000 AND lang = 'en'")
def fq_list(spark, sf_dir):
    """A list of filters: all hold; a group of kinds and a range of sizes are spelled out first."""
    groups = {"web": ["src1", "src2"], "books": ["src3"]}
    filters = ["mimetype():web", "contentSize():300 TO 3000", "lang = 'en'"]
    n = _documents(spark, sf_dir)
    for f in filters:
        n = n.where(X.facet_filter(f, c("source"), c("n_chars"), groups))
    return n.select(c("doc_id").alias("dbid"))


@query("SELECT * FROM (SELECT doc_id AS dbid, 'LOCALE_ONLY' AS mode FROM documents WHERE lang = 'de' AND doc_id % 3 = 0 UNION ALL SELECT doc_id, 'LOCALE_AND_LANGUAGE' FROM documents WHERE lang = 'de' AND doc_id % 3 <> 2 UNION ALL SELECT doc_id, 'LOCALE_AND_ALL' FROM documents WHERE lang = 'de' OR doc_id % 3 = 2 UNION ALL SELECT doc_id, 'ALL_ONLY' FROM documents WHERE doc_id % 3 = 2)")
def locale_modes(spark, sf_dir):
    """Which texts a query in Swiss German reads, by mode."""
    key = F.when(c("dbid") % 3 == 0, F.concat("locale", F.lit("_CH"))).when(c("dbid") % 3 == 1, c("locale")).otherwise("")
    n = nodes(spark, sf_dir).select("dbid", F.create_map(key, c("size")).alias("texts"))
    made = [n.where(F.size(A.texts_for("texts", "de_CH", mode)) > 0).select("dbid", F.lit(mode).alias("mode")) for mode in A.MODES]
    return reduce(lambda a, b: a.unionAll(b), made)


@query("SELECT doc_id AS dbid FROM documents WHERE doc_id % 5 IN (0, 3)")
def tenants_any(spark, sf_dir):
    tenant = F.when(c("dbid") % 5 == 0, "_DEFAULT_").otherwise(F.concat(F.lit("t"), (c("dbid") % 5).cast("string")))
    return of_tenants(nodes(spark, sf_dir).withColumn("tenant", tenant), ["", "t3"]).select("dbid")


@query("SELECT c.c_custkey AS id, n.n_name AS nation, r.r_name AS region, o.o_orderkey AS oid FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000 WHERE r.r_name = 'ASIA'")
def cmis_chained_join(spark, sf_dir):
    k, n, r, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "region", "orders"))
    up = k.join(n, c("c_nationkey") == c("n_nationkey")).join(r.where("r_name = 'ASIA'"), c("n_regionkey") == c("r_regionkey"))
    return up.join(o.where("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left").select(c("c_custkey").alias("id"), c("n_name").alias("nation"), c("r_name").alias("region"), c("o_orderkey").alias("oid"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate >= TIMESTAMP '1998-02-01' AND o_orderdate < TIMESTAMP '1998-03-01') OR (o_orderdate >= TIMESTAMP '1995-06-10 00:00:00' AND o_orderdate < TIMESTAMP '1995-06-13') OR (o_orderdate > TIMESTAMP '1999-12-31 23:59:59.999' AND o_orderdate < TIMESTAMP '2000-01-03')")
def date_units(spark, sf_dir):
    """Months, days and hours as intervals, excluded ends and date maths."""
    from .field_queries import NOW

    d = c("o_orderdate")
    hit = X.date_equals(d, "1998-02", NOW) | X.date_range(d, "1995-06-10T00", "1995-06-12", NOW) | X.date_range(d, "1999", "2000-01-02", NOW, (False, True))
    return _orders(spark, sf_dir).where(hit).select("o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1")
def unique_field_values(spark, sf_dir):
    """Values of a field are kept once for each node."""
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("values"))  # an order has few lines
    return unique_values(held, "values").select("l_orderkey", F.size("values").cast("long").alias("flags"))


@query("SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'LARGE')")
def models_source(spark, sf_dir):
    """A dictionary from models as JSON, whose types come in any order."""
    from .dictionary import from_json

    d = from_json(['{"types": [{"name": "x:small", "parent": "sized"}, {"name": "LARGE", "parent": "x:small"}]}', '{"types": [{"name": "sized"}], "properties": [{"name": "kind", "column": "p_type", "tokenised": "FALSE"}]}'])
    d.put("SMALL", "sized")
    return _parts(spark, sf_dir).where(d.is_type(d.read("kind", "sort"), "sized")).select("p_partkey")

