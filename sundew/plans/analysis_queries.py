"""Analysis by locale, highlighting, spelling, term vectors, boosts and paths as tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import analysis as A
from ..functions import fields as X
from ..functions import text as T
from ..operators import facets as C
from ..operators import ranking as R
from ..sources.content import hierarchy, nodes, table
from .registry import D, query
from .result_queries import _BM, _SECOND, _TERMS, _second, _terms

c = F.col
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def _stop(language):
    return "[" + ", ".join(f"'{w}'" for w in A.STOP[language]) + "]"


@query(f"SELECT doc_id AS dbid, len(list_filter({_WORDS}, lambda t: NOT CASE lang " + " ".join(f"WHEN '{x}' THEN list_contains({_stop(x)}, t)" for x in A.STOP) + " ELSE false END))::BIGINT AS words FROM documents")
def stopwords(spark, sf_dir):
    """Words left by each document's own list of stop words."""
    held = A.words("text")
    for x in A.STOP:
        held = F.when(c("locale") == x, A.without_stops(A.words("text"), x)).otherwise(held)
    return nodes(spark, sf_dir).select("dbid", F.size(held).cast("long").alias("words"))


def _stem(language, value):
    return f"regexp_replace({value}, '^(.{{3,}}?)(?:{'|'.join(A.ENDINGS[language])})$', '\\1')"


_ANALYZED = "CASE lang " + " ".join(f"WHEN '{x}' THEN list_transform(list_filter({_WORDS}, lambda t: NOT list_contains({_stop(x)}, t)), lambda t: {_stem(x, 't')})" for x in sorted(A.STOP)) + f" ELSE {_WORDS} END"


@query(f"WITH a AS (SELECT lang, unnest({_ANALYZED}) AS term, doc_id FROM documents) SELECT lang AS locale, term, count(DISTINCT doc_id) AS df FROM a GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3")
def locale_terms(spark, sf_dir):
    """Terms as each locale's analyzer makes them, with the documents that hold them."""
    n = nodes(spark, sf_dir).select("locale", F.explode(F.array_distinct(A.analyzed("text", c("locale")))).alias("term"))
    return n.groupBy("locale", "term").agg(F.count("*").alias("df")).where("df >= 3")


_CUT = "regexp_replace(regexp_replace(regexp_replace(v, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g')"


@query(f"WITH t AS (SELECT p_partkey, p_brand || ' ' || replace(p_name, ' ', 'X') || p_size || 'cm' AS v FROM part) SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower({_CUT}), '[^a-z0-9]+'), lambda t: t <> ''), ' ') AS parts FROM t")
def word_delimiter(spark, sf_dir):
    """``Brand#13 redXwidget24cm`` in its parts."""
    v = F.concat("p_brand", F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("X")), c("p_size").cast("string"), F.lit("cm"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(A.word_parts(v), " ").alias("parts"))


_HITS = "list_filter(list_transform(range(0, ceil(length(text) / 80.0)::BIGINT), lambda i: {'i': i, 'piece': substr(text, i * 80 + 1, 80)}), lambda x: regexp_matches(x.piece, '(?i)\\b(idiot|scum)\\b'))"
_MARK = "regexp_replace({x}, '(?i)\\b(idiot|scum)\\b', '<b>\\1</b>', 'g')"


@query(f"SELECT doc_id AS dbid, list_transform(({_HITS})[1:3], lambda x: {_MARK.format(x='x.piece')}) AS fragments FROM documents WHERE regexp_matches(text, '(?i)\\b(idiot|scum)\\b')")
def highlight_fragments(spark, sf_dir):
    """Up to three fragments of 80 characters with marks of their own."""
    n = nodes(spark, sf_dir).where(c("text").rlike(r"(?i)\b(idiot|scum)\b"))
    return n.select("dbid", T.fragments("text", ["idiot", "scum"], 80, 3, before="<b>", after="</b>").alias("fragments"))


@query(f"WITH h AS (SELECT doc_id AS dbid, unnest({_HITS}) AS x FROM documents), g AS (SELECT dbid, x.i AS i, x.piece AS piece, x.i - row_number() OVER (PARTITION BY dbid ORDER BY x.i) AS run FROM h), m AS (SELECT dbid, min(i) AS i, string_agg(piece, '' ORDER BY i) AS piece FROM g GROUP BY dbid, run) SELECT dbid, list({_MARK.format(x='piece')} ORDER BY i) AS fragments FROM m GROUP BY 1")
def highlight_merged(spark, sf_dir):
    """Neighbouring fragments as one."""
    n = nodes(spark, sf_dir).select("dbid", T.fragments("text", ["idiot", "scum"], 80, 1_000_000, merge=True, before="<b>", after="</b>").alias("fragments"))
    return n.where(F.size("fragments") > 0)


@query(_TERMS + "SELECT term, df, levenshtein(term, 'wither')::INT AS distance FROM f WHERE len(term) >= 4 AND starts_with(term, 'w') AND term <> 'wither' AND levenshtein(term, 'wither') <= 2 AND 1 - levenshtein(term, 'wither') / greatest(len(term), 6)::DOUBLE >= 0.7 ORDER BY 3, df DESC, term LIMIT 5")
def spell_accuracy(spark, sf_dir):
    return R.spellings(_terms(spark, sf_dir), "wither", accuracy=0.7).select("term", "df", "distance")


@query(_TERMS + ", s AS (SELECT term FROM f WHERE len(term) >= 4 AND starts_with(term, 't') AND term <> 'thatt' AND levenshtein(term, 'thatt') <= 2 ORDER BY levenshtein(term, 'thatt'), df DESC, term LIMIT 5) SELECT s.term, count(DISTINCT d.dbid) AS hits FROM s JOIN x ON x.term = s.term JOIN d ON d.dbid = x.dbid WHERE list_contains(t, 'with') AND d.n_chars > 500 GROUP BY 1")
def spell_collations(spark, sf_dir):
    """Corrections of the second word that find something together with the first word and the filter."""
    corrections = R.spellings(_terms(spark, sf_dir), "thatt")
    return R.collations(nodes(spark, sf_dir).where("size > 500"), T.tokens("text"), ["with", "thatt"], corrections, 1)


@query(D + ", x AS (SELECT unnest(t) AS term, unnest(range(0, len(t))) AS pos FROM d WHERE dbid = 28) SELECT term, count(*) AS tf, list(pos::INT ORDER BY pos) AS positions FROM x GROUP BY 1")
def term_vector(spark, sf_dir):
    return R.term_vector(nodes(spark, sf_dir), "dbid", T.tokens("text"), 28)


@query(_TERMS + "SELECT term, df FROM f WHERE term >= 'ti' AND starts_with(term, 'ti') ORDER BY term LIMIT 20")
def terms_list(spark, sf_dir):
    """The terms of a field in order from a prefix on."""
    return _terms(spark, sf_dir).where(c("term").startswith("ti")).orderBy("term").limit(20)


@query(D + ", x AS (SELECT t[i] AS term, coalesce(CASE WHEN i > 1 THEN t[i - 1] END, '') AS a, coalesce(t[i + 1], '') AS b FROM (SELECT t, unnest(range(1, len(t) + 1)) AS i FROM d)) SELECT term, count(DISTINCT (a, b)) AS contexts FROM x GROUP BY 1")
def word_contexts(spark, sf_dir):
    return R.word_contexts(nodes(spark, sf_dir), c("text"))


@query(_BM.replace("{tf}", "tf") + "SELECT dbid, round(CASE WHEN a > 0 THEN 4 * ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / av)) ELSE 0 END + CASE WHEN b > 0 THEN ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / av)) ELSE 0 END, 6) AS score FROM f, g WHERE a > 0 OR b > 0")
def bm25_boost(spark, sf_dir):
    """``ering^4 idiot``."""
    return R.bm25(nodes(spark, sf_dir), "dbid", T.tokens("text"), ["ering", "idiot"], boosts={"ering": 4.0}).select("dbid", F.round("score", 6).alias("score"))


@query(_BM + "SELECT dbid, round(score, 6) AS relevance, round(score, 6) AS s2 FROM s WHERE score > 0")
def cmis_order_score(spark, sf_dir):
    """Several scores under names of their own; the order goes by one of the names."""
    n = R.bm25(nodes(spark, sf_dir), "dbid", T.tokens("text"), ["ering", "idiot"])
    return n.select("dbid", F.round("score", 6).alias("relevance"), F.round("score", 6).alias("s2")).orderBy(F.desc("relevance"), "dbid")


@query(_BM + _SECOND.replace("LIMIT 50", "LIMIT 130") + ", r AS (SELECT dbid, h.score + 2 * coalesce(second, 0) AS score, 0 AS tail FROM h LEFT JOIN m USING (dbid) UNION ALL SELECT dbid, score, 1 FROM s WHERE score > 0 AND dbid NOT IN (SELECT dbid FROM h)) SELECT dbid, round(score, 6) AS score, (row_number() OVER (ORDER BY tail, r.score DESC, dbid))::INT AS place FROM r")
def rerank_page(spark, sf_dir):
    """A page that ends beyond the rows to rank again lets as many be ranked."""
    return R.rerank(_scored(spark, sf_dir), _second(spark, sf_dir), "dbid", docs=50, start=100, rows=30).withColumn("score", F.round("score", 6))


@query(_BM + "SELECT dbid, round(score, 6) AS score, (row_number() OVER (ORDER BY dbid DESC))::INT AS place FROM s WHERE score > 0")
def rerank_dropped(spark, sf_dir):
    """With a sort the second query plays no part."""
    return R.ordered(_scored(spark, sf_dir), _second(spark, sf_dir), "dbid", [F.desc("dbid")]).withColumn("score", F.round("score", 6))


def _scored(spark, sf_dir):
    return R.bm25(nodes(spark, sf_dir), "dbid", T.tokens("text"), ["ering", "idiot"])


@query("SELECT namespace, count(*) AS steps, max(length)::INT AS longest FROM (SELECT unnest(['geo', 'geo', 'cm', 'cm']) AS namespace, 4 AS length FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1")
def path_tokens(spark, sf_dir):
    """Paths as pairs of namespace and name."""
    p = F.concat(F.lit("/geo:"), c("r_name"), F.lit("/geo:"), c("n_name"), F.lit("/cm:"), c("c_name"), F.lit("/cm:"), c("o_orderkey").cast("string"))
    steps = hierarchy(spark, sf_dir).select(F.inline(X.path_tokens(F.array(p))))
    return steps.groupBy("namespace").agg(F.count("*").alias("steps"), F.max("length").alias("longest"))


@query("SELECT source AS value, count(*) AS cnt FROM (SELECT 'red ' || source AS source FROM documents WHERE doc_id % 2 = 0) GROUP BY 1")
def tags_derived(spark, sf_dir):
    """Tags from category paths, decoded."""
    p = F.array(F.when(c("doc_id") % 2 == 0, F.concat(F.lit("/cm:categoryRoot/cm:taggable/cm:red_x0020_"), c("source"))).otherwise("/cm:categoryRoot/cm:other/cm:x"))
    return C.multi_field_facet(table(spark, sf_dir, "documents").withColumn("tags", X.tags_of_paths(p)), c("tags"))
