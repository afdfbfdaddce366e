"""Full-text queries over documents and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.content import nodes, table
from .registry import D, query


def _held(spark, sf_dir):
    return nodes(spark, sf_dir).withColumn("t", T.tokens("text"))


def _ids(spark, sf_dir, predicate):
    return _held(spark, sf_dir).where(predicate).select("dbid")


def t():
    """The tokens; columns cannot be made before there is a session."""
    return F.col("t")


@query(D + "SELECT dbid FROM d WHERE list_contains(t, 'ther')")
def term_match(spark, sf_dir):
    return _ids(spark, sf_dir, T.term(t(), "ther"))


@query("SELECT p_partkey FROM part WHERE list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), 'ring') OR list_contains(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), 'ring') OR list_contains(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), 'promo')")
def text_default_fields(spark, sf_dir):
    words = lambda w: T.term(T.tokens("p_name"), w) | T.term(T.tokens("p_type"), w)
    return table(spark, sf_dir, "part").where(words("ring") | words("promo")).select("p_partkey")


@query(D + "SELECT dbid FROM d WHERE list_contains(t, 'the') AND list_contains(t, 'ering')")
def bool_and(spark, sf_dir):
    return _ids(spark, sf_dir, T.term(t(), "the") & T.term(t(), "ering"))


@query(D + "SELECT dbid FROM d WHERE list_contains(t, 'der') OR list_contains(t, 'que')")
def bool_or(spark, sf_dir):
    return _ids(spark, sf_dir, T.term(t(), "der") | T.term(t(), "que"))


@query(D + "SELECT dbid FROM d WHERE NOT list_contains(t, 'the')")
def bool_not(spark, sf_dir):
    return _ids(spark, sf_dir, T.complement(T.term(t(), "the")))


@query(D + "SELECT dbid FROM d WHERE list_contains(t, 'ering') OR NOT list_contains(t, 'the')")
def or_with_negation(spark, sf_dir):
    return _ids(spark, sf_dir, T.term(t(), "ering") | ~T.term(t(), "the"))


@query("SELECT doc_id AS dbid FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(quality = 1, false)")
def not_equal_complement(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id", "left").where(T.complement(F.col("quality") == 1)).select(F.col("doc_id").alias("dbid"))


@query("SELECT doc_id AS dbid FROM documents LEFT JOIN labels USING (doc_id) WHERE NOT coalesce(toxic IN (1, 2), false)")
def not_in_complement(spark, sf_dir):
    d, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    return d.join(labels, "doc_id", "left").where(T.complement(F.col("toxic").isin(1, 2))).select(F.col("doc_id").alias("dbid"))


@query(D + "SELECT dbid FROM d WHERE len(list_filter(t, lambda x: starts_with(x, 'ouwh'))) > 0")
def prefix(spark, sf_dir):
    return _ids(spark, sf_dir, T.prefix(t(), "ouwh"))


@query(D + "SELECT dbid FROM d WHERE len(list_filter(t, lambda x: regexp_full_match(x, 'th.*nd.e'))) > 0")
def wildcard(spark, sf_dir):
    return _ids(spark, sf_dir, T.wildcard(t(), "th*nd?e"))


@query("SELECT doc_id AS dbid FROM documents WHERE regexp_matches(text, '(?s)^.*\\*\\*\\* .*$')")
def escaped_wildcard(spark, sf_dir):
    return nodes(spark, sf_dir).where(T.wildcard_value(F.col("text"), r"*\*\*\* *")).select("dbid")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%ed w_dget%'")
def like(spark, sf_dir):
    return table(spark, sf_dir, "part").where(T.holds(F.col("p_name").like("%ed w_dget%"))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT coalesce(p_name LIKE 'small%', false)")
def not_like(spark, sf_dir):
    return table(spark, sf_dir, "part").where(T.complement(F.col("p_name").like("small%"))).select("p_partkey")


@query(D + "SELECT dbid FROM d WHERE len(list_filter(t, lambda x: levenshtein(x, 'ertion') <= 1)) > 0")
def fuzzy(spark, sf_dir):
    return _ids(spark, sf_dir, T.fuzzy(t(), "ertion", 0.7))


@query(D + "SELECT dbid FROM d WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND t[i + 1] = 'the')) > 0")
def phrase(spark, sf_dir):
    return _ids(spark, sf_dir, T.phrase(t(), ["of", "the"]))


@query(D + "SELECT dbid FROM d WHERE len(list_filter(range(1, len(t)), lambda i: t[i] IN ('that', 'for') AND list_contains(t[i : i + 3], 'that') AND list_contains(t[i : i + 3], 'for'))) > 0")
def phrase_slop(spark, sf_dir):
    return _ids(spark, sf_dir, T.phrase(t(), ["that", "for"], slop=2))


@query(D + "SELECT dbid FROM d WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'of' AND (t[i + 1] = 'the' OR t[i + 2] = 'the'))) > 0")
def phrase_slop_one(spark, sf_dir):
    """Below a slop of 2 the order counts."""
    return _ids(spark, sf_dir, T.phrase(t(), ["of", "the"], slop=1))


@query(D + "SELECT dbid FROM d WHERE len(list_filter(range(1, len(t)), lambda i: t[i] = 'was' AND list_contains(t[i + 1 : i + 5], 'with'))) > 0")
def proximity(spark, sf_dir):
    return _ids(spark, sf_dir, T.near(t(), "was", "with", 4))


@query("SELECT doc_id AS dbid FROM documents WHERE list_contains(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), 'That')")
def exact_term(spark, sf_dir):
    return nodes(spark, sf_dir).where(T.exact_term("text", "That")).select("dbid")


@query(D + "SELECT dbid FROM d WHERE list_has_any(t, ['idiot', 'moron', 'clown'])")
def synonym_expand(spark, sf_dir):
    return _ids(spark, sf_dir, T.any_term(t(), ["idiot", "moron", "clown"]))


@query("SELECT p_partkey FROM part WHERE list_contains(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), 'red') AND p_type = 'PROMO'")
def default_template(spark, sf_dir):
    promoted = lambda word: T.term(T.tokens("p_name"), word) & T.holds(F.col("p_type") == "PROMO")  # noqa: E731  a named query template
    return table(spark, sf_dir, "part").where(promoted("red")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_split_to_array(lower(p_name), '[^a-z0-9]+')[1] >= 'big' AND regexp_split_to_array(lower(p_name), '[^a-z0-9]+')[1] < 'red'")
def text_first_token_range(spark, sf_dir):
    return table(spark, sf_dir, "part").where(T.first_token_range(T.tokens("p_name"), "big", "red", (True, False))).select("p_partkey")


@query("SELECT p_partkey, upper(p_name) AS up FROM part WHERE upper(p_name) = 'RED WIDGET' OR lower(p_type) = 'promo'")
def case_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").where((F.upper("p_name") == "RED WIDGET") | (F.lower("p_type") == "promo")).select("p_partkey", F.upper("p_name").alias("up"))


@query("SELECT doc_id AS dbid FROM documents WHERE lang IN ('de', 'fr') AND n_chars >= 1000")
def locale_filter(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn("texts", F.create_map("locale", "text"))
    return n.where((F.size(T.localized("texts", ["de_DE", "fr"])) > 0) & (F.col("size") >= 1000)).select("dbid")


@query("SELECT doc_id AS dbid, regexp_replace(text, '(?i)\\b(idiot|scum)\\b', '<em>\\1</em>', 'g') AS marked FROM documents WHERE regexp_matches(text, '(?i)\\b(idiot|scum)\\b')")
def highlight(spark, sf_dir):
    n = nodes(spark, sf_dir).where(F.col("text").rlike(r"(?i)\b(idiot|scum)\b"))
    return n.select("dbid", T.highlight("text", ["idiot", "scum"]).alias("marked"))


@query()
def highlight_snippets(spark, sf_dir):
    n = nodes(spark, sf_dir).select("dbid", T.snippet("text", ["idiot", "scum"]).alias("fragment"))
    return n.where("fragment is not null")
