"""All queries of the library by name, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fields import number_range
from ..functions.text import complement, term, tokens
from ..operators.access import readable
from ..operators.facets import field_facet
from ..operators.ranking import bm25, top
from ..sources.content import access_lists, nodes
from . import analysis_queries, field_queries, result_queries, schema_queries, service_queries, text_queries  # noqa: F401  they register their queries
from .registry import ACL, D, QUERIES, SQL, query


def search(spark: SparkSession, sf_dir: str, words: list[str], without: list[str], size: tuple, authorities: list[str]) -> DataFrame:
    """Nodes with all words and none of the others, in a size range, that the authorities may read. Cheap filters stand
    before the joins, and only then texts are tokenized."""
    held = tokens("text")
    n = nodes(spark, sf_dir).where(number_range(F.col("size"), *size))
    match = F.lit(True)
    for w in words:
        match = match & term(held, w)
    for w in without:
        match = match & complement(term(held, w))
    return readable(n.where(match), access_lists(spark), authorities)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search behind a permission filter: the ten most relevant nodes."""
    found = search(spark, sf_dir, ["the"], ["idiot"], (200, 20000), ["user3", "GROUP_R1", "GROUP_D1"])
    return top(bm25(found, "dbid", tokens("text"), ["ering", "the"]), "dbid", 10)


_FOUND = "WITH " + ACL + ", d AS (" + D.removeprefix("WITH d AS (").rstrip()
_WHERE = "list_contains(t, 'the') AND NOT list_contains(t, 'idiot') AND d.n_chars BETWEEN 200 AND 20000 AND (aclid IN (SELECT aclid FROM acl WHERE list_contains(readers, 'GROUP_R1')) OR owner = 'user3') AND aclid NOT IN (SELECT aclid FROM acl WHERE list_contains(denied, 'GROUP_D1'))"


@query(_FOUND + f" SELECT d.source AS value, count(*) AS cnt FROM d JOIN n USING (dbid) WHERE {_WHERE} GROUP BY 1")
def search_with_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facet of the flagship search: counts of what the user may see only."""
    return field_facet(search(spark, sf_dir, ["the"], ["idiot"], (200, 20000), ["user3", "GROUP_R1", "GROUP_D1"]), F.col("source"))


def queries():
    return QUERIES


def oracle_sql():
    return SQL
