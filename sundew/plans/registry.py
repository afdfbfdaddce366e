"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: The SQL forms of what queries share.
TOKENS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')"
D = f"WITH d AS (SELECT doc_id AS dbid, text, lang, source, n_chars, {TOKENS} AS t FROM documents) "
ACL = "acl AS (SELECT aclid, ['GROUP_R' || (aclid % 5), 'GROUP_R' || (aclid * 3 % 7)] AS readers, CASE WHEN aclid % 4 = 0 THEN ['GROUP_D1'] ELSE [] END AS denied FROM range(16) r(aclid)), n AS (SELECT doc_id AS dbid, doc_id % 16 AS aclid, 'user' || (doc_id % 7) AS owner, source, n_chars FROM documents) "
TREE = "WITH h AS (SELECT o_orderkey, o_custkey, '/' || r_name || '/' || n_name || '/' || c_name || '/' || o_orderkey AS p, r_name, n_name, c_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, which must be new."""

    def keep(f: Callable) -> Callable:
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep
