"""Permission filters: readers as a semi-join, denials as an anti-join, owners and global readers beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Authorities that read everything.
GLOBAL_READERS = frozenset({"ROLE_ADMINISTRATOR", "ROLE_SYSTEM"})


def acls_with(acl: DataFrame, column: str, authorities: list[str]) -> DataFrame:
    """aclid of the lists that name one of the authorities. Lists are exploded and filtered before anything is joined;
    joining on overlapping arrays would compare all pairs."""
    return acl.select("aclid", F.explode(column).alias("authority")).where(F.col("authority").isin(*authorities)).select("aclid").distinct()


def is_user(authority: str) -> bool:
    return not authority.startswith(("GROUP_", "ROLE_"))


def readable(nodes: DataFrame, acl: DataFrame, authorities: list[str], any_deny: bool = True, check: bool = True) -> DataFrame:
    """The nodes that somebody with the authorities may read: those of a list that names a reader among them, or that they
    own; none of a list that denies one of them (unless ``any_deny`` is off). Administrators, or ``check`` off: all."""
    if not check or GLOBAL_READERS & set(authorities):
        return nodes
    allowed = acls_with(acl, "readers", authorities).withColumn("__reads", F.lit(True))
    users = [a for a in authorities if is_user(a)]
    owns = F.coalesce(F.col("owner").isin(*users), F.lit(False)) if users else F.lit(False)
    out = nodes.join(allowed, "aclid", "left").where(F.col("__reads").isNotNull() | owns).drop("__reads")
    if any_deny:
        out = out.join(acls_with(acl, "denied", authorities), "aclid", "left_anti")
    return out


def readers_of(nodes: DataFrame, acl: DataFrame, authorities: list[str]) -> DataFrame:
    return nodes.join(acls_with(acl, "readers", authorities), "aclid", "left_semi")


def denied_to(nodes: DataFrame, acl: DataFrame, authorities: list[str]) -> DataFrame:
    return nodes.join(acls_with(acl, "denied", authorities), "aclid", "left_semi")


def of_tenants(nodes: DataFrame, tenants: list[str]) -> DataFrame:
    return nodes.where(F.col("tenant").isin(*[t or "_DEFAULT_" for t in tenants]))
