"""What a response returns: default and mapped fields, renamed and deduplicated values, scores, names of facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType

from ..plans.dictionary import Dictionary

#: What may be returned without a field map.
DEFAULT = ("id", "dbid", "score")
#: Before a stored text of a language stands its locale between two zero characters.
MARKED = r"^\x00[^\x00]*\x00"


def default_fields(df: DataFrame, asked: list[str]) -> DataFrame:
    """Of the asked fields those that need no map; ``id`` and ``dbid`` where none is left."""
    held = [c for c in DEFAULT if c in df.columns and (c in [a.lower() for a in asked] or "*" in asked)]
    return df.select(*(held or [c for c in DEFAULT[:2] if c in df.columns]))


def mapped_fields(df: DataFrame, dictionary: Dictionary, asked: list[str], values_only: bool = False) -> DataFrame:
    """The asked properties under their model names, ``*`` for all; with ``values_only`` those that keep column values.
    Names that the dictionary does not know are left out."""
    names = list(dictionary.properties) if "*" in asked else [n for n in asked if n in dictionary.properties]
    held = [dictionary.properties[n] for n in names]
    return df.select(*[F.col(p.column or p.name).alias(p.name) for p in held if p.indexed and (not values_only or p.keeps_values() or p.tokenised != "TRUE")])


def response(df: DataFrame) -> DataFrame:
    """The names and values that a client sees: colons become underscores in single-valued fields, texts lose their locale's
    marker, multi-valued fields become sets, and maps by locale their values."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, MapType):
            c = F.map_values(c)
        if isinstance(f.dataType, ArrayType | MapType):
            out.append(F.array_distinct(F.transform(c, unmarked) if "string" in f.dataType.simpleString() else c).alias(f.name))
        else:
            out.append((unmarked(c) if f.dataType.simpleString() == "string" else c).alias(f.name.replace(":", "_")))
    return df.select(*out)


def unmarked(text: Column) -> Column:
    return F.regexp_replace(text, MARKED, "")


def restored(counts: DataFrame, names: dict[str, str], column: str = "field") -> DataFrame:
    """Facet counts under the names that the request used instead of those of the columns."""
    mapping = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return counts.withColumn(column, F.coalesce(mapping[F.col(column)], F.col(column)))


def one_selector(*selectors: DataFrame) -> DataFrame:
    """Full-text queries have one selector; joins belong to the other language."""
    if len(selectors) != 1:
        raise ValueError("a full-text query has one selector: advanced joins are not supported")
    return selectors[0]
