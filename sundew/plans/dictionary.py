"""The model dictionary: types with inheritance, aspects, properties and how each use of a property reads its column."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import holds, tokens


@dataclass(frozen=True)
class Property:
    """tokenised: TRUE, FALSE or BOTH; facetable: True, False, or None for the kind's rule."""

    name: str
    kind: str = "text"
    column: str = ""
    multiple: bool = False
    tokenised: str = "TRUE"
    facetable: bool | None = None
    indexed: bool = True

    def keeps_values(self) -> bool:
        """Whether facets, statistics and sorting may read it."""
        if self.facetable is not None:
            return self.facetable
        primitive = self.kind in ("int", "long", "float", "double", "date", "datetime", "boolean", "category", "noderef")
        return primitive and self.tokenised != "TRUE" or primitive


@dataclass
class Dictionary:
    """Types by name with their parent and whether super-type queries include them; properties by name."""

    parents: dict[str, str | None] = field(default_factory=dict)
    hidden: set[str] = field(default_factory=set)
    properties: dict[str, Property] = field(default_factory=dict)
    errors: list[str] = field(default_factory=list)

    def put(self, name: str, parent: str | None = None, included: bool = True) -> None:
        if parent is not None and parent not in self.parents:
            self.errors.append(f"{name}: unknown parent {parent}")
            return
        self.parents[name] = parent
        (self.hidden.discard if included else self.hidden.add)(name)

    def remove(self, name: str) -> None:
        if any(p == name for p in self.parents.values()):
            raise ValueError(f"{name} has subtypes")
        self.parents.pop(name, None)

    def find(self, name: str) -> str | None:
        """The type of that name, without regard to case and prefix."""
        short = name.split(":")[-1].lower()
        return next((t for t in self.parents if t.lower() == name.lower() or t.split(":")[-1].lower() == short), None)

    def closure(self, name: str) -> list[str]:
        """The type and its subtypes that super-type queries include; none for an unknown type."""
        top = self.find(name)
        if top is None:
            return []
        out = []
        for t in self.parents:
            at: str | None = t
            while at is not None and at != top:
                at = self.parents[at]
            if at == top and (t == top or t not in self.hidden):
                out.append(t)
        return out

    def get(self, name: str) -> dict:
        """What is known of a type; empty for an unknown one."""
        found = self.find(name)
        return {"name": found, "parent": self.parents[found], "included": found not in self.hidden} if found else {}

    def names(self) -> list[str]:
        return sorted(self.parents)

    def is_type(self, column: Column, name: str, exact: bool = False) -> Column:
        found = [self.find(name)] if exact and self.find(name) else [] if exact else self.closure(name)
        return holds(column.isin(*found)) if found else F.lit(False)

    def has_aspect(self, column: Column, name: str, exact: bool = False) -> Column:
        found = [self.find(name)] if exact and self.find(name) else [] if exact else self.closure(name)
        return holds(F.arrays_overlap(column, F.array(*map(F.lit, found)))) if found else F.lit(False)

    def is_class(self, kinds: Column, aspects: Column, name: str) -> Column:
        """A type or an aspect of that name, subtypes included."""
        return self.is_type(kinds, name) | self.has_aspect(aspects, name)

    def sort_column(self, name: str) -> Column:
        column = self.read(name, "sort")
        if column is None:
            raise ValueError(f"{name} cannot be sorted by")
        return column

    def model_name(self, column: str) -> str | None:
        """The property of a column; ``name.size`` and its like for the parts of a content, which stand behind two underscores."""
        name, _, part = column.partition("__")
        found = next((p.name for p in self.properties.values() if (p.column or p.name) == name), None)
        return f"{found}.{part}" if found and part else found

    def read(self, name: str, use: str) -> Column | None:
        """The column for a use (fts, exact, facet, sort, stats, suggest, highlight); None where the use has none."""
        p = self.properties.get(name)
        if p is None or not p.indexed:
            return None
        column = F.col(p.column or p.name)
        if use == "fts":
            return tokens(column) if p.tokenised != "FALSE" else F.array(F.lower(column))
        if use == "sort":
            return None if p.multiple and p.kind in ("text", "mltext", "content") else column
        if use in ("facet", "stats"):
            return column if p.keeps_values() or p.tokenised != "TRUE" else None
        return column

    def of_kind(self, kind: str) -> list[Property]:
        return [p for p in self.properties.values() if p.kind == kind and p.indexed]


def from_json(models: list[str]) -> Dictionary:
    """A dictionary from models as JSON texts: {"types": [{"name", "parent", "included"}], "properties": [{"name", ...}]}. Types may
    come before their parents, also in another model; those whose parent is nowhere are errors."""
    d, waiting = Dictionary(), []
    for text in models:
        model = json.loads(text)
        waiting += model.get("types", [])
        d.properties |= {p["name"]: Property(**p) for p in model.get("properties", [])}
    while ready := [t for t in waiting if t.get("parent") is None or t["parent"] in d.parents]:
        for t in ready:
            d.put(t["name"], t.get("parent"), t.get("included", True))
        waiting = [t for t in waiting if t not in ready]
    for t in waiting:
        d.put(t["name"], t["parent"])
    return d


def part_types() -> Dictionary:
    """The part types of the driver's tables as a small hierarchy."""
    d = Dictionary()
    d.put("item")
    for group, names in (("sized", ("SMALL", "MEDIUM", "LARGE")), ("priced", ("ECONOMY", "STANDARD", "PROMO"))):
        d.put(group, "item")
        for n in names:
            d.put(n, group, included=n != "PROMO")
    d.properties = {p.name: p for p in (Property("name", column="p_name", tokenised="BOTH"), Property("brand", column="p_brand", tokenised="FALSE"), Property("size", "int", "p_size"), Property("price", "double", "p_retailprice"))}
    return d
