"""Predicates on typed fields: ranges with open or unparsable bounds, dates with resolution, presence, paths and sites."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import decode_names, holds


def _number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def number_equals(column: Column, literal) -> Column:
    """Equality; a literal that is no number matches nothing."""
    value = _number(literal)
    return F.lit(False) if value is None else holds(column == value)


def number_range(column: Column, low, high, closed: tuple[bool, bool] = (True, True)) -> Column:
    """A range; ``*``, MIN, MAX and bounds that are no numbers are open."""
    out, a, b = column.isNotNull(), _number(low), _number(high)
    if a is not None:
        out = out & ((column >= a) if closed[0] else (column > a))
    if b is not None:
        out = out & ((column <= b) if closed[1] else (column < b))
    return holds(out)


_FORMS = ((r"(\d{4})$", "year"), (r"(\d{4})-(\d{2})$", "month"), (r"(\d{4})-(\d{2})-(\d{2})$", "day"), (r"(\d{4})-(\d{2})-(\d{2})T(\d{2})$", "hour"), (r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2})$", "minute"), (r"(\d{4})-(\d{2})-(\d{2})T(\d{2}):(\d{2}):(\d{2})(?:\.\d+)?Z?$", "second"))


def _after(t: datetime, unit: str, n: int = 1) -> datetime:
    if unit == "year":
        return t.replace(year=t.year + n)
    if unit == "month":
        k = t.year * 12 + t.month - 1 + n
        return t.replace(year=k // 12, month=k % 12 + 1)
    return t + n * timedelta(**{unit + "s": 1})


def _floor(t: datetime, unit: str) -> datetime:
    keep = ("year", "month", "day", "hour", "minute", "second").index(unit) + 1
    return datetime(*(t.year, t.month, t.day, t.hour, t.minute, t.second)[:keep], *[1] * max(0, 3 - keep))


def date_interval(literal: str, now: datetime) -> tuple[datetime, datetime] | None:
    """The half-open interval that a literal names, in UTC: ``2016``, ``2016-05``, ..., ``NOW``, ``TODAY`` and date maths such
    as ``NOW/DAY-1DAY``. None for others, such as MIN and MAX."""
    for form, unit in _FORMS:
        if m := re.match(form, literal):
            parts = [int(x) for x in m.groups()]
            start = datetime(*parts, *[1] * max(0, 3 - len(parts)))
            return start, _after(start, unit)
    if literal.upper() == "TODAY":
        return _floor(now, "day"), _after(_floor(now, "day"), "day")
    if m := re.match(r"NOW((?:[/+-]\d*[A-Za-z]+)*)$", literal, re.I):
        t = now
        for sign, n, unit in re.findall(r"([/+-])(\d*)([A-Za-z]+)", m[1]):
            unit = unit.lower().rstrip("s")
            t = _floor(t, unit) if sign == "/" else _after(t, unit, int(n or 1) * (1 if sign == "+" else -1))
        return t, t + timedelta(milliseconds=1)
    return None


def date_equals(column: Column, literal: str, now: datetime) -> Column:
    """Anywhere in the interval that the literal names."""
    named = date_interval(literal, now)
    return F.lit(False) if named is None else holds((column >= F.lit(named[0])) & (column < F.lit(named[1])))


def date_range(column: Column, low: str, high: str, now: datetime, closed: tuple[bool, bool] = (True, True)) -> Column:
    """An exclusive lower bound starts where its interval ends, an inclusive upper bound ends where its interval ends."""
    out, a, b = column.isNotNull(), date_interval(low, now), date_interval(high, now)
    if a:
        out = out & (column >= F.lit(a[0] if closed[0] else a[1]))
    if b:
        out = out & (column < F.lit(b[1] if closed[1] else b[0]))
    return holds(out)


#: Derived parts of a date; they are expressions and never stored.
DATE_PARTS = {"year": F.year, "quarter": F.quarter, "month": F.month, "day_of_month": F.dayofmonth, "day_of_week": F.dayofweek, "day_of_year": F.dayofyear, "hour": F.hour, "minute": F.minute, "second": F.second}


def present(properties: Column, name: str) -> Column:
    """EXISTS: the node has the property, with a value or an explicit null."""
    return holds(F.array_contains(properties, name))


def not_null(properties: Column, nulls: Column, name: str) -> Column:
    return present(properties, name) & ~present(nulls, name)


def explicit_null(nulls: Column, name: str) -> Column:
    return present(nulls, name)


def unset(declares: Column, properties: Column, name: str) -> Column:
    """The node's type or aspects declare the property, and it is absent."""
    return holds(declares) & ~present(properties, name)


def path_pattern(query: str) -> str:
    """A regular expression for a path query: ``/`` steps, ``//`` descendants, ``*`` any name, ``.`` the node itself."""
    out, at = "", 0
    for m in re.finditer(r"(//|/)([^/]*)", query):
        if m.start() != at:
            raise ValueError(f"not a path: {query}")
        at = m.end()
        step = m[2]
        if step == ".":
            out += "(?:/[^/]+)*" if m[1] == "//" else ""
            continue
        if not step:
            raise ValueError(f"a step is missing: {query}")
        name = "[^/]+" if step == "*" else "[^/:]+:" + re.escape(step[2:]) if step.startswith("*:") else re.escape(step[:-1]) + "[^/]+" if step.endswith(":*") else re.escape(step)
        out += ("(?:/[^/]+)*/" if m[1] == "//" else "/") + name
    if at != len(query) or not query:
        raise ValueError(f"not a path: {query}")
    return f"^{out}$"


def path(paths: Column, query: str) -> Column:
    """One of the node's paths matches."""
    pattern = path_pattern(query)
    return holds(F.exists(paths, lambda p: p.rlike(pattern)))


def ancestor_paths(paths: Column) -> Column:
    """Depth-prefixed ancestors of each path, ``0/a``, ``1/a/b``, and ``F/`` before the whole one; each once."""

    def levels(p: Column) -> Column:
        steps = F.filter(F.split(p, "/"), lambda s: s != "")
        deep = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat((n - 1).cast("string"), F.lit("/"), F.array_join(F.slice(steps, 1, n), "/")))
        return F.concat(deep, F.array(F.concat(F.lit("F/"), F.array_join(steps, "/"))))

    return F.array_distinct(F.flatten(F.transform(paths, levels)))


def ancestor_names(paths: Column) -> Column:
    """The suffixes of each path, by length: ``0/c``, ``1/b/c``; each once."""

    def suffixes(p: Column) -> Column:
        steps = F.filter(F.split(p, "/"), lambda s: s != "")
        return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.concat((n - 1).cast("string"), F.lit("/"), F.array_join(F.slice(steps, F.size(steps) - n + 1, n), "/")))

    return F.array_distinct(F.flatten(F.transform(paths, suffixes)))


def parent_paths(paths: Column) -> Column:
    """The paths without their last step."""
    return F.array_distinct(F.transform(paths, lambda p: F.regexp_replace(p, "/[^/]*$", "")))


def any_value(column: Column, stars: str) -> Column:
    """``prop:*``, with any number of stars: the property has a value."""
    if not stars or stars.strip("*"):
        raise ValueError(f"not only stars: {stars}")
    return column.isNotNull()


def over_all(held: list[Column], kind: str, make) -> Column:
    """A predicate over all attributes. Terms are refused; prefixes, wildcards, fuzzy terms, ranges and spans spread over each."""
    if kind == "term":
        raise NotImplementedError("terms over all attributes are not supported")
    out = make(held[0])
    for h in held[1:]:
        out = out | make(h)
    return out


def facet_filter(text: str, kind: Column, size: Column, groups: dict[str, list[str]]) -> Column:
    """A filter of a request: ``mimetype():group``, ``contentSize():a TO b`` (the upper end excluded), or an expression."""
    if text.startswith("mimetype():"):
        return holds(kind.isin(*groups.get(text.partition(":")[2], [text.partition(":")[2]])))
    if text.startswith("contentSize():"):
        low, _, high = text.partition(":")[2].partition(" TO ")
        return number_range(size, low, high, (True, False))
    return holds(F.expr(text))


def path_tokens(paths: Column) -> Column:
    """array<struct<namespace, name, depth>> of the steps of each path, ``/{ns}a`` or ``/ns:a``; the length stands on each."""

    def steps(p: Column) -> Column:
        held = F.filter(F.split(p, "/"), lambda s: s != "")
        return F.transform(held, lambda s: F.struct(F.regexp_extract(s, "^([^:]*):", 1).alias("namespace"), F.regexp_replace(s, "^[^:]*:", "").alias("name"), F.size(held).alias("length")))

    return F.flatten(F.transform(paths, steps))


def tags_of_paths(paths: Column) -> Column:
    """Decoded tags among the category paths of a node: what stands below ``/cm:taggable``."""
    found = F.transform(paths, lambda p: F.regexp_extract(p, r"/cm:taggable/cm:([^/]+)", 1))
    return F.array_distinct(F.transform(F.filter(found, lambda t: t != ""), decode_names))


def last_step(paths: Column, name: str) -> Column:
    return holds(F.exists(paths, lambda p: F.element_at(F.split(p, "/"), -1) == name))


def sites(paths: Column) -> Column:
    """Sites of the node's paths, decoded; ``_SHARED_FILES_`` or ``_REPOSITORY_`` where there is none."""
    found = F.array_distinct(F.filter(F.transform(paths, lambda p: F.regexp_extract(p, r"/sites/([^/]+)", 1)), lambda s: s != ""))
    shared = F.exists(paths, lambda p: p.rlike("^/shared(/|$)"))
    return F.transform(F.when(F.size(found) > 0, found).when(shared, F.array(F.lit("_SHARED_FILES_"))).otherwise(F.array(F.lit("_REPOSITORY_"))), decode_names)


def site(held: Column, wanted: str) -> Column:
    if wanted == "_EVERYTHING_":
        return F.lit(True)
    if wanted == "_ALL_SITES_":
        return ~holds(F.array_contains(held, "_REPOSITORY_"))
    return holds(F.array_contains(held, wanted))


def tag(held: Column, wanted: str) -> Column:
    """The query's tag is lower-cased, stored ones are taken as they are."""
    return holds(F.array_contains(held, wanted.lower()))


def tenant(column: Column, wanted: str | None) -> Column:
    return holds(column == (wanted or "_DEFAULT_"))


def versioned_id(ids: Column, versions: Column, wanted: str) -> Column:
    """``id``, ``id;1.0`` (which also finds the unversioned node) or ``id;PWC`` (none)."""
    name, _, version = wanted.partition(";")
    if version == "PWC":
        return F.lit(False)
    return holds(ids == name) & ((holds(versions == version) | (versions.isNull() if version == "1.0" else F.lit(False))) if version else F.lit(True))
