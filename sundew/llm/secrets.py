"""Secrets in texts by a trigram inverted index, with DataFrame functions only.

For each rule a Boolean trigram query is derived from its regular expression: an OR over its literal skeletons of the AND of
their trigrams, lower-cased. The index holds postings (trigram, document) for the trigrams that any rule asks for, over whole
texts. Postings are intersected by counting, for each document and alternative, the trigrams found; a document with all of
an alternative's is a candidate of the rule, and only candidates are verified with the expression. A rule with a skeleton
that has no trigram, such as runs of hexadecimal digits, scans every document.

Spans are code-point offsets: a text is split at the matches, and the lengths of gaps and matches add up. Up to ``FEW`` candidates
are broadcast and no text is shuffled; more of them are joined by key.

Nulls: a null text is empty; null ids are ids like any other. Rows with the same id and text give the same result each. Empty tables give
empty results. Columns besides doc_id and text do not matter.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound
from .common import checkpoint, read_table


@dataclass(frozen=True)
class Rule:
    """kind; expression (understood alike by Java, RE2 and Python); the group that must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: A run of 24 or more hexadecimal digits is found by its length at once: runs are matched whole, so the shorter ones that
#: are dropped never hide another.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: What the method adds, by the published shapes of credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"(ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("pay_key", r"(sk|rk)_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE
#: Skeletons of a part of an expression beyond which the part counts as a gap.
MOST = 64
GAP = "\0"
#: Candidates up to this number are sent to the texts; beyond it texts and candidates meet by a shuffle.
FEW = 200_000


def _skeletons(items) -> set[str]:
    """Literal texts, gaps for what is not literal, one of which every match contains in order."""
    found = {""}
    for op, arg in items:
        if op is sre.LITERAL:
            part = {chr(arg)}
        elif op is sre.SUBPATTERN:
            part = _skeletons(arg[3])
        elif op is sre.BRANCH:
            part = set().union(*map(_skeletons, arg[1]))
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg) and len(arg) <= 5:
            part = {chr(c) for _, c in arg}
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            once = _skeletons(body)
            part = once | {""} if (low, high) == (0, 1) else once if (low, high) == (1, 1) else {GAP} if low == 0 else {x + GAP for x in once}
        else:
            part = {GAP}
        found = {a + b for a in found for b in part} if len(found) * len(part) <= MOST else {a + GAP for a in found}
    return found


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """The alternatives, each a set of trigrams of which a match has all; None where a match may have none."""
    sets = set()
    for text in _skeletons(sre_parser.parse(pattern)):
        sets.add(frozenset(run[i : i + 3] for run in text.lower().split(GAP) for i in range(len(run) - 2)))
    if frozenset() in sets:
        return None
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """doc_id, text_hash, trigram: which of the trigrams the lower-cased texts hold."""
    low = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("doc_id", "text_hash", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """doc_id, text_hash, rules: the numbers of the rules whose trigram query a document meets."""
    asked = [(n, a, t, len(s)) for n, r in enumerate(rules) for a, s in enumerate(trigram_query(r.pattern) or []) for t in sorted(s)]
    queries = docs.sparkSession.createDataFrame(asked, "rule int, alternative int, trigram string, needed int")
    hits = postings(docs, sorted({x[2] for x in asked})).join(F.broadcast(queries), "trigram")  # as many rows as the rules have trigrams
    met = hits.groupBy("doc_id", "text_hash", "rule", "alternative").agg(F.count_distinct("trigram").alias("n"), F.first("needed").alias("needed")).where("n = needed")
    return met.groupBy("doc_id", "text_hash").agg(F.collect_set("rule").alias("rules"))


def running(lengths: Column) -> Column:
    """The running sums of an array of numbers. An array grows by being copied, so sums run inside stretches of about the
    square root of its size, and then over the stretches."""

    def sums(part: Column) -> Column:
        none = F.array().cast("array<int>")
        return F.aggregate(part, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x)))

    def whole(v: Column) -> Column:
        return bound(F.ceil(F.sqrt(F.size(v))).cast("int"), lambda n: bound(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: sums(F.slice(v, k * n + 1, n))), joined))

    def joined(parts: Column) -> Column:
        ends = bound(F.transform(parts, lambda p: F.coalesce(F.get(p, F.size(p) - 1), F.lit(0))), sums)
        return bound(ends, lambda e: F.flatten(F.transform(parts, lambda p, i: F.transform(p, lambda x: x + F.when(i > 0, F.get(e, i - 1)).otherwise(0)))))

    return bound(lengths, whole)


def spans(number: int, rule: Rule) -> Column:
    """array<struct<start, kind, end>> of a rule's matches in the column text."""
    pattern = F.lit(rule.pattern)
    lengths = lambda column: F.transform(column, lambda x: F.length(x))
    found, gaps = lengths(F.regexp_extract_all("text", pattern, F.lit(0))), lengths(F.split("text", rule.pattern, -1))
    kind = "array<struct<start:int,kind:int,end:int>>"

    def placed(f: Column) -> Column:
        ends = running(F.zip_with(f, F.slice(gaps, 1, F.size(f)), lambda x, gap: x + gap))
        return F.zip_with(ends, f, lambda end, n: F.struct((end - n).alias("start"), F.lit(number).alias("kind"), end.alias("end")))

    all_ = bound(found, placed)
    if rule.least > 1:
        value = lengths(F.regexp_extract_all("text", pattern, F.lit(rule.group)))
        all_ = F.filter(F.zip_with(all_, value, lambda span, n: F.when(n >= rule.least, span)), lambda span: span.isNotNull())
    return F.when(F.regexp("text", pattern), all_.cast(kind)).otherwise(F.array().cast(kind))


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, array<struct<start, kind, end>> ordered by start and rule, of every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    met = checkpoint(candidates(rows, rules)).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    if met.count() <= FEW:  # a checked size: some 50 bytes each
        met = F.broadcast(met)
    full = [n for n, r in enumerate(rules) if trigram_query(r.pattern) is None]
    keyed = rows.withColumn("__key", F.xxhash64("text"))
    joined = keyed.join(met, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")), "left")
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    parts = [spans(n, r) if n in full else F.when(F.array_contains("rules", n), spans(n, r)).otherwise(empty) for n, r in enumerate(rules)]
    return joined.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def _joined(held: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(held, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def _of_kind(number: int):
    return lambda x: x["kind"] == number


def op9_trigram_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets in all of ``documents``."""
    found = find(read_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("spans", _of_kind(n))).cast("long").alias(f"n_{r.kind}") for n, r in enumerate(RULES)]
    base = F.filter("spans", lambda x: x["kind"] < len(BASE))
    return found.select("doc_id", *counts[:3], F.sha2(_joined(base, RULES).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans"), RULES).alias("spans"), *counts[3:])


def _sql() -> str:
    """The same by plain regular expressions in DuckDB."""
    quoted = [r.pattern.replace("'", "''") for r in RULES]
    lists = []
    for n, (r, p) in enumerate(zip(RULES, quoted, strict=True)):
        lists.append(f"regexp_extract_all(t, '{p}', 0) AS m{n}, string_split_regex(t, '{p}') AS g{n}, regexp_extract_all(t, '{p}', {r.group}) AS v{n}")
    spans_ = []
    for n, r in enumerate(RULES):
        start = f"(coalesce(list_sum(list_transform(g{n}[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m{n}[1:i-1], lambda x: length(x))), 0))::BIGINT"
        spans_.append(f"list_transform(list_filter(range(1, len(m{n}) + 1), lambda i: length(v{n}[i]) >= {r.least}), lambda i: {{'start': {start}, 'kind': {n}, 'end': {start} + length(m{n}[i])}}) AS s{n}")
    every, base = (" || ".join(f"s{n}" for n in range(k)) for k in (len(RULES), len(BASE)))
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = lambda x: f"array_to_string(list_transform(list_sort({x}), lambda x: {kinds}[x.kind + 1] || ':' || x.start || ':' || x.end), ',')"
    counts = ", ".join(f"len(s{n})::BIGINT AS n_{r.kind}" for n, r in enumerate(RULES))
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), a AS (SELECT doc_id, {', '.join(lists)} FROM d), b AS (SELECT doc_id, {', '.join(spans_)} FROM a) SELECT doc_id, {counts}, sha256({text(base)}) AS base_sha256, {text(every)} AS spans FROM b"


SQL = _sql()
