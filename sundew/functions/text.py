"""Text predicates as null-free columns: terms, prefixes, wildcards, fuzzy terms, phrases, proximity, LIKE and token ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = "[^a-z0-9]+"


def holds(predicate: Column) -> Column:
    """A predicate without nulls: an unknown answer is no match, so that negation is the set complement."""
    return F.coalesce(predicate, F.lit(False))


def complement(predicate: Column) -> Column:
    """All rows but the matching ones; rows without a value are included."""
    return ~holds(predicate)


def tokens(text: Column | str) -> Column:
    """The lower-cased ASCII words of a text, in order."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(column), SEPARATORS), lambda t: t != "")


def localized(texts: Column | str, locales: list[str]) -> Column:
    """Texts of a map (locale to text) for the wanted locales or their languages."""
    column = F.col(texts) if isinstance(texts, str) else texts
    languages = {x.split("_")[0] for x in locales}
    return F.map_values(F.map_filter(column, lambda k, v: k.isin(*locales, *languages)))


def closest(texts: Column | str, locale: str, default: str = "en") -> Column:
    """The value of a map (locale to text) that is nearest to the locale: its own, its language's, another one of the same
    language, the default language's, else that of the first locale by name. Null for an empty map."""
    column = F.col(texts) if isinstance(texts, str) else texts
    language = locale.split("_")[0]

    def first(held: Column) -> Column:
        return F.get(F.array_sort(F.map_keys(held)), F.lit(0))

    kin = first(F.map_filter(column, lambda k, v: k.startswith(language + "_")))
    key = F.coalesce(*[F.when(F.map_contains_key(column, x), F.lit(x)) for x in (locale, language)], kin, F.when(F.map_contains_key(column, default), F.lit(default)), first(column))
    return F.element_at(column, key)


def term(held: Column, word: str) -> Column:
    return holds(F.array_contains(held, word.lower()))


def exact_term(text: Column | str, word: str) -> Column:
    """The word as it is written: no lower-casing, stemming or synonyms."""
    column = F.col(text) if isinstance(text, str) else text
    return holds(F.array_contains(F.split(column, r"[^\p{L}\p{N}]+"), word))


def any_term(held: Column, words: list[str]) -> Column:
    """OR of terms: a query term with its synonyms."""
    return holds(F.arrays_overlap(held, F.array(*[F.lit(w.lower()) for w in words])))


def prefix(held: Column, start: str) -> Column:
    return holds(F.exists(held, lambda t: t.startswith(start.lower())))


def wildcard_pattern(query: str) -> str:
    """A regular expression for ``*`` and ``?``; a backslash makes either literal."""
    out, at = [], 0
    while at < len(query):
        c = query[at]
        if c == "\\" and at + 1 < len(query):
            at += 1
            out.append(re.escape(query[at]))
        else:
            out.append({"*": ".*", "?": "."}.get(c) or re.escape(c))
        at += 1
    return "(?s)^" + "".join(out) + "$"


def wildcard(held: Column, query: str) -> Column:
    pattern = wildcard_pattern(query.lower())
    return holds(F.exists(held, lambda t: t.rlike(pattern)))


def wildcard_value(value: Column, query: str) -> Column:
    return holds(value.rlike(wildcard_pattern(query)))


def fuzzy(held: Column, word: str, similarity: float = 0.7) -> Column:
    """A token within the edit distance that the similarity leaves: floor((1 - similarity) * length), 2 at most."""
    most = min(2, int((1 - similarity) * len(word) + 1e-9))
    return holds(F.exists(held, lambda t: F.levenshtein(t, F.lit(word.lower())) <= most))


def bound(held: Column, make) -> Column:
    """``make`` of a value that is computed once: inside lambdas a column expression would be computed for every element."""
    return F.get(F.transform(F.array(held), make), 0)


def places(held: Column, word: str) -> Column:
    return F.filter(F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1))), lambda i: F.get(held, i - 1) == word.lower())


def phrase(held: Column, words: list[str], slop: int = 0) -> Column:
    """The words next to each other with at most ``slop`` other tokens among them: in order below a slop of 2, in any order from
    there on. A cheap conjunction of terms comes first."""
    return holds(bound(held, lambda h: _phrase(h, [w.lower() for w in words], slop)))


def _phrase(held: Column, words: list[str], slop: int) -> Column:
    cheap = term(held, words[0])
    for w in words[1:]:
        cheap = cheap & term(held, w)
    if slop < 2:
        # With one other token, it stands before one of the later words.
        runs = lambda p: [_run(held, words, p, gap) for gap in (range(1, len(words) + 1) if slop else (len(words),))]
        return cheap & F.exists(places(held, words[0]), lambda p: any_of(runs(p)))
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1))), lambda i: F.get(held, i - 1).isin(*words))
    need = {w: words.count(w) for w in words}
    return cheap & F.exists(starts, lambda p: bound(F.slice(held, p, len(words) + slop), lambda window: _holds_all(window, need)))


def any_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def _run(held: Column, words: list[str], at: Column, gap: int) -> Column:
    """The words from a place on, one token left out before the word of number ``gap``."""
    out = F.lit(True)
    for k, w in enumerate(words[1:], 1):
        out = out & (F.get(held, at - 1 + k + int(k >= gap)) == w)
    return holds(out)


def _holds_all(window: Column, need: dict[str, int]) -> Column:
    out = F.lit(True)
    for w, n in need.items():
        out = out & (F.array_contains(window, w) if n == 1 else F.size(F.filter(window, _equals(w))) >= n)
    return holds(out)


def _equals(word: str):
    return lambda t: t == word


def near(held: Column, first: str, then: str, most: int | None = None) -> Column:
    """``first * then``: in order, with at most ``most`` tokens between; any number for None."""
    gap = lambda p, q: (q > p) if most is None else (q > p) & (q - p - 1 <= most)
    both = lambda h: term(h, first) & term(h, then) & F.exists(places(h, first), lambda p: F.exists(places(h, then), lambda q: gap(p, q)))
    return holds(bound(held, both))


def first_token_range(held: Column, low: str | None, high: str | None, closed: tuple[bool, bool] = (True, True)) -> Column:
    head = F.get(held, 0)
    out = head.isNotNull()
    if low is not None:
        out = out & ((head >= low.lower()) if closed[0] else (head > low.lower()))
    if high is not None:
        out = out & ((head <= high.lower()) if closed[1] else (head < high.lower()))
    return holds(out)


def highlight(text: Column | str, words: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """The text with whole words marked, whatever their case."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(column, r"(?i)\b(" + "|".join(map(re.escape, words)) + r")\b", f"{before}$1{after}")


def snippet(text: Column | str, words: list[str], size: int = 100) -> Column:
    """The marked fragment of about ``size`` characters around the first match; null without one."""
    column = F.col(text) if isinstance(text, str) else text
    at = F.regexp_instr(F.lower(column), F.lit(r"\b(" + "|".join(re.escape(w.lower()) for w in words) + r")\b"))
    return F.when(at > 0, highlight(F.substring(column, F.greatest(at - size // 2, F.lit(1)), F.lit(size)), words))


def fragments(text: Column | str, words: list[str], size: int = 100, most: int = 1, merge: bool = False, before: str = "<em>", after: str = "</em>") -> Column:
    """The first ``most`` fragments of ``size`` characters that hold a word, marked; with ``merge`` neighbours are one. Words that
    a cut would split are found in neither fragment. Empty without a match."""
    column = F.col(text) if isinstance(text, str) else text
    pattern = r"(?i)\b(" + "|".join(map(re.escape, words)) + r")\b"

    def cut(t: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(t) / size).cast("int") - 1, F.lit(0))), lambda i: F.struct(i.alias("i"), F.substring(t, i * size + 1, F.lit(size)).alias("piece")))
        hit = F.filter(pieces, lambda x: x["piece"].rlike(pattern))
        if not merge:
            return F.transform(F.slice(hit, 1, most), lambda x: x["piece"])
        none = F.array().cast("array<struct<i:int,piece:string>>")

        def grow(acc: Column, x: Column) -> Column:
            last = F.get(acc, F.size(acc) - 1)
            joined = F.struct(x["i"].alias("i"), F.concat(last["piece"], x["piece"]).alias("piece"))
            return F.when((F.size(acc) > 0) & (last["i"] + 1 == x["i"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

        return F.transform(F.slice(F.aggregate(hit, none, grow), 1, most), lambda x: x["piece"])

    marked = lambda piece: F.regexp_replace(piece, pattern, f"{before}$1{after}")
    return F.when(column.rlike(pattern), F.transform(bound(column, cut), marked)).otherwise(F.array().cast("array<string>"))


def decode_names(column: Column) -> Column:
    """ISO 9075 path names: the escapes of blanks and leading digits that occur in site and tag names."""
    # The code points that occur escaped in such names.
    for code in (*range(0x20, 0x30), *range(0x30, 0x3A), 0x40):
        column = F.replace(column, F.lit(f"_x{code:04x}_"), F.lit(chr(code)))
    return column
