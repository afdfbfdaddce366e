"""Text analysis by locale: words of any script, word parts, stop words, light stems, and the choice of locales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_term, bound, fuzzy, holds, prefix, term, wildcard

#: The stop words of the standard English analyzer.
ENGLISH_STOP = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
#: Stop words by language; languages without an entry have none.
STOP = {
    "en": ENGLISH_STOP,
    "de": "aber als auf das dem den der des die ein eine er es in ist mit nicht sie und von zu".split(),
    "fr": "au aux ce de des du elle en et il la le les ne pas pour que qui sur un une".split(),
    "es": "al con de del el en es la las los no para por que se un una y".split(),
}
#: Endings that stems lose, by language; the longest first. A stem keeps three letters.
ENDINGS = {"en": ("ies", "es", "s"), "de": ("en", "er", "es", "e", "n"), "fr": ("es", "e", "s"), "es": ("es", "os", "as", "o", "a", "s")}
#: How query locales widen: the locale alone, its language too, and texts of no locale.
MODES = {"LOCALE_ONLY": (True, False, False), "LOCALE_AND_LANGUAGE": (True, True, False), "LOCALE_AND_ALL": (True, True, True), "ALL_ONLY": (False, False, True)}


def words(text: Column | str) -> Column:
    """The lower-cased words of a text in any script."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def word_parts(text: Column | str) -> Column:
    """Words cut at changes of case and between letters and digits, lower-cased: ``PowerShot500`` is power, shot, 500."""
    column = F.col(text) if isinstance(text, str) else text
    cut = F.regexp_replace(column, r"(\p{Ll})(\p{Lu})|(\p{L})(?=\p{N})|(\p{N})(?=\p{L})", "$1$3$4 $2")
    return words(cut)


def without_stops(held: Column, language: str) -> Column:
    stops = STOP.get(language)
    return F.filter(held, lambda t: ~t.isin(*stops)) if stops else held


def stems(held: Column, language: str) -> Column:
    ends = ENDINGS.get(language)
    return F.transform(held, lambda t: F.regexp_replace(t, "^(.{3,}?)(?:" + "|".join(ends) + ")$", "$1")) if ends else held


def analyzed(text: Column | str, locale: Column) -> Column:
    """Words of a text without stop words, as stems, by the analyzer of each row's locale; plain words for other locales."""
    language = F.lower(F.substring_index(locale, "_", 1))

    def by_language(held: Column) -> Column:
        out = held
        for name in sorted(set(STOP) | set(ENDINGS)):
            out = F.when(language == name, stems(without_stops(held, name), name)).otherwise(out)
        return out

    return bound(words(text), by_language)


def query_locales(locale: str, mode: str) -> list[str]:
    """The keys of multi-language texts that a query of a locale reads."""
    own, kin, all_ = MODES[mode]
    return [*([locale] if own else []), *([locale.split("_")[0]] if kin and "_" in locale else []), *([""] if all_ else [])]


def texts_for(texts: Column | str, locale: str, mode: str) -> Column:
    """Values of a map (locale to text) under those keys."""
    column = F.col(texts) if isinstance(texts, str) else texts
    keys = query_locales(locale, mode)
    return F.map_values(F.map_filter(column, lambda k, v: k.isin(*keys)))


def property_term(value: Column, held: Column, word: str, mode: str) -> Column:
    """A term of a property by analysis mode: its words (DEFAULT, TOKENISE), its value (IDENTIFIER), or an expansion of words."""
    makes = {
        "DEFAULT": lambda: term(held, word),
        "TOKENISE": lambda: term(held, word),
        "IDENTIFIER": lambda: holds(value == word),
        "FUZZY": lambda: fuzzy(held, word),
        "PREFIX": lambda: prefix(held, word),
        "WILD": lambda: wildcard(held, word),
        "LIKE": lambda: holds(value.like(word)),
    }
    return makes[mode]()


def template(fields: dict[str, Column], pattern: str, words_: list[str]) -> Column:
    """A named query template such as ``%(name OR brand)`` or ``%(name AND brand)``: the words in any or all of its fields."""
    inside = pattern.removeprefix("%(").removesuffix(")")
    every = " AND " in inside
    names = inside.replace(" AND ", " ").replace(" OR ", " ").split()
    parts = [any_term(fields[n], words_) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if every else out | p
    return out


def cased_equals(value: Column, function: str, literal: str) -> Column:
    """``UPPER(p) = literal`` or ``LOWER(p) = literal``; a literal of the wrong case matches nothing."""
    make, right = (F.upper, literal.upper()) if function == "UPPER" else (F.lower, literal.lower())
    return holds(make(value) == literal) if literal == right else F.lit(False)
