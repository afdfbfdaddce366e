"""Rows that share an id, or have none, stay and fall each by its own text."""

from __future__ import annotations

import random

import pytest

from sundew.llm import decontaminate, language, near_dups

SCHEMA = "doc_id long, text string, lang string, source string, tags map<string,string>"


def rows_of(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "s", {"a": "b"}) for i, t in pairs], SCHEMA)


def words(seed: int, n: int = 30) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def pairs_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_languages_are_kept_by_row(spark):
    lines = [(i, "the cat and the dog") for i in range(20)]
    mixed = [(None, "123 ..."), (None, "the dog"), (3, "???"), (3, "and the cat"), (None, None), (None, "the cat")]
    df = rows_of(spark, lines + mixed)
    kept = language.keep_identified(df, language.learned(df))
    assert kept.columns == df.columns
    assert pairs_of(kept) == sorted([*lines, (None, "the dog"), (None, "the cat"), (3, "and the cat")], key=repr)


@pytest.mark.parametrize("block", [100, 20_000])
def test_leaks_go_by_row(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = [words(100), words(101), words(102)]
    clean = [(None, words(1)), (7, words(2)), (None, None), (None, words(3)), (8, words(4))]
    df = rows_of(spark, [*clean, (None, "so " + items[0]), (7, items[1] + " end"), (8, items[2])])
    kept = decontaminate.decontaminate(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert kept.columns == df.columns and pairs_of(kept) == sorted(clean, key=repr)


def test_copies_go_by_row(spark):
    a, b, c, d = (words(i, 60) for i in range(4))
    near = a + " more"
    one_id = [(5, words(50 + i)) for i in range(20)]  # other texts under one id are all clean
    without = [(None, words(90 + i)) for i in range(20)]
    wordless = [(None, None), (None, None), (None, " "), (None, ""), (9, None)]
    copies = [(1, a), (1, b), (2, near), (2, c), (3, b), (None, c), (None, d), (None, d.upper()), (4, d), (1, a)]
    df = rows_of(spark, one_id + without + wordless + copies)
    want = sorted(one_id + without + wordless + [(1, a), (1, b), (2, c), (4, d)], key=repr)
    for parts in (1, 7):  # whichever way rows are dealt
        kept = near_dups.dedup(df.repartition(parts))
        assert kept.columns == df.columns and pairs_of(kept) == want
    made = near_dups.near_duplicates(df).where("n_shingles > 0").groupBy("doc_id", "component_id", "kept").count().collect()
    assert {(1, 1, True), (2, 1, False), (2, 2, True), (3, 1, False), (4, 4, True), (None, 2, False), (None, 4, False), (None, None, True), (5, 5, True)} == {tuple(r)[:3] for r in made}
