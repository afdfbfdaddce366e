from __future__ import annotations

import random

import pytest

from sundew.llm import near_dups

SCHEMA = "doc_id long, text string, lang string, source string, node string, component string"


def shingles(text, width):
    w = (text or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})).encode().split()
    if not w:
        return frozenset()
    width = min(width, len(w))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, width, percent):
    """rows: (id, text); id -> (n_shingles, component)."""
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed: int, n: int = 120):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(1, 4)))
    passage = [word() for _ in range(40)]
    base = [[word() for _ in range(r.choice([1, 2, 4, 10, 30, 60, 200]))] for _ in range(n // 3)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.2:
            w = passage + w
        rows.append((i, (" " if r.random() < 0.5 else "\n").join(x.upper() if r.random() < 0.1 else x for x in w)))
    return rows


@pytest.mark.parametrize(("width", "percent", "tile"), [(5, 80, 512), (3, 85, 4)])
def test_components_equal_brute_force(spark, monkeypatch, width, percent, tile):
    monkeypatch.setattr(near_dups, "TILE", tile)
    rows = corpus(width)
    made = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in made.collect()}
    want = brute(rows, width, percent)
    assert got == want
    assert len(set(got.values())) < len(rows)


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(50_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (5, "ONE two"), (9, long), (7, long + " more"), (None, "one two"), (None, None), (8, "other text that is alone here")]
    df = spark.createDataFrame([(*r, "en", "s", "x", "y") for r in rows], SCHEMA)
    made = near_dups.near_duplicates(df)
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in made.collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, 4, False), (8, 2, 8, True)} <= got
    assert {(7, 49_997, 7, True), (9, 49_996, 7, False)} <= got
    kept = near_dups.dedup(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 7, 8] and ids.count(None) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_dups.near_duplicates(df).count() == 0
    assert near_dups.dedup(df).columns == df.columns


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.op3_bottom_k(spark, sf_dir).collect()}
    assert got == brute(rows, 3, 85)


@pytest.mark.parametrize("short", [2, 16])
def test_lists_do_not_chain_classes_that_cannot_be_linked(spark, monkeypatch, short):
    """Each text is made of eight passages, each shared with another one of its neighbours; only planted copies are near."""
    monkeypatch.setattr(near_dups, "SHORT", short, raising=False)
    monkeypatch.setattr(near_dups, "BLOCK", 2, raising=False)
    r = random.Random(5)
    passage = lambda i, d: " ".join(f"p{i % 60}x{d}x{k}" for k in range(10))
    rows = [(i, " ".join(f"{passage(i, d)} {passage(i - d, d)}" for d in (1, 2, 3, 4))) for i in range(60)]
    rows += [(100 + i, rows[r.randrange(60)][1] + " end") for i in range(6)]
    rows += [(200 + i, " ".join(f"q{k}" for k in range(80)) + f" last{i}") for i in range(9)]
    made = near_dups.sketches(spark.createDataFrame(rows, "doc_id long, text string"), 3)
    near = near_dups.neighbourhoods(made.withColumnRenamed("rid", "node"), 85)
    sizes = {x["count"] for x in near.groupBy("component").count().collect()}
    got = {x.node: x.component for x in near.collect()}
    want = {i: c for i, (_, c) in brute(rows, 3, 85).items()}
    assert max(sizes) == 9 and len(got) <= 21
    assert all(got[i] == got[c] for i, c in want.items() if i != c)
