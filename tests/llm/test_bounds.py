"""Sets that just fit into a sketch against partners that do not."""

from __future__ import annotations

import random

import pytest

from sundew.llm import near_dups

from .test_near_dups import brute


@pytest.mark.parametrize(("width", "percent"), [(5, 80), (3, 85)])
def test_sets_of_32_meet_larger_ones(spark, width, percent):
    rows, r = [], random.Random(percent)
    for n in (31, 32):
        for m in range(33, 41):
            for copy in range(12):
                long = [f"{r.random():.12f}" for _ in range(m + width - 1)]
                cut = (m - n) * (copy % 3) // 2  # words lack at the end, at both ends or at the start
                rows += [(len(rows), " ".join(long)), (len(rows) + 1, " ".join(long[cut : cut + n + width - 1]))]
    made = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
    want = {}
    for a in range(0, len(rows), 2):  # words of different pairs are different
        want |= brute(rows[a : a + 2], width, percent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in made.collect()} == want


@pytest.mark.parametrize(("width", "percent"), [(5, 80), (3, 85)])
def test_no_link_of_sets_around_the_sketch_is_lost(spark, width, percent):
    """Linked pairs of all sizes from 25 to 45: the larger set holds the smaller one, or each has words of its own."""
    rows, r = [], random.Random(1000 + percent)
    for n in range(25, 46):
        for m in range(n, 100 * n // percent + 1):
            for own in (0, 0, 1):
                long = [f"{r.random():.12f}" for _ in range(m + width - 1)]
                short = long[: n + width - 1]
                if own:
                    short[-1] = "other"
                rows += [(len(rows), " ".join(long)), (len(rows) + 1, " ".join(short))]
    made = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent)
    want = {}
    for a in range(0, len(rows), 2):
        want |= brute(rows[a : a + 2], width, percent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in made.collect()} == want
    assert sum(c != i for i, (_, c) in want.items()) >= 100


def test_least_shared_values_by_size():
    for percent, least in ((85, 27), (80, 24)):
        assert near_dups.shared_by_size(percent)[32] == least
        assert near_dups.shared_by_size(percent)[10] == -(-10 * percent // 100)
