"""Nearest neighbours by collision counting over single projections (query-aware hashing, Huang et al., 2015).

Vectors are put on the unit sphere of one more dimension so that the largest inner product is the smallest distance. Each of
``M`` random projections sorts the vectors of a block. A query opens a window around its own projection in every sorted array
and widens it by virtual rehashing; a vector that falls into at least ``NEED`` windows is verified by its exact inner product.
A window is a range of ranks, so collisions are counted by comparing ranks with its ends, array by array. While fewer than k
vectors are verified, the radius grows to just below where the k-th by collisions is expected to reach NEED, and by ``C`` at
least; a query starts a little below where the one before it ended. With k verified the radius goes to ``REACH`` times the distance of the k-th best verified, and the query ends there: at that radius any nearer vector
is expected in more than ``M * (2 Phi(REACH) - 1)`` windows, and NEED lies ``SLACK`` standard deviations below. So collisions
alone decide what is verified; no number of candidates is fixed. The README has recall and the share verified.

Every row is indexed and every query (row of the stated set) meets every block: queries and vectors are dealt in blocks of
bounded size, a task holds one pair of blocks, and the k nearest of each pair are merged by a window over the query. Work is
queries times blocks, as a query set that grows with the table asks for; nothing is broadcast or collected.

Scores are inner products of the original vectors in double precision, summed in a fixed order. Ties go to the smaller vec_id.
Vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no part; vectors of another length than the
first found are an error. Repeated rows are rows: a query's own id is no candidate of it. With fewer candidates than k all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, inf, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_sorted_key, checkpoint, read_table

#: Projections (a count of collisions has a byte); least growth of the radius; first radius; distances that the last radius
#: reaches; slack of the threshold.
M, C, R0, REACH, SLACK = 255, 1.04, 1.0, 1.5, 0.7
NORMAL = NormalDist()
#: A difference of two vectors at distance d projects to d times a standard normal, so this share of windows holds it.
SHARE = 2 * NORMAL.cdf(REACH) - 1
#: Windows that must hold a vector, and the radius in distances at which so many are expected to.
NEED = ceil(M * SHARE - SLACK * sqrt(M * SHARE * (1 - SHARE)))
EXPECTED = NORMAL.inv_cdf((NEED / M + 1) / 2)
#: Rows of a block of vectors (a rank has two bytes), and of queries. Large blocks of vectors make few windows for each query.
VECTORS, QUERIES = 65_536, 1024
SEED = 7


def projections(dim: int, m: int = M) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((m, dim))


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each summed alike wherever its row is."""
    return (vectors * query).sum(axis=1)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query, ids, scores, verified) of the k best that each query finds among the vectors."""
    n, dim = vectors.shape
    a = projections(dim + 1)
    squares = (vectors * vectors).sum(1)
    norm = sqrt(squares.max()) * (1 + 1e-9)
    lift = np.sqrt(np.maximum(norm * norm - squares, 0))
    keys = a @ np.concatenate([vectors, lift[:, None]], 1).T / norm
    ranks = np.empty((M, n), np.uint16)
    for j in range(M):
        order = np.argsort(keys[j], kind="stable")
        keys[j] = keys[j, order]
        ranks[j, order] = np.arange(n, dtype=np.uint16)
    lengths = np.sqrt((queries * queries).sum(1))
    centres = a[:, :dim] @ (queries / lengths[:, None]).T
    # The arrays lie end to end, each moved up beyond the last, so that one search finds the windows of all.
    whole = max(np.abs(centres - keys[:, :1]).max(), np.abs(keys[:, -1:] - centres).max())
    gap = 4 * (np.abs(keys).max() + np.abs(centres).max() + whole)
    shift = np.arange(M) * gap
    keys += shift[:, None]
    flat, starts = keys.ravel(), np.arange(M) * n
    first = R0
    past, inside, hits = np.empty(n, np.uint16), np.empty(n, bool), np.empty(n, np.uint8)
    for i, (query_id, query) in enumerate(zip(query_ids.tolist(), queries, strict=True)):
        checked = np.zeros(n, bool)
        got_ids, got = np.zeros(0, np.int64), np.zeros(0)
        centre = centres[:, i] + shift
        radius = first
        while True:
            low, high = np.split(np.searchsorted(flat, np.concatenate([centre - radius, np.nextafter(centre + radius, np.inf)])), 2)
            hits[:] = 0
            for j in np.nonzero(high > low)[0].tolist():
                np.subtract(ranks[j], np.uint16(low[j] - starts[j]), out=past)  # wraps around for ranks below the window
                np.less_equal(past, np.uint16(high[j] - low[j] - 1), out=inside)
                np.add(hits, inside.view(np.uint8), out=hits)
            fresh = np.nonzero((hits >= NEED) & ~checked)[0]
            checked[fresh] = True
            fresh = fresh[ids[fresh] != query_id]
            got_ids, got = np.append(got_ids, ids[fresh]), np.append(got, exact_scores(vectors[fresh], query))
            if len(got) > k:
                best = np.lexsort((got_ids, -got))[:k]
                got_ids, got = got_ids[best], got[best]
            if len(got) == k:
                reach = REACH * sqrt(max(2 - 2 * got.min() / (norm * lengths[i]), 1e-12))
                if radius >= min(reach, whole):
                    break
                radius = reach
            elif radius >= whole:
                break
            else:
                share = min(max(int(np.partition(hits, n - min(n, k + 1))[n - min(n, k + 1)]), 1), M - 1) / M
                radius = max(radius * C, 0.94 * radius * EXPECTED / NORMAL.inv_cdf((share + 1) / 2))
        first = max(0.93 * radius, R0)
        best = np.lexsort((got_ids, -got))
        yield query_id, got_ids[best], got[best], int(checked.sum())


def usable(df: DataFrame) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k nearest rows of ``vectors`` (vec_id, embedding)."""
    held, asked = checkpoint(usable(vectors)), usable(queries)
    asked = checkpoint(asked)
    vb, qb = max(1, -(-held.count() // VECTORS)), max(1, -(-asked.count() // QUERIES))

    def dealt(df, own, blocks, other_blocks, query):
        other = F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1)))
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
        vb_, qb_ = (F.col("other"), F.col("mine")) if query else (F.col("mine"), F.col("other"))
        return df.select("vec_id", "v", mine.alias("mine"), other.alias("other")).select("vec_id", "v", F.lit(query).alias("query"), (vb_ * qb + qb_).cast("long").alias("pair"))

    rows = dealt(held, "v", vb, qb, False).unionAll(dealt(asked, "q", qb, vb, True))

    def search(table: pa.Table) -> Iterator[pa.RecordBatch]:
        is_query = table.column("query").to_numpy()
        ids = table.column("vec_id").to_numpy()
        flat = table.column("v").combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.lexsort((ids, is_query))  # the order in which rows came plays no part
        is_query, ids, x = is_query[order], ids[order], x[order]
        out = [[], [], []]
        if is_query.any() and not is_query.all():
            for query_id, got_ids, got, _ in search_block(ids[~is_query], x[~is_query], ids[is_query], x[is_query], k):
                out[0] += [query_id] * len(got)
                out[1] += got_ids.tolist()
                out[2] += got.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = by_sorted_key(rows, "pair", search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_collision_counting(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th row of ``embeddings``."""
    table = read_table(spark, sf_dir, "embeddings")
    return nearest(table, table.where(F.col("vec_id") % 20 == 0))
