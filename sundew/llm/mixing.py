"""Mixing sources to target weights by the cube method.

Every source gets a share of the words by weight; a row is taken ``floor(r)`` times for sure and once more with
probability ``r - floor(r)``, ``r`` being its source's target over its size. Which rows get the extra copy is drawn by the
cube method (Deville and Tille, 2004): the vector of probabilities moves through the null space of the balancing
constraints, here the numbers of documents and of words, until nearly all entries are 0 or 1. A move drives the longest open
unit and lets all shorter ones of the block give way a little, so long units are settled while there is room and the shortest
stay open. The flight runs in blocks of bounded size for each source, what a block leaves open (two units at most) flies again
with that of other blocks, and the last block of a source lands: the document total is given up first, then the word total
for its last unit, which is drawn. Every step keeps the expectation, so every unit keeps its probability.

Nulls: a null text has size 0; a null source is a source of its own, after all others; a null ``doc_id`` is an id like any
other. Rows alike in id, source and size are one unit and get the same number of copies. Empty input gives empty output.
Sizes of 0 are drawn like others and take no words. Columns of the input are kept whatever their names are.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.places import running_sums
from .common import WORD, checkpoint, positions, read_table

#: Units in one flight.
BLOCK = 1024
EPS = 1e-9


def _plane(lead: int, rest: np.ndarray, p: np.ndarray, balance: np.ndarray) -> np.ndarray | None:
    """How the units ``rest`` move when ``lead`` moves by 1 and the totals (rows of ``balance``) stay: each in proportion to
    its room, and to a plane over its count and size. None where the totals leave no such move."""
    room = np.minimum(p[rest], 1 - p[rest])
    held = balance[:, rest]
    plane = held * room
    found = np.linalg.lstsq(plane @ held.T, -balance[:, lead], rcond=1e-12)[0]
    move = found @ plane
    missed = np.abs(held @ move + balance[:, lead])
    return move if (missed <= 1e-7 * (1 + np.abs(balance[:, lead]))).all() else None


def _split_move(lead: int, rest: np.ndarray, p: np.ndarray, balance: np.ndarray) -> np.ndarray | None:
    """A move that keeps both totals and takes the same share of every unit's room: the longer ones against the lead, the
    shorter ones with it."""
    room = np.minimum(p[rest], 1 - p[rest])
    g = room * (balance[1, rest] * balance[0, lead] - balance[0, rest] * balance[1, lead])
    off = 2 * np.cumsum(g) - g.sum()
    turn = np.nonzero(np.sign(off) != np.sign(-g.sum()))[0] if len(g) and g.sum() else []
    if not len(turn) or not g[turn[0]]:
        return None
    k = turn[0]
    w = np.where(np.arange(len(rest)) < k, 1.0, -1.0)
    w[k] = (g.sum() - g[k] - 2 * g[:k].sum()) / g[k]
    length = (w * room) @ balance[1, rest]
    return -w * room * (balance[1, lead] / length) if length > 0 else None


def _direction(lead: int, rest: np.ndarray, p: np.ndarray, balance: np.ndarray, land: bool) -> np.ndarray | None:
    """The move that drives ``lead``: the first of those below that has room to settle it; where the block lands, a unit so
    long that only giving up the document total leaves room does so. Without any room the first goes as far as it can."""
    first = _plane(lead, rest, p, balance)
    if len(balance) < 2 or first is None:
        return first
    room, far = np.minimum(p[rest], 1 - p[rest]), max(p[lead], 1 - p[lead])
    makes = (lambda: first, lambda: _split_move(lead, rest, p, balance), lambda: -room * (balance[1, lead] / max(room @ balance[1, rest], 1e-300)))
    for make in makes[: 2 + land]:
        move = make()
        if move is not None and (np.abs(move) * far <= room * (1 + 1e-9)).all():
            return move
    return first


def fly(start: list[float], count: list[float], size: list[float], seed: int, land: bool) -> list[float]:
    """The cube method's flight, and with ``land`` its landing, over one block, whose units come longest first. start:
    probabilities; the result has 0s and 1s, and without ``land`` up to two others."""
    rng = np.random.default_rng(seed)
    p = np.array(start, float)
    balance = np.array([count, size], float)
    balance /= np.maximum(np.abs(balance).max(axis=1, initial=0.0), 1e-300)[:, None]
    open_ = np.nonzero((p > EPS) & (p < 1 - EPS))[0]
    keep = 2  # totals that moves keep: words and documents, then words, then none
    while len(open_):
        rows = balance[2 - keep :]
        move = _direction(open_[0], open_[1:], p, rows, land) if keep else np.zeros(len(open_) - 1)
        if move is None:
            # The longest cannot move on its own; the others may still, down to as many as there are totals.
            if len(open_) > keep:
                move, last = next(((m, i) for i in range(1, len(open_) - keep + 1) if (m := _direction(open_[i], open_[i + 1 :], p, rows, land)) is not None), (None, 0))
                if move is not None:
                    move = np.concatenate([np.zeros(last - 1), [1.0], move])
                    lead = 0.0
            if move is None:
                if not land:
                    break
                keep -= 1
                continue
        else:
            lead = 1.0
        u = np.concatenate([[lead], move])
        at = p[open_]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - at) / u, np.where(u < 0, -at / u, np.inf)).min()
            down = np.where(u > 0, at / u, np.where(u < 0, (at - 1) / u, np.inf)).min()
        p[open_] = at + (up if rng.random() * (up + down) < down else -down) * u
        p[open_] = np.where(p[open_] < EPS, 0.0, np.where(p[open_] > 1 - EPS, 1.0, p[open_]))
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    return p.tolist()


def _flight(level: int, seed: int):
    def run(table: pa.Table) -> pa.Table:
        words = pc.multiply(table.column("__size"), table.column("__n"))
        table = table.take(pc.sort_indices(pa.table({"words": words, "order": table.column("__order")}), [("words", "descending"), ("order", "ascending")]))
        first = table.slice(0, 1).to_pylist()[0]
        key = f"{seed}:{level}:{first['__source']}:{first['__block']}"
        n = table.column("__n").to_numpy().astype(float)
        p = fly(table.column("__p").to_pylist(), n.tolist(), (n * table.column("__size").to_numpy()).tolist(), xxhash.xxh64_intdigest(key), first["__blocks"] == 1)
        return table.set_column(table.schema.get_field_index("__p"), "__p", pa.array(p, pa.float64()))

    return run


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds ``__target`` to (``__source``, ``__source_size``): ``share`` of all sizes dealt by weight, no target above
    ``cap`` times its source. Sources fill up in the order of cap over weight; running sums over that order say where
    filling stops, so one pass finds the level, however many sources reach their caps."""
    ranked = checkpoint(positions(sources, F.col("__source").asc_nulls_last(), name="__rank"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("__rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__weight", weight).withColumn("__most", F.lit(float(cap)) * F.col("__source_size")).withColumn("__full", F.col("__most") / F.col("__weight"))
    total, weighed = ranked.agg(F.sum("__source_size"), F.sum("__weight")).first()
    total, weighed = (total or 0) * share, weighed or 1.0
    summed = running_sums(ranked, {"__m": F.col("__most"), "__w": F.col("__weight")}, F.col("__full"), F.col("__source").asc_nulls_last())
    free = F.lit(weighed) - F.col("__w")
    # Sources whose caps are reached before the total is spent; the last of them says what is left for how much weight.
    reached = summed.where(F.col("__m") + F.col("__full") * free < total * (1 - 1e-12))
    last = reached.agg(F.max(F.struct("__w", "__m"))).first()[0]
    left, of = (total - last["__m"], weighed - last["__w"]) if last else (total, weighed)
    level = left / of if of > 1e-9 else float("inf")
    return ranked.withColumn("__target", F.least("__most", F.lit(level) * F.col("__weight"))).drop("__rank", "__weight", "__most", "__full")


def decisions(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 1) -> DataFrame:
    """One row for each unit of ``docs`` (doc_id, text, source): __doc_id, __source, __size, __n (its rows), __source_size,
    __target, __copies. The same rows give the same decisions, however they are dealt."""
    sized = docs.select(F.col("doc_id").alias("__doc_id"), F.col("source").alias("__source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("__size"))
    units = checkpoint(sized.groupBy("__doc_id", "__source", "__size").agg(F.count("*").alias("__n")))
    sources = units.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__n")).alias("__source_size"), F.count("*").alias("__units"))
    aimed = checkpoint(targets(sources, weights, share, cap))
    ratio = F.when(F.col("__source_size") > 0, F.least(F.lit(float(cap)), F.col("__target") / F.col("__source_size"))).otherwise(0.0)
    aimed = aimed.withColumn("__base", F.floor(ratio + EPS)).withColumn("__p", F.greatest(F.lit(0.0), ratio - F.col("__base"))).withColumnRenamed("__source", "__s")
    every = units.join(aimed, units["__source"].eqNullSafe(aimed["__s"])).drop("__s")
    every = every.withColumn("__p", F.when(F.col("__p") < EPS, 0.0).otherwise(F.col("__p"))).withColumn("__order", F.xxhash64(F.lit(seed), "__doc_id", "__source", "__size"))
    most = aimed.agg(F.max("__units")).first()[0] or 0
    done, open_, level = [], every.withColumn("__left", F.col("__units")), 0
    while True:
        blocks = F.ceil(F.col("__left") / BLOCK).cast("long")
        held = open_.withColumn("__blocks", blocks).withColumn("__block", F.pmod(F.xxhash64(F.lit(level), "__order"), F.col("__blocks")))
        flown = checkpoint(held.groupBy("__source", "__block").applyInArrow(_flight(level, seed), held.schema))
        still = (F.col("__p") > 0) & (F.col("__p") < 1)
        done.append(flown.where(~still).drop("__blocks", "__block", "__left"))
        if most <= BLOCK:
            break
        most = 2 * -(-most // BLOCK)
        open_ = flown.where(still).withColumn("__left", 2 * F.col("__blocks")).drop("__blocks", "__block")
        level += 1
    all_ = reduce(DataFrame.unionByName, done)
    return all_.select("__doc_id", "__source", "__size", "__n", "__source_size", "__target", (F.col("__base") + F.col("__p")).cast("int").alias("__copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them (0 to ``cap`` times), with the columns they had.

    Decisions are made on narrow rows and joined back, one for each unit, so a hot source or id only lengthens the side
    that Spark can split.
    """
    taken = decisions(docs, **options).where("__copies > 0")
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("__z"))
    joined = rows.join(taken, F.col("__d").eqNullSafe(F.col("__doc_id")) & F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__z") == F.col("__size")))
    return joined.select("__row", F.explode(F.array_repeat(F.lit(0), F.col("__copies")))).select("__row.*")


def op1_cube_mix(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the words that the mix takes from it."""
    made = decisions(read_table(spark, sf_dir, "documents"))
    rows = made.withColumn("__each", F.explode(F.array_repeat(F.lit(0), F.col("__n").cast("int"))))
    return rows.select(F.col("__doc_id").alias("doc_id"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).cast("long").alias("taken"), F.col("__copies").alias("copies"))
