"""Relevance, ordering, paging, re-ranking, suggestions and similarity."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .batches import map_arrow
from .places import checkpoint, positions


def bm25(nodes: DataFrame, key: str, held: Column, words: list[str], k1: float = 1.2, b: float = 0.75, boosts: dict[str, float] | None = None) -> DataFrame:
    """key, score of the nodes with one of the words; a boosted word counts that many times. Collection figures are one aggregate over the nodes, joined as one row."""
    rows = nodes.select(key, held.alias("__t"))
    for n, w in enumerate(words):
        rows = rows.withColumn(f"__tf{n}", F.size(F.array_remove(F.transform("__t", _is(w)), False)))
    rows = rows.withColumn("__dl", F.size("__t")).drop("__t")
    total = rows.agg(F.count("*").alias("__n"), F.avg("__dl").alias("__avg"), *[F.count_if(F.col(f"__tf{n}") > 0).alias(f"__df{n}") for n in range(len(words))])
    scored = rows.join(F.broadcast(total))  # one row
    score = F.lit(0.0)
    for n in range(len(words)):
        tf, df = F.col(f"__tf{n}"), F.col(f"__df{n}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        idf = idf * (boosts or {}).get(words[n], 1.0)
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("__dl") / F.col("__avg")))).otherwise(0.0)
    return scored.select(key, score.alias("score")).where("score > 0")


def _is(word: str):
    return lambda t: t == word


def top(scored: DataFrame, key: str, n: int, start: int = 0) -> DataFrame:
    """The page of best rows; ties by key."""
    return scored.orderBy(F.desc("score"), key).offset(start).limit(n)


def page(df: DataFrame, *order, start: int = 0, rows: int = 10) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(min(rows, 1_000_000))


def collated(column: Column, locale: str) -> Column:
    """A sort key in the locale's order; nulls come first ascending and last descending."""
    return F.collate(column, locale)


def rerank(scored: DataFrame, second: DataFrame, key: str, docs: int = 200, weight: float = 2.0, scale: bool = False, elevated: list[int] | None = None, start: int = 0, rows: int = 0) -> DataFrame:
    """key, score, place. The first ``docs`` rows by score, or as many as the page ``start`` + ``rows`` reaches, get ``score + weight * second`` where the second query matches and
    are ordered anew; the rest keep their order behind them. ``scale``: scores are shares of the best, plus 1 if changed.
    Elevated keys come first, in their order."""
    # Scores are worked out once: the head is cut from the places, and neither part asks for the texts again.
    ranked = checkpoint(positions(scored, F.desc("score"), F.col(key), name="__place"))
    head = ranked.where(F.col("__place") < max(docs, start + rows)).drop("__place").withColumn("__head", F.lit(True))
    rest = ranked.where(F.col("__place") >= max(docs, start + rows)).drop("__place").withColumn("__head", F.lit(False))
    boost = second.select(key, F.col("score").alias("__second"))
    head = head.join(boost, key, "left")
    score = F.col("score") + weight * F.coalesce("__second", F.lit(0.0))
    if scale:
        best = head.agg(F.max("score").alias("__most"))
        head = head.join(F.broadcast(best))  # one row
        share = F.col("score") / F.col("__most")
        score = F.when(F.col("__second").isNotNull(), 1 + F.least(F.lit(1.0), share * (1 + F.col("__second")) / (1 + weight))).otherwise(share)
    both = head.select(key, score.alias("score"), "__head").unionByName(rest.select(key, "score", "__head"))
    raised = F.coalesce(F.array_position(F.array(*map(F.lit, elevated)), F.col(key)), F.lit(0)) if elevated else F.lit(0)
    both = both.withColumn("__raised", F.when(raised > 0, raised).otherwise(1 << 30))
    placed = positions(both, F.col("__raised"), F.desc("__head"), F.desc("score"), F.col(key), name="place")
    return placed.select(key, "score", (F.col("place") + 1).cast("int").alias("place"))


def ordered(scored: DataFrame, second: DataFrame, key: str, sort: list | None = None, **options) -> DataFrame:
    """A result in the order asked for; a second query plays no part where there is a sort."""
    if sort:
        return positions(scored, *sort, name="place").select(key, "score", (F.col("place") + 1).cast("int").alias("place"))
    return rerank(scored, second, key, **options)


def recency(scored: DataFrame, at: Column, now: Column, decay: float = 3.16e-11, weight: float = 3.0) -> DataFrame:
    """Adds ``weight / (decay * age in ms + 1)`` to the score."""
    age = (F.unix_millis(now.cast("timestamp")) - F.unix_millis(at.cast("timestamp"))).cast("double")
    return scored.withColumn("score", F.col("score") + weight / (decay * age + 1))


def spellings(vocabulary: DataFrame, word: str, most: int = 2, prefix: int = 1, n: int = 5, accuracy: float = 0.0) -> DataFrame:
    """term, df, distance: corrections that share the first letter, nearest first, then the more frequent. ``accuracy``: the least
    similarity, 1 - distance / the longer length."""
    near = vocabulary.where((F.length("term") >= 4) & F.col("term").startswith(word[:prefix]) & (F.col("term") != word))
    near = near.withColumn("distance", F.levenshtein("term", F.lit(word), most)).where("distance >= 0")
    near = near.where(1 - F.col("distance") / F.greatest(F.length("term"), F.lit(len(word))) >= accuracy)
    return near.orderBy("distance", F.desc("df"), "term").limit(n)


def collations(nodes: DataFrame, held: Column, words: list[str], corrections: DataFrame, at: int) -> DataFrame:
    """term, hits: for each correction of the word number ``at`` how many of the filtered nodes hold all words then; those
    without a hit are no collation. Nodes are filtered by the other words first, and corrections are a short list."""
    rows = nodes.select(F.array_distinct(held).alias("__t"))
    for w in (w for i, w in enumerate(words) if i != at):
        rows = rows.where(F.array_contains("__t", w))
    found = rows.select(F.explode("__t").alias("term")).join(corrections.select("term"), "term", "left_semi")
    return found.groupBy("term").agg(F.count("*").alias("hits"))


def word_breaks(vocabulary: DataFrame, word: str) -> DataFrame:
    """left, right: splits of a word into two terms of the vocabulary."""
    cuts = vocabulary.sparkSession.createDataFrame([(word[:i], word[i:]) for i in range(1, len(word))], "left string, right string")
    return cuts.join(vocabulary.select(F.col("term").alias("left")), "left", "left_semi").join(vocabulary.select(F.col("term").alias("right")), "right", "left_semi")


def suggestions(weighted: DataFrame, prefix: str, n: int = 5) -> DataFrame:
    """term, weight of the n heaviest completions."""
    return weighted.where(F.col("term").startswith(prefix)).orderBy(F.desc("weight"), "term").limit(n)


def more_like(nodes: DataFrame, key: str, held: Column, of: int, terms: int = 10, n: int = 10) -> DataFrame:
    """key, score of the nodes that share the most telling terms (tf * idf over all nodes) of one node. Its terms, which fit into a
    row, are broadcast, so that of the other nodes only pairs with one of them are shuffled."""
    total = nodes.count()
    mine = nodes.where(F.col(key) == of).select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("my_tf"))
    rows = nodes.select(key, F.explode(F.array_distinct(held)).alias("term"))
    # Several rows may have one key.
    df = rows.join(F.broadcast(mine.select("term")), "term", "left_semi").distinct().groupBy("term").agg(F.count("*").alias("df"))
    best = mine.join(df, "term").withColumn("w", F.col("my_tf") * F.log(F.lit(1.0) + F.lit(float(total)) / F.col("df"))).orderBy(F.desc("w"), "term").limit(terms)
    hits = rows.where(F.col(key) != of).join(F.broadcast(best.select("term", "w")), "term").distinct()
    return hits.groupBy(key).agg(F.round(F.sum("w"), 6).alias("score")).orderBy(F.desc("score"), key).limit(n)


#: Hash functions of a fingerprint: (a * h + b) mod P.
P, FUNCTIONS = (1 << 31) - 1, 16
#: Shingles that a task hashes at a time.
PART = 4096


def coefficients(i: int) -> tuple[int, int]:
    return (i * 7919 + 104729) % P, (i * 15485863 + 1299709) % P


def term_vector(nodes: DataFrame, key: str, held: Column, of: int) -> DataFrame:
    """term, tf, positions of one node."""
    rows = nodes.where(F.col(key) == of).select(F.posexplode(held).alias("at", "term"))
    return rows.groupBy("term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))


#: A word's pairs of neighbours are counted in so many parts, by their hashes, so that a frequent word is no task of its own.
PARTS = 16
#: What separates words, as in ``functions.text.tokens``, becomes a blank; so do the bytes of letters beyond ASCII.
_BLANKS = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, key (of the term's hash and the part), contexts: hashes of the pairs of neighbours in a batch of lower-cased texts,
    8 bytes each."""
    for batch in batches:
        codes: defaultdict[bytes, int] = defaultdict()
        codes.default_factory = codes.__len__
        rows = [np.array([codes[b""]])]  # stands before and after each text
        for text in batch.column(0).to_pylist():
            if found := text.encode("utf-8", "replace").translate(_BLANKS).split() if text else []:
                rows += [np.fromiter(map(codes.__getitem__, found), np.int64, len(found)), rows[0]]
        code = np.concatenate(rows)
        at = np.nonzero(code)[0]
        if not len(at):
            continue
        digest = np.frombuffer(b"".join([blake2b(w, digest_size=8).digest() for w in codes]), "<u8")
        pair = digest[code[at - 1]] * _M1 + digest[code[at + 1]]
        pair = (pair ^ (pair >> np.uint64(29))) * _M2
        pair ^= pair >> np.uint64(32)
        group = code[at] * PARTS + (pair % np.uint64(PARTS)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        group, pair = group[order], pair[order]
        edges = np.append(np.nonzero(np.diff(group, prepend=-1))[0], len(group)).astype(np.int32)
        held = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges * np.int32(8)), pa.py_buffer(pair)])
        group = group[edges[:-1]]
        terms = pa.array(list(codes), pa.string()).take(pa.array(group // PARTS))
        key = digest[group // PARTS] // np.uint64(PARTS) * np.uint64(PARTS) + (group % PARTS).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([terms, pa.array(key.view(np.int64)), held], ["term", "key", "contexts"])


def _different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """term, n: different contexts of each key, from rows sorted by it. The last key of a batch may go on in the next."""

    def made(terms, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([terms, pa.array(n, pa.int64())], ["term", "n"])

    last, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        terms, key = batch.column(0), batch.column(1).to_numpy()
        if last and last[1] != key[0]:
            yield made(last[0], [len(held)])
            held = held[:0]
        new = np.append(True, key[1:] != key[:-1])
        group = np.append(np.zeros(len(held), np.int64), np.repeat(np.cumsum(new) - 1, pc.binary_length(batch.column(2)).to_numpy() // 8))
        pair = np.append(held, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64))
        mixed = pair + group.astype(np.uint64) * _M1  # as telling as the hashes
        order = np.argsort(mixed)
        mixed = mixed[order]
        order = order[np.append(True, mixed[1:] != mixed[:-1])]
        n = np.bincount(group[order])
        yield made(terms.take(pa.array(np.nonzero(new)[0][:-1])), n[:-1])
        last, held = (pa.array([terms[-1].as_py()]), key[-1]), pair[order[group[order] == len(n) - 1]]
    if last:
        yield made(last[0], [len(held)])


def word_contexts(nodes: DataFrame, text: Column) -> DataFrame:
    """term, contexts: how many different pairs of neighbours a word stands between. Words and pairs are told apart by hashes of 60
    and 64 bits, in tasks, which send a row for each word and part of a batch of texts instead of one for each pair."""
    pairs = map_arrow(nodes.select(F.lower(text).alias("text")), _contexts, "term string, key long, contexts binary")
    dealt = pairs.repartition("key").sortWithinPartitions("key")
    return map_arrow(dealt, _different, "term string, n long").groupBy("term").agg(F.sum("n").alias("contexts"))


def fingerprints(nodes: DataFrame, key: str, held: Column, width: int = 5) -> DataFrame:
    """key, signature: minima of hashed word shingles; nodes with fewer words have none. A node's row holds all its words, so
    nothing is shuffled; the hashes of its shingles are worked out together."""
    a, b = (np.array(x)[:, None] for x in zip(*map(coefficients, range(FUNCTIONS)), strict=True))

    def signature(words: str) -> list[int] | None:
        found = words.encode().split(b"\0") if words else []
        if len(found) < width:
            return None
        least = np.full((FUNCTIONS, 1), P)
        for at in range(0, len(found) - width + 1, PART):  # repeated shingles do not change minima
            part = found[at : at + PART + width - 1]
            digests = b"".join([md5(b" ".join(s)).digest() for s in zip(*(part[i:] for i in range(width)), strict=False)])
            h = (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64) % P  # the first 15 hexadecimal digits
            least = np.minimum(least, ((h * a + b) % P).min(1, keepdims=True))
        return least[:, 0].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([None if x is None else signature(x) for x in batch.column(1).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], [key, "signature"])

    schema = StructType([nodes.schema[key], StructField("signature", ArrayType(LongType()))])
    return map_arrow(nodes.select(key, F.array_join(held, "\0").alias("words")), run, schema).where("signature IS NOT NULL")


def one_node(nodes: DataFrame, key: str, wanted: str) -> DataFrame:
    """The node of a number or a reference, of which there has to be exactly one."""
    found = nodes.where(F.col(key) == int(wanted)) if wanted.isdigit() else nodes.where(F.col("reference") == wanted)
    n = found.limit(2).count()
    if n != 1:
        raise ValueError(f"{wanted} names {'no node' if not n else 'several nodes'}")
    return found


def similar(prints: DataFrame, key: str, of: int, similarity: float, its: DataFrame | None = None) -> DataFrame:
    """key, matches: nodes that agree with one node in ``ceil(n * similarity)`` places or more. ``its``: prints made of that node
    alone, as a filter on the key does not pass the Python step and all prints would be made twice."""
    mine = (prints if its is None else its).where(F.col(key) == of).select(F.col("signature").alias("mine"))
    same = F.size(F.array_remove(F.zip_with("signature", "mine", lambda a, b: a == b), False))
    return prints.join(F.broadcast(mine)).select(key, same.alias("matches")).where(F.col("matches") >= math.ceil(FUNCTIONS * similarity))  # one row


def bands(n: int, similarity: float, probability: float) -> tuple[int, int]:
    """(bands, rows of each): the fewest bands of n // bands rows that find a pair so similar with more than the probability."""
    for b in range(1, n + 1):
        if 1 - (1 - similarity ** (n // b)) ** b > probability:
            return b, n // b
    return 1, n


def band_matches(prints: DataFrame, key: str, of: int, similarity: float, probability: float, its: DataFrame | None = None) -> DataFrame:
    """key of the nodes that agree with one node in all rows of some band. A short last band is filled up from the start.
    ``its`` as in ``similar``."""
    count, rows = bands(FUNCTIONS, similarity, probability)
    starts = list(range(0, FUNCTIONS, rows))[:count]
    keyed = F.array(*[F.concat_ws(",", *[F.get("signature", F.lit((s + r) % FUNCTIONS)) for r in range(rows)]) for s in starts])
    banded = lambda p: p.select(key, F.posexplode(keyed).alias("band", "value"))
    held = banded(prints)
    mine = banded((prints if its is None else its).where(F.col(key) == of)).select("band", "value")  # FUNCTIONS rows at most
    return held.join(F.broadcast(mine), ["band", "value"], "left_semi").select(key).distinct()
