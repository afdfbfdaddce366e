"""Near-duplicate documents by bottom-k sketches from one hash function.

1. A text becomes the set of hashes of its word shingles; texts with equal sets form a class and travel as one from here.
2. A class keeps its k smallest hashes. The document frequency of every retained value orders them; two classes above the
   similarity share at least ``need`` of their retained values, so they meet in the inverted list of one of the
   ``k - need + 1`` rarest (prefix filtering). Common passages therefore make no lists, unless they are most of a text.
   For sets that fit into the sketch ``need`` is exact, larger partners included (``shared_by_size``); else the chance that
   a linked pair shares less is below 1e-7.
3. Members of a list whose sizes and sketches, as bitmaps that never show less than two sketches share, can belong to a link
   are joined; connected components of these are neighbourhoods. Large tables hold many words in the same order by chance, so
   lists alone would chain most classes into one. Short lists are joined with themselves, long ones are dealt into blocks.
   Inside a neighbourhood inverted lists of retained values count overlaps, the estimate on the union's sketch filters,
   and the exact Jaccard similarity of the full sets decides. A large neighbourhood is dealt into tiles of bounded size
   that together see every pair; a tile returns a spanning forest of the links it finds.
4. Components of the links are the groups; the smallest ``doc_id`` of each stays.

Texts without words, or null, link with nothing. Rows with a null ``doc_id`` take part under a stand-in above all ids: they
are kept only where a group has no id, and ``component_id`` is null there. Rows are told apart by id and text, so rows with the
same ``doc_id`` link, stay and fall each by its own text. Empty tables give empty results. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, WordHashes, by_sorted_key, checkpoint, components, map_arrow, read_table, shingle_set, slices, words

#: Values that a sketch retains.
K = 32
#: Chance that a linked pair of large sets shares less than ``need`` retained values.
MISS = 1e-7
#: Classes of one tile's side.
TILE = 512
#: Bits of a sketch's bitmap; members of a list that is joined with itself; members of a block of longer lists.
BITS, SHORT, BLOCK = 256, 16, 2048
#: Stand-ins for null ids start here.
STAND_IN = 1 << 62


def least_shared(similarity: float, k: int = K, miss: float = MISS) -> int:
    """The largest number of common retained values that a linked pair reaches but for a chance of ``miss``."""
    below = 0.0
    for i in range(k):
        below += math.comb(k, i) * similarity**i * (1 - similarity) ** (k - i)
        if below > miss:
            return max(1, i)
    return k


def shared_by_size(percent: int, k: int = K) -> list[int]:
    """For sets of 0 to ``k`` shingles, the least number of retained values that they share with a linked partner. A partner of
    m > k shingles retains k of them, and all its m - common others may be among those."""
    out = [0]
    for n in range(1, k + 1):
        least = -(-n * percent // 100)
        for m in range(k + 1, 100 * n // percent + 1):
            common = -(-percent * (n + m) // (100 + percent))
            least = min(least, common - (m - k))
        out.append(max(1, least))
    return out


def row_id() -> Column:
    """doc_id, or for null a stand-in from the text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(STAND_IN) + F.xxhash64("text").bitwiseAND(F.lit(STAND_IN - 1)))


def row_hash() -> Column:
    """A second hash of the text, independent of the stand-in; with ``row_id`` it names a row but for exact copies."""
    return F.xxhash64(F.lit(1), F.col("text").cast("string"))


def _hash128(values: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(values.tobytes())


def bitmap(sketch: np.ndarray) -> list[int]:
    """A sketch's values as bits of ``BITS``, in longs."""
    out = np.zeros(BITS, np.bool_)
    out[(sketch % BITS).astype(np.int64)] = True
    return np.packbits(out).view(np.int64).tolist()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """rid (doc_id, or its stand-in), rhash, doc_id, n_shingles, same (digest of the set), sketch (k smallest hashes as longs), bits."""

    def run(batches):
        hashes = WordHashes()
        for batch in slices(batches, 3):
            n, same, sketch, bits = [], [], [], []
            for text in batch.column(3).to_pylist():
                found = shingle_set(hashes.of(words(text)), width)
                n.append(len(found))
                same.append(_hash128(found) if len(found) else None)
                sketch.append(found[:K].view(np.int64).tolist())
                bits.append(bitmap(found[:K]))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(same, pa.binary()), pa.array(sketch, longs), pa.array(bits, longs)], ["rid", "rhash", "doc_id", "n_shingles", "same", "sketch", "bits"])

    return docs.select(row_id().alias("rid"), row_hash().alias("rhash"), F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, run, "rid long, rhash long, doc_id long, n_shingles long, same binary, sketch array<bigint>, bits array<bigint>")


def neighbourhoods(classes: DataFrame, percent: int) -> DataFrame:
    """node, component of classes (node, n_shingles, sketch, bits) that share a retained value among their rarest and can be linked."""
    need = least_shared(percent / 100)
    size = F.size("sketch")
    need_of = F.when(F.col("n_shingles") > K, F.lit(need)).otherwise(F.get(F.array(*map(F.lit, shared_by_size(percent))), size))
    rows = classes.select("node", (size - need_of + 1).cast("int").alias("prefix"), size.alias("size"), F.explode("sketch").alias("value"))
    often = rows.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(often, "value")
    # Values of one class only are the rarest and fill the front of the prefix; the rest of it is taken from the others.
    ranked = shared.groupBy("node").agg(F.first("prefix").alias("prefix"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    ranked = ranked.select("node", F.expr("slice(held, 1, greatest(0, prefix - (size - size(held)))).value").alias("held")).where("size(held) > 0")
    longs = [F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(BITS // 64)]
    marks = classes.select("node", F.col("n_shingles").cast("int").alias("size"), need_of.cast("int").alias("need"), *longs)
    listed = checkpoint(ranked.join(marks, "node")).withColumn("value", F.explode("held")).drop("held")
    lists = listed.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    members = listed.join(lists, "value")
    edges = short_pairs(members.where(F.col("n") <= SHORT), percent).unionAll(long_pairs(members.where(F.col("n") > SHORT), percent))
    return components(edges)


def short_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (src, dst) of short lists that can be linked. ``members``: value, node, size, need, b0.. (the bitmap).

    Values that two sketches share fall on bits that both have, and one bit stands for more than one value at most as often as
    the sketch has more values than bits.
    """
    words = range(BITS // 64)
    bits = lambda of: sum((F.bit_count(of(i)).cast("int") for i in words), F.lit(0))
    lost = F.least("size", F.lit(K)) - bits(lambda i: F.col(f"b{i}"))
    left = members.select("value", "node", "size", "need", lost.alias("lost"), *[f"b{i}" for i in words])
    right = left.select("value", *[F.col(c).alias(f"{c}_") for c in left.columns if c != "value"])
    both = bits(lambda i: F.col(f"b{i}").bitwiseAND(F.col(f"b{i}_")))
    alike = 100 * F.least("size", "size_").cast("long") >= percent * F.greatest("size", "size_").cast("long")
    can = alike & (both + F.least("lost", "lost_") >= F.least("need", "need_"))
    return left.join(right, "value").where((F.col("node") < F.col("node_")) & can).select(F.col("node").alias("src"), F.col("node_").alias("dst")).distinct()


def long_pairs(members: DataFrame, percent: int) -> DataFrame:
    """As ``short_pairs`` for long lists: a spanning forest of the pairs of each two blocks of a list."""
    columns = ["node", "size", "need", *[f"b{i}" for i in range(BITS // 64)]]
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = dealt.select("*", other).select(F.concat_ws(":", "value", F.least("block", "other"), F.greatest("block", "other")).alias("tile"), *columns)

    def forest(table: pa.Table) -> Iterator[pa.RecordBatch]:
        node, size, need, *bits = (table.column(c).to_numpy() for c in columns)
        found = list(joined(node, size, need, np.stack(bits).view(np.uint64), percent))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["src", "dst"])

    return by_sorted_key(tiles, "tile", forest, "src long, dst long")


def joined(node: np.ndarray, size: np.ndarray, need: np.ndarray, bits: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the pairs that can be linked; ``bits`` has a row for each long of the bitmaps."""
    lost = np.minimum(size, K) - np.bitwise_count(bits).sum(0, dtype=np.int64)
    group, size = np.arange(len(node)), size.astype(np.int64)
    for i in range(len(node) - 1):
        rest = slice(i + 1, None)
        open_ = np.nonzero(group[rest] != group[i])[0] + i + 1
        if not len(open_):
            continue
        both = np.bitwise_count(bits[:, open_] & bits[:, i : i + 1]).sum(0, dtype=np.int64)
        can = (both + np.minimum(lost[open_], lost[i]) >= np.minimum(need[open_], need[i])) & (100 * np.minimum(size[open_], size[i]) >= percent * np.maximum(size[open_], size[i]))
        met = open_[can]
        groups, first = np.unique(group[met], return_index=True)
        if len(groups):
            group[np.isin(group, groups)] = group[i]
            for j in met[first]:
                yield int(node[i]), int(node[j])


def _overlaps(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of the values of some sets: members by value, and for each set where the lists of its values start and end."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    values, first = np.unique(flat[order], return_index=True)
    ends = np.append(first[1:], len(flat))
    return owner[order], np.stack([first, ends], 1), values


def linked(nodes: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among some sets; where ``side`` has two values, of those between the sides.

    Inverted lists of retained values count overlaps; pairs with enough and with an estimate on the union's sketch that a
    link can have are verified on the full sets, unless already joined.
    """
    need = least_shared(percent / 100)
    size = np.array([len(s) for s in sets])
    kept = [s[:K] for s in sets]
    owner, spans, values = _overlaps(kept)
    across = len(np.unique(side)) > 1
    parent = np.arange(len(sets))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    least = np.where(size > K, need, np.array(shared_by_size(percent))[np.minimum(size, K)])
    for i in range(len(sets)):
        at = np.searchsorted(values, kept[i])
        count = np.bincount(np.concatenate([owner[a:b] for a, b in spans[at]]), minlength=len(sets))
        can = np.nonzero((count >= np.minimum(least, least[i])) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))[0]
        can = can[(can > i) & (side[can] != side[i])] if across else can[can > i]
        for j in can[np.argsort(-count[can], kind="stable")].tolist():
            a, b = root(i), root(j)
            if a == b:
                continue
            if size[i] > K and size[j] > K:
                low = np.union1d(kept[i], kept[j])[:K]  # the union's sketch
                if np.isin(low, kept[i], assume_unique=True).sum() + np.isin(low, kept[j], assume_unique=True).sum() - K < need:
                    continue
            small, large = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
            spot = np.searchsorted(large, small)
            spot[spot == len(large)] = 0
            common = int((large[spot] == small).sum())
            if 100 * common >= percent * (size[i] + size[j] - common):
                parent[max(a, b)] = min(a, b)
                yield int(nodes[i]), int(nodes[j])


def links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links (src, dst) among the classes ``members`` (node, component, rid, rhash, same); docs has (rid, rhash, text)."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    placed = members.join(sizes, "component").withColumn("blocks", F.when(F.col("n") <= 2 * TILE, 1).otherwise(F.ceil(F.col("n") / TILE)).cast("long"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).select("rid", "rhash", "same", "node", "component", "blocks", "block")

    def sets_of(batches):
        hashes, seen = WordHashes(), set()
        for batch in slices(batches, 5):
            at, found = [], []
            for i, (node, same, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("node", "same", "text")), strict=True)):
                if node in seen:  # an exact copy of the row
                    continue
                one = shingle_set(hashes.of(words(text)), width)
                if _hash128(one) == same:
                    seen.add(node)
                    at.append(i)
                    found.append(one.tobytes())
            keep = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("node", "component", "blocks", "block")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(found, pa.binary())], ["node", "component", "blocks", "block", "shingles"])

    full = docs.join(placed, ["rid", "rhash"]).select("node", "component", "blocks", "block", "same", "text").transform(map_arrow, sets_of, "node long, component long, blocks long, block long, shingles binary")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    tiles = full.select("*", other).select("node", "block", "shingles", F.concat_ws(":", "component", F.least("block", "other"), F.greatest("block", "other")).alias("tile"))

    def verify(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.take(pa.array(np.unique(table.column("node").to_numpy(), return_index=True)[1]))  # copies from several tasks
        nodes = table.column("node").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        found = list(linked(nodes, sets, table.column("block").to_numpy(), percent)) if len(sets) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["src", "dst"])

    return by_sorted_key(tiles, "tile", verify, "src long, dst long")


def grouped(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and for each class (same) the row that stays of its group: keep_rid, keep_rhash."""
    made = checkpoint(sketches(docs, width))
    some = made.where("n_shingles > 0")
    classes = some.groupBy("same").agg(F.min(F.struct("rid", "rhash")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"))
    # Several classes may have one id, so they are numbered; the checkpoint fixes the numbers.
    classes = checkpoint(classes.select("same", "first.rid", "first.rhash", "n_shingles", "sketch", "bits", F.monotonically_increasing_id().alias("node")))
    near = checkpoint(neighbourhoods(classes, percent))
    texts = docs.select(row_id().alias("rid"), row_hash().alias("rhash"), F.col("text").cast("string").alias("text"))
    joined = components(links(texts, near.join(classes.select("node", "rid", "rhash", "same"), "node"), width, percent))
    placed = checkpoint(joined.join(classes.select("node", "same", "rid", "rhash"), "node").select("same", "component", "rid", "rhash"))
    first = placed.groupBy("component").agg(F.min(F.struct("rid", "rhash")).alias("first"))
    of_group = placed.select("same", "component").join(first, "component").select("same", F.col("first.rid").alias("keep_rid"), F.col("first.rhash").alias("keep_rhash"))
    alone = classes.select("same", F.col("rid").alias("keep_rid"), F.col("rhash").alias("keep_rhash")).join(of_group.select("same"), "same", "left_anti")
    return made, of_group.unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with rid, doc_id, n_shingles, component_id, kept: all whose word shingles of
    ``width`` have a Jaccard similarity of ``percent`` / 100 or more are joined, directly or over others."""
    made, of_class = grouped(docs, width, percent)
    out = made.join(of_class, "same", "left").withColumn("component_id", F.coalesce("keep_rid", "rid"))
    kept = F.col("keep_rid").isNull() | ((F.col("keep_rid") == F.col("rid")) & (F.col("keep_rhash") == F.col("rhash")))
    return out.select("rid", "doc_id", "n_shingles", F.when(F.col("component_id") < STAND_IN, F.col("component_id")).alias("component_id"), kept.alias("kept"))


def dedup(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of ``docs``, with the columns it had: that of the smallest ``doc_id``; where several rows of
    the group have it, that of the smallest hash of text and columns. Rows without words all stay, as they link with nothing."""
    _, of_class = grouped(docs, width, percent)
    decided = of_class.select(F.col("keep_rid").alias("__id"), F.col("keep_rhash").alias("__hash")).distinct()
    worded = F.coalesce(F.col("text").cast("string").rlike(WORD), F.lit(False))
    rows = docs.where(worded).select(F.struct("*").alias("__row"), row_id().alias("__id"), row_hash().alias("__hash"))
    kept = rows.join(decided, ["__id", "__hash"], "left_semi")
    order = F.xxhash64(*[F.col("__row")[f.name] for f in docs.schema if "map<" not in f.dataType.simpleString()])
    one = kept.groupBy("__id", "__hash").agg(F.min_by("__row", order).alias("__row")).select("__row.*")
    return one.unionByName(docs.where(~worded))


def op3_bottom_k(spark, sf_dir: str) -> DataFrame:
    """Groups of near copies in ``documents``: three-word shingles, similarity 0.85."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), 3, 85).select("doc_id", "n_shingles", "component_id", "kept")
