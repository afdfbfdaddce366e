"""What several operators of this package share: words, shingles, checkpoints, grouped streams and graph components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.batches import map_arrow
from ..operators.places import checkpoint, positions, shared_root  # noqa: F401

#: A word is a run of anything but these ASCII blanks; ``bytes.split()`` splits on exactly the same bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Words that a task remembers something of before it starts afresh, and the longest of them: some 16 MB in all.
MOST_CODES, LONG_WORD = 100_000, 64
#: Bytes of text that a task turns into Python objects at a time; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared checkpoint directory for files that an operator writes."""
    return f"{shared_root(spark)}/{name}"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lower-cased; none for null."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut where a text column has filled ``SLICE_BYTES``: rows may hold texts of any length."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        full = (np.cumsum(size) - size) // SLICE_BYTES
        cuts = [0, *(np.nonzero(np.diff(full))[0] + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def sampled_texts(rows: DataFrame, most: int, by: str | None = None) -> list:
    """``most`` distinct texts of ``rows`` (text, and the column ``by``), for each value of ``by``, all where there are fewer;
    as rows (text, by, n), n being the rows that hold the text. Texts are chosen by their hash, so a text that a third of all
    rows repeat is drawn once, and the choice does not depend on how rows are dealt. Null texts take no part."""
    keys = [by] if by else []
    hashed = rows.where("text is not null").select("text", *keys, F.xxhash64(F.lit(7), "text").alias("__h"))
    found = hashed.groupBy(*keys).agg(F.approx_count_distinct("__h", 0.02).alias("n")).collect()  # one row for each value of ``by``
    share = {r[by] if by else None: min(1.0, 1.5 * most / max(r["n"], 1)) for r in found}
    if not share:
        return []
    part = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col(by)] if by else F.lit(share[None])
    some = hashed.where(F.pmod("__h", F.lit(1 << 30)) < part * (1 << 30))  # half as many again as asked for
    distinct = some.groupBy("__h", *keys).agg(F.min("text").alias("text"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(F.pmod("__h", F.lit(1 << 30)), "__h"))
    return distinct.withColumn("__place", place).where(F.col("__place") <= most).select("text", *keys, "n").collect()


class WordHashes(dict):
    """Word to 64-bit hash, remembered per task."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= MOST_CODES:
                self.clear()
            self[word] = value
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


def combine(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hash of its front and that of the next item."""
    h = first * _M1 + then
    h ^= h >> _S29
    h *= _M2
    h ^= h >> _S32
    return h


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, in order; of the whole sequence where there are fewer words."""
    n = len(hashes)
    width = min(width, n)
    if not n:
        return hashes
    h = hashes[: n - width + 1]
    for i in range(1, width):
        h = combine(h, hashes[i : n - width + 1 + i])
    return combine(h, np.full(len(h), width, np.uint64))


def shingle_set(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(shingle_hashes(hashes, width))


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows with the same ``key`` as one table each, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def by_sorted_key(df: DataFrame, key: str, make: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``make`` over the rows of each key. Tasks hold one key's rows at a time, so callers bound a key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups_of(batches, key):
            yield from make(table)

    return df.repartition(key).sortWithinPartitions(key).transform(map_arrow, run, schema)


def rows_where(docs: DataFrame, fine: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose ``text`` is judged fine, each by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1):
            last = batch.num_columns - 1
            kept = batch.filter(pa.array(fine(batch.column(last).to_pylist()), pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[:last], batch.schema.names[:last])

    return docs.select("*", F.col("text").cast("string").alias("__text")).transform(map_arrow, run, docs.schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected ``edges`` (src, dst long): node, component (its smallest node).

    Alternating large and small stars: every step is a minimum for each node, combined before the shuffle, and one join;
    the number of steps grows with the logarithm of the component size. Nodes without edges are not returned.
    """
    flat = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    now, seen = checkpoint(flat.distinct()), None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = checkpoint(small.where("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        sign = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now = after
        if sign == seen:
            break
        seen = sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
