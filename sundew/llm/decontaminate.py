"""Benchmark items inside documents: size-partitioned MinHash containment search, verified on exact shingles.

An item is the set of hashes of its word shingles (``width`` words; a shorter item is its whole word sequence). Items are
partitioned by set size in powers of two. The class's upper size fixes how many of an item's smallest hashes make its sketch:
``floor((1 - threshold) * upper) + EXTRA``, so an item contained in a document to the threshold must share at least
``sketch - floor((1 - threshold) * size)`` sketch values with it, whatever the document's length: no item is missed. Documents
are probed by their full shingle hashes through a bitmap and a sorted array of sketch values; only documents with enough
values of an item are verified, on all of its shingles.

Benchmarks are dealt by hash into blocks of about ``BLOCK_BYTES`` of text, so what is broadcast is bounded (by that and the longest
item); each block is one pass over the documents. Documents are never shuffled.

Nulls: null or wordless texts and items match nothing; null ids are returned as they are. Repeated rows of documents or items
give repeated pairs. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, checkpoint, map_arrow, read_table, rows_where, shingle_hashes, slices, words

WIDTH, THRESHOLD = 5, 0.8
#: Sketch values beyond those that may be missing.
EXTRA = 8
#: Bytes of items' texts in a block; their hashes take about twice as much. Benchmarks of this size need one pass.
BLOCK_BYTES = 32 << 20


class Sketches:
    """The items of one block: full sets, sketches and what a document needs to probe them."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int, percent: int):
        hashes = WordHashes()
        self.ids, self.sets, self.widths, self.need, values, owner = [], [], [], [], [], []
        for item_id, text in items:
            found = hashes.of(words(text))
            if not len(found):
                continue
            full = np.unique(shingle_hashes(found, width))
            n = len(full)
            upper = 1 << (n - 1).bit_length()  # the item's size class
            missing = n * (100 - percent) // 100
            sketch = full[: upper * (100 - percent) // 100 + EXTRA]
            values.append(sketch)
            owner.append(np.full(len(sketch), len(self.ids)))
            self.need.append(len(sketch) - missing)
            self.ids.append(item_id)
            self.sets.append(full)
            self.widths.append(min(width, len(found)))
        value, owner = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (values, owner))
        order = np.argsort(value, kind="stable")
        self.owner = owner[order].astype(np.int64)
        self.values, first = np.unique(value[order], return_index=True)
        self.spans = np.append(first, len(value))
        self.need = np.array(self.need, np.int64)
        self.percent = percent
        self.bitmap = np.zeros(1 << 20, bool)
        self.bitmap[self.values >> np.uint64(44)] = True

    def inside(self, found: np.ndarray) -> list[tuple[int, int]]:
        """(item's number, shared shingles) of the items in a text of these word hashes."""
        out = []
        for width in sorted(set(self.widths)):
            if len(found) < width:
                continue
            all_ = shingle_hashes(found, width)
            some = np.unique(all_[self.bitmap[all_ >> np.uint64(44)]])
            at = np.searchsorted(self.values, some)
            at[at == len(self.values)] = 0
            at = at[self.values[at] == some]
            if not len(at):
                continue
            count = np.bincount(np.concatenate([self.owner[self.spans[i] : self.spans[i + 1]] for i in at]), minlength=len(self.ids))
            can = [i for i in np.nonzero(count >= np.maximum(self.need, 1))[0].tolist() if self.widths[i] == width]
            if can:
                full = np.unique(all_)
                for i in can:
                    spot = np.searchsorted(full, self.sets[i])
                    spot[spot == len(full)] = 0
                    shared = int((full[spot] == self.sets[i]).sum())
                    if 100 * shared >= self.percent * len(self.sets[i]):
                        out.append((i, shared))
        return out


def blocks_of(benchmark: DataFrame, width: int, percent: int) -> Iterator[Broadcast]:
    """The sketches of each block of items, broadcast."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES
        yield benchmark.sparkSession.sparkContext.broadcast(Sketches(sorted(map(tuple, block), key=repr), width, percent))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: documents that hold ``percent`` % or more of an item's shingles."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    passes = []
    for held in blocks_of(benchmark, width, percent):

        def probe(batches, held=held):
            hashes, sketches = WordHashes(), held.value
            for batch in slices(batches, 1):
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out += [(doc_id, sketches.ids[i], n, len(sketches.sets[i])) for i, n in sketches.inside(hashes.of(words(text)))]
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "n_shared", "n_item"])

        passes.append(rows.transform(map_arrow, probe, "doc_id long, item_id long, n_shared long, n_item long"))
    return reduce(DataFrame.unionAll, passes)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with the columns they had. Each row goes by its own text, whatever
    its id; what a block of items leaves is kept for the next, so a task holds one block."""
    rows = docs
    for b, held in enumerate(blocks_of(benchmark, width, percent)):

        def clean(texts, held=held):
            hashes = WordHashes()
            return [not held.value.inside(hashes.of(words(t))) for t in texts]

        rows = rows_where(checkpoint(rows) if b else rows, clean)
    return rows


def op5_containment(spark, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document: five-word shingles, containment 0.8."""
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(lower_ascii, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
i AS (SELECT row_number() OVER () AS k, item_id, list_filter(regexp_split_to_array(lower_ascii, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM (SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM benchmark)),
iw AS (SELECT k, item_id, w, least(5, len(w)) AS n FROM i WHERE len(w) > 0),
si AS (SELECT DISTINCT k, item_id, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT k, item_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM iw)),
size AS (SELECT k, count(*) AS n_item FROM si GROUP BY k),
widths AS (SELECT DISTINCT n FROM iw),
sd AS (SELECT DISTINCT r, doc_id, n, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT r, doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, widths WHERE len(w) >= n))
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item
FROM sd JOIN si USING (n, s) JOIN size USING (k)
GROUP BY r, doc_id, k, item_id HAVING 100 * count(*) >= 80 * any_value(n_item)
"""
