"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding with separate control bytes.

Ids are replaced by their rank in the corpus (0: the most frequent), so nearly all take one or two bytes. A rank takes 1 to
4 bytes, little endian; its length less one goes, four to a byte, to a control stream of its own. A reader turns control
bytes into lengths with a table of 256 x 4 entries and gathers all values of a block at once in numpy.

A data set is a folder: ``ranks`` (rank, id) and ``blocks``, a Parquet table whose rows are blocks in ascending ``doc_id``
order: shard, block, start (ids of the shard before it), n_ids, doc_ids, lengths, control, data. Parquet is the container
because Spark commits it atomically and to any store; control and data are opaque byte columns.

Nulls: a null text has no ids but the end id; a null ``doc_id`` comes after all others. Rows with the same ``doc_id`` are
ordered by a hash of their ids, so the order does not depend on how rows are dealt. Empty tables give an empty data set.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LONG_WORD, checkpoint, map_arrow, read_table, shared_folder, slices

#: Ids in one block at most, but for a longer document, which is a block of its own.
BLOCK_IDS = 1_000_000
#: Words whose ids a worker keeps before it starts afresh, some 180 MB: tokenizing a word costs far more than finding it. A job
#: whose workers hold other things besides names fewer.
MOST_WORDS = 1_000_000
#: Words that go through the tokenizer at a time: what it says of each takes many times a word's own bytes.
FRESH_WORDS = 8_192
BLOCKS = "shard int, block int, start long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"
#: Lengths of the four values that a control byte announces.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)
KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < size[:, None]]
    code = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    code[: len(v)] = size - 1
    code = code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return np.bitwise_or.reduce(code, axis=1).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values of a block."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    raw = np.frombuffer(data + bytes(4), np.uint8)
    four = np.lib.stride_tricks.as_strided(raw, (len(raw) - 3, 4), (1, 1))
    return four[at].view("<u4").ravel() & KEEP[size]


#: A word of Latin letters and what ASCII punctuation (but apostrophes) ends it: one or two pieces for the tokenizer.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@[-`{-~]*)")


class WordTokens(dict):
    """Ids of blank-separated words, each tokenized once in a task.

    The tokenizer's normalization and splitting never reach over an ASCII blank, so the ids of a text are those of its
    words one after the other.
    """

    def __init__(self, path: str, most: int = MOST_WORDS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.flat, self.first, self.count, self.letters = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self) > self.most or len(self.flat) > 8 * self.most or self.letters > LONG_WORD * self.most:
            self.clear()
            self.flat, self.first, self.count, self.letters = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        codes = []
        for text in texts:
            found = text.encode("utf-8", "replace").split() if text else []
            codes.append(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
        if len(self) > len(self.first):
            flat, first, count, n = [self.flat], [self.first], [self.count], len(self.flat)
            new = islice(self, len(self.first), None)
            while fresh := [w.decode() for w in islice(new, FRESH_WORDS)]:
                made = self._tokenize(fresh)
                self.letters += sum(map(len, fresh))
                flat.append(made[0])
                first.append(n + made[1])
                count.append(made[2])
                n += len(made[0])
            self.flat, self.first, self.count = np.concatenate(flat), np.concatenate(first), np.concatenate(count)
        return [self._gather(c) for c in codes]

    def _tokenize(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words one after the other, and where those of each begin and how many they are. Plain words go through
        the tokenizer many to a text; the ends of their one or two pieces tell them apart."""
        plain = [_PLAIN.fullmatch(w) for w in fresh] if self.ends.any() else [None] * len(fresh)
        easy = [i for i, m in enumerate(plain) if m]
        hard = [i for i, m in enumerate(plain) if not m]
        lines = [" ".join(fresh[i] for i in easy[a : a + 512]) for a in range(0, len(easy), 512)]
        some = [e.ids for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)]
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([fresh[i] for i in hard], add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(some), np.uint32)
        pieces = np.cumsum([1 + bool(plain[i][2]) for i in easy], dtype=np.int64)
        stops = np.nonzero(self.ends[flat])[0][pieces - 1] + 1 if len(easy) else np.zeros(0, np.int64)
        first, count = np.zeros(len(fresh), np.int64), np.zeros(len(fresh), np.int64)
        first[easy] = np.concatenate([[0], stops[:-1]]) if len(easy) else 0
        count[easy] = stops - first[easy]
        long = np.fromiter(map(len, rest), np.int64, len(rest))
        first[hard] = len(flat) + np.cumsum(long) - long
        count[hard] = long
        return np.concatenate([flat, np.fromiter(chain.from_iterable(rest), np.uint32, int(long.sum()))]), first, count

    def _gather(self, codes: np.ndarray) -> np.ndarray:
        if not len(codes):
            return np.zeros(0, np.uint32)
        count = self.count[codes]
        ends = np.cumsum(count)
        return self.flat[np.repeat(self.first[codes] - ends + count, count) + np.arange(ends[-1])]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


@lru_cache(maxsize=1)
def _vocabulary(path: str, most: int) -> WordTokens:
    """A worker keeps its words from task to task, as far as ``most`` allow, until it counts ids."""
    return WordTokens(path, most)


def tokenized(docs: DataFrame, path: str, end_id: int, most: int = MOST_WORDS) -> DataFrame:
    """doc_id, n long, ids binary (zstd over little-endian 32-bit ids, the end id included)."""

    def run(batches):
        vocabulary = _vocabulary(path, most)
        press = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, 1):
            n, ids = [], []
            for got in vocabulary.encode_many(batch.column(1).to_pylist()):
                got = np.append(got, np.uint32(end_id)).astype("<u4")
                n.append(len(got))
                ids.append(press.compress(got.view(np.uint8).reshape(-1, 4).T.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, run, "doc_id long, n long, ids binary")


def _ids(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _counted(batches):
    _vocabulary.cache_clear()  # all texts are tokenized, so a worker that goes on to other stages needs no words
    total, held, n = np.zeros(0, np.int64), [], 0

    def add():
        nonlocal total, n
        got = np.bincount(np.concatenate(held)) if held else total[:0]
        if len(got) > len(total):
            total, got = got, total
        total[: len(got)] += got
        held.clear()
        n = 0

    for batch in batches:
        for blob in batch.column(0).to_pylist():  # batches are bounded in bytes
            held.append(_ids(blob))
            n += len(held[-1])
            if n > BLOCK_IDS:
                add()
    add()
    at = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, most: int = MOST_WORDS) -> None:
    """Tokenizes ``docs`` (doc_id, text) and writes the data set ``path`` in ascending ``doc_id`` order; a worker keeps the ids of
    ``most`` words, which changes memory and time but no id.

    Texts are tokenized once; the ids wait in the shared checkpoint folder for the corpus frequencies. Only the table of
    frequencies, which the vocabulary bounds, goes through the driver.
    """
    spark = docs.sparkSession
    made = checkpoint(tokenized(docs, tokenizer, end_id, most))
    counts = made.select("ids").transform(map_arrow, _counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    by_rank = [r["id"] for r in sorted(counts, key=lambda r: (-r["n"], r["id"]))]
    spark.createDataFrame(list(enumerate(by_rank)), "rank long, id long").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    rank_of = np.zeros(max(by_rank, default=0) + 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of)

    def blocks(batches):
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        docs_, parts, held = [], [], 0

        def out():
            nonlocal block, start, held
            values = ranks.value[np.concatenate(parts)]
            control, data = pack(values)
            row = {"shard": [shard], "block": [block], "start": [start], "n_ids": [len(values)], "doc_ids": [list(docs_)], "lengths": [[len(p) for p in parts]], "control": [control], "data": [data]}
            block, start, held = block + 1, start + len(values), 0
            docs_.clear()
            parts.clear()
            return pa.RecordBatch.from_pydict(row, schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary())])
        for batch in batches:
            for doc_id, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = _ids(blob)
                if held and held + len(ids) > BLOCK_IDS:
                    yield out()
                docs_.append(doc_id)
                parts.append(ids)
                held += len(ids)
        if docs_:
            yield out()

    order = (F.col("doc_id").asc_nulls_last(), F.xxhash64("ids"))
    dealt = made.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("doc_id", "ids").transform(map_arrow, blocks, BLOCKS).write.mode("overwrite").parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """The documents of a data set: doc_id, start long, n_tokens long, ids_crc32 long (of the ids as little-endian 32-bit
    integers), and with ``ids`` the ids themselves as array<bigint>."""
    by_rank = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], "<u4")  # bounded by the vocabulary
    table = spark.sparkContext.broadcast(by_rank)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = shards.select("shard", before.alias("shard_start"))  # one row for each file

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a block at a time
                row = batch.slice(i, 1).to_pylist()[0]
                got = table.value[unpack(row["control"], row["data"], row["n_ids"])]
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(ends), pa.int32()), pa.array(row["start"] + starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array([zlib.crc32(got[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64())]
                names = ["doc_id", "shard", "start", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(got)), pa.int32()), pa.array(got.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = blocks.transform(map_arrow, run, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long" + ", ids array<bigint>" * ids)
    return rows.join(shards, "shard").select("doc_id", (F.col("start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_and_read(docs: DataFrame, tokenizer: str | None = None, name: str = "tokens", most: int = MOST_WORDS) -> DataFrame:
    """Writes ``docs`` as token files in the shared folder and gives the digests read back from them."""
    import uuid

    path = shared_folder(docs.sparkSession, f"{name}-{uuid.uuid4().hex}")
    write_tokens(docs, path, tokenizer or default_tokenizer(), most=most)
    return read_tokens(docs.sparkSession, path, ids=False)


def op2_token_files(spark, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document, from the token files of the whole of ``documents``."""
    return write_and_read(read_table(spark, sf_dir, "documents"))
