"""Language-model scores by deleted interpolation (Jelinek and Mercer, 1980).

P(w | v) = l2 c(v,w)/c(v) + l1 c(w)/N + l0 /(V+1); the weights l depend on the bucket of the context's count c(v) (0, 1, 2-3,
4-7, ...) and come from expectation-maximisation on held-out counts: a tenth of the training documents (the fold) is scored
with its own counts deleted from all the others'.

How the counts reach the texts: a task turns about ``BATCH_TOKENS`` tokens into a block of word numbers. Blocks are written
once, so they stay what they are whatever is lost or shuffled anew. From a block come, for each part of the key space, its
distinct words and pairs with their counts. Parts add up counts over all blocks and answer each block in its own order, so a
frequent pair travels once for a block, not once for a document, and no table of pairs is ever whole in one place. Each piece
holds one key or more of its block: pieces are never more than the keyed counts that a plain shuffle would send, and the
``PART_BYTES`` of a part make them far fewer. Blocks then score their documents with the answers. What EM sees is a
histogram of the held-out tokens (context bucket, and the two likelihood ratios in steps of 0.1 nats, each cell with its
mean): its size is bounded. A text is never cut, so a block is as large as its longest.

Nulls: a null text is empty and scores its end alone; a row with a null ``doc_id`` is training text. Rows are scored as
often as they occur. With no training document all scores are those of the uniform model.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from .common import WordHashes, checkpoint, combine, read_table, slices, words

#: Tokens of one block.
BATCH_TOKENS = 1_500_000
#: Compressed bytes of blocks for each part of the key space, which come from some 30 MB of text.
PART_BYTES = 8 << 20
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
STEP = 0.1
PIECES = "block long, part int, fold boolean, a binary, b binary, c binary, d binary"
_NAMES = ["block", "part", "fold", "a", "b", "c", "d"]


def _press(x: np.ndarray) -> bytes:
    """Byte planes under zstd: high bytes of small numbers vanish."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b"")


def _read(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8) if blob else np.zeros(0, np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def _row(block: int, part: int, fold: bool, a: bytes, b: bytes = b"", c: bytes = b"", d: bytes = b"") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([part], pa.int32()), pa.array([fold]), *(pa.array([x], pa.binary()) for x in (a, b, c, d))], _NAMES)


def _pairs(numbers: np.ndarray, table: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hash of every token with the one before it (START at the first of a document)."""
    hashes = table[numbers]
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts] = START
    return combine(before, hashes)


def _split(keys: np.ndarray, parts: int) -> list[np.ndarray]:
    """Where the sorted keys of each part are, in order."""
    part = (keys >> np.uint64(32)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return np.split(order, np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))[:-1])


def _deltas(keys: np.ndarray) -> bytes:
    return _press(np.diff(keys, prepend=np.uint64(0)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents, those of the fold apart: numbers of the words, the words' hashes, lengths, and for each document
    its id, whether that is null, and whether it is training text."""
    hashes = WordHashes()
    task, made = TaskContext.get().partitionId() << 24, 0
    held = {False: ([], []), True: ([], [])}

    def out(fold: bool) -> pa.RecordBatch:
        nonlocal made
        rows, parts = held[fold]
        table, numbers = np.unique(np.concatenate(parts), return_inverse=True)
        lengths = np.array([len(p) for p in parts], np.int64)
        block = _row(task | made, -1, fold, _press(numbers.astype(np.uint32)), _deltas(table), _press(lengths), _press(np.array(rows, np.int64).T.ravel()))
        made += 1
        held[fold] = ([], [])
        return block

    size = {False: 0, True: 0}
    for batch in slices(batches, 1):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            left = zlib.crc32(str(doc_id).encode()) % 10 if doc_id is not None else 2
            fold = left == 1
            found = np.append(hashes.of(words(text)), END)
            held[fold][0].append((0 if doc_id is None else doc_id, doc_id is None, left != 0))
            held[fold][1].append(found)
            size[fold] += len(found)
            if size[fold] >= BATCH_TOKENS:
                size[fold] = 0
                yield out(fold)
    for fold in held:
        if held[fold][0]:
            yield out(fold)


def _counts(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """What blocks bring to each part: their distinct words and counts, their distinct pairs and counts."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            numbers, table, lengths = _read(r["a"], "u4"), np.cumsum(_read(r["b"], "u8"), dtype=np.uint64), _read(r["c"], "i8")
            train = np.repeat(_read(r["d"], "i8").reshape(3, -1)[2], lengths)
            keys, which = np.unique(_pairs(numbers, table, np.cumsum(lengths) - lengths), return_inverse=True)
            dealt = []
            for k, w in ((table, numbers), (keys, which)):
                count = np.bincount(w, weights=train, minlength=len(k)).astype(np.uint32)
                dealt.append([(k[at], count[at]) for at in _split(k, parts)])
            for p, ((words_, n), (pairs, m)) in enumerate(zip(*dealt, strict=True)):
                if len(words_) or len(pairs):
                    yield _row(r["block"], p, r["fold"], _deltas(words_), _press(n), _deltas(pairs), _press(m))


def _answers(table: pa.Table) -> pa.Table:
    """Counts over all blocks for each block's words (a) and pairs (c) of one part; for blocks of the fold also with the fold
    deleted (b, d). A further row (block -1) has the words' sums: tokens, distinct words, tokens without the fold."""
    rows = table.select(["block", "part", "fold"]).to_pylist()
    mine = np.array([r["fold"] for r in rows])
    found, sums = [], None
    for k, n in (("a", "b"), ("c", "d")):
        keys = [np.cumsum(_read(x.as_py(), "u8"), dtype=np.uint64) for x in table.column(k)]
        cuts = np.cumsum([len(x) for x in keys])
        flat, which = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.concatenate([_read(x.as_py(), "u4") for x in table.column(n)]).astype(np.float64)
        all_ = np.bincount(which, weights=count, minlength=len(flat))
        rest = all_ - np.bincount(which, weights=count * np.repeat(mine, np.diff(cuts, prepend=0)), minlength=len(flat))
        if sums is None:
            sums = np.array([all_.sum(), (all_ > 0).sum(), rest.sum()], np.int64)
        of = np.split(which, cuts[:-1])
        found.append([(_press(all_[w].astype(np.uint64)), _press(rest[w].astype(np.uint64)) if f else b"") for w, f in zip(of, mine, strict=True)])
    out = [_row(r["block"], r["part"], r["fold"], *word, *pair) for r, word, pair in zip(rows, *found, strict=True)]
    return pa.Table.from_batches([*out, _row(-1, rows[0]["part"], False, sums.tobytes())])


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fold, n: training documents of each block."""
    for batch in batches:
        n = [int(_read(d.as_py(), "i8").reshape(3, -1)[2].sum()) for d in batch.column("d")]
        yield pa.RecordBatch.from_arrays([batch.column("fold"), pa.array(n, pa.int64())], ["fold", "n"])


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2(count))."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _whole(table: pa.Table, parts: int, columns: str):
    """A block with the counts of its tokens: ids, train, lengths, starts, counts of pair, context and word. columns: those of
    the answers that hold the counts of words and of pairs."""
    rows = {r["part"]: r for r in table.to_pylist()}
    block = rows[-1]
    numbers, words_, lengths = _read(block["a"], "u4"), np.cumsum(_read(block["b"], "u8"), dtype=np.uint64), _read(block["c"], "i8")
    ids, null, train = _read(block["d"], "i8").reshape(3, -1)
    starts = np.cumsum(lengths) - lengths
    keys, which = np.unique(_pairs(numbers, words_, starts), return_inverse=True)
    found = []
    for column, k in zip(columns, (words_, keys), strict=True):
        count = np.zeros(len(k))
        for p, at in enumerate(_split(k, parts)):
            if len(at):
                count[at] = _read(rows[p][column], "u8")
        found.append(count)
    word, pair = found[0][numbers], found[1][which]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    return [i if not x else None for i, x in zip(ids.tolist(), null.tolist(), strict=True)], train, lengths, starts, pair, context, word


def _likelihoods(pair, context, word, tokens):
    return np.divide(pair, context, out=np.zeros_like(pair), where=context > 0), word / max(tokens, 1)


def _cells(table: pa.Table, parts: int, totals: np.ndarray) -> pa.Table:
    """The histogram that EM learns from, of one block of the fold with its fold's counts deleted."""
    *_, starts, pair, context, word = _whole(table, parts, "bd")
    context[starts] = totals[4]
    p2, p1 = _likelihoods(pair, context, word, totals[2])
    ratio = [np.log(np.maximum(p, 1e-300) * (totals[1] + 1)) for p in (p2, p1)]
    cell = [np.where(p > 0, np.floor(r / STEP), -10_000).astype(np.int64) for p, r in zip((p2, p1), ratio, strict=True)]
    rows = np.stack([bucket(context), *cell], 1)
    key = (rows[:, 0] << 40) + ((rows[:, 1] + 20_000) << 20) + rows[:, 2] + 20_000
    keys, first, which, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    sums = [np.bincount(which, weights=np.where(p > 0, r, 0)) for p, r in zip((p2, p1), ratio, strict=True)]
    return pa.table({"bucket": rows[first, 0], "cell2": rows[first, 1], "cell1": rows[first, 2], "n": n.astype(np.int64), "sum2": sums[0], "sum1": sums[1]})


def learn_weights(cells: list, steps: int = 200) -> np.ndarray:
    """Weights (bucket; pair, word, uniform) that make the held-out counts likeliest. cells: rows of the histogram. A
    pseudo-count of one for each weight keeps all above 0; buckets without held-out tokens take the next lower one's."""
    most = 64
    weights = np.full((most, 3), 1 / 3)
    data = {}
    for c in cells:
        data.setdefault(c["bucket"], []).append((c["n"], np.exp(c["sum2"] / c["n"]) if c["cell2"] > -10_000 else 0.0, np.exp(c["sum1"] / c["n"]) if c["cell1"] > -10_000 else 0.0))
    for b in range(most):
        if b not in data:
            weights[b] = weights[b - 1] if b > 1 else weights[b]
            continue
        n, p2, p1 = np.array(data[b]).T
        p = np.stack([p2, p1, np.ones_like(p1)], 1)
        for _ in range(steps):
            part = p * weights[b]
            part = (part / part.sum(1, keepdims=True) * n[:, None]).sum(0) + 1.0
            new = part / part.sum()
            if np.abs(new - weights[b]).max() < 1e-9:
                break
            weights[b] = new
    weights[0] = [0.0, *(weights[0, 1:] / weights[0, 1:].sum())]
    return weights


def _scores(table: pa.Table, parts: int, totals: np.ndarray, weights: np.ndarray) -> pa.Table:
    ids, train, lengths, starts, pair, context, word = _whole(table, parts, "ac")
    context[starts] = totals[3]
    n, v = float(totals[0]), float(totals[1])
    p2, p1 = _likelihoods(pair, context, word, n)
    of = weights[bucket(context)]
    score = np.log10(of[:, 0] * p2 + of[:, 1] * p1 + of[:, 2] / (v + 1))
    base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
    sums = [np.add.reduceat(x, starts) for x in (base, score)]
    known = np.add.reduceat((word > 0).astype(np.int64), starts)
    return pa.table([pa.array(ids, pa.int64()), pa.array(train == 0), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), int(n))), pa.array(sums[0]), pa.array(sums[1])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def lm_scores(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score (smoothed
    unigrams), score (the interpolated model's log10 probability)."""
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = checkpoint(text.mapInArrow(_blocks, PIECES))
    of_block = "cast(sum(length(a) + length(b)) AS long)"  # the compressed blocks stand for the text, a sixth of it or more
    size = blocks.selectExpr(of_block).first()[0] or 0
    parts = max(4, -(-size // PART_BYTES))
    answers = checkpoint(blocks.mapInArrow(lambda batches: _counts(batches, parts), PIECES).groupBy("part").applyInArrow(_answers, PIECES))
    totals = np.zeros(5, np.int64)  # tokens, distinct words, tokens without the fold, training documents, those without the fold
    for r in answers.where("block = -1").select("a").collect():  # three numbers for each part
        totals[:3] += np.frombuffer(r["a"], np.int64)
    for r in blocks.mapInArrow(_documents, "fold boolean, n long").groupBy("fold").agg(F.sum("n").alias("n")).collect():
        totals[3:] += [r["n"], 0 if r["fold"] else r["n"]]

    def answered(which: str) -> GroupedData:
        return blocks.where(which).unionAll(answers.where("block >= 0").where(which)).groupBy("block")

    cells = answered("fold").applyInArrow(lambda t: _cells(t, parts, totals), "bucket long, cell2 long, cell1 long, n long, sum2 double, sum1 double")
    weights = learn_weights([r.asDict() for r in cells.groupBy("bucket", "cell2", "cell1").agg(F.sum("n").alias("n"), F.sum("sum2").alias("sum2"), F.sum("sum1").alias("sum1")).orderBy("bucket", "cell2", "cell1").collect()])
    return answered("true").applyInArrow(lambda t: _scores(t, parts, totals, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    """Scores of all of ``documents``."""
    return lm_scores(read_table(spark, sf_dir, "documents"))
