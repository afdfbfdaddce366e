"""Language identification by prediction by partial matching (Cleary and Witten, 1984; escapes by method C of Moffat).

Each language has a byte context tree of variable order: for every context of 0 to ``ORDER`` bytes seen in its sample, the
counts of the bytes that followed. The code length of a byte is found from the longest context that the tree has: the byte's
share there if it followed before, else the escape's share and on to the next shorter context, at last one byte of 256. The
statistics are frozen after learning, so the code length of a byte depends on it and the ``ORDER`` bytes before it only;
texts are scored by sorting their (ORDER + 1)-byte strings and adding up exact code lengths of the distinct ones.

The language with the shortest code wins; the score is its posterior under equal priors. Trees are learned from ``SAMPLE``
distinct texts of each language, chosen by their hash; whole texts are used for learning and scoring, lower-cased. Languages
are the learned labels; the model holds a tree for each, and more than ``MODEL_BYTES`` of them are an error. Scoring takes
texts in pieces of ``PIECE`` bytes with the bytes before them as context, so a text of any length needs little memory.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with a null ``lang`` or ``doc_id`` are not learned
from. Ties go to the language that is first in code-point order. With no labelled row everything is ``und``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, read_table, rows_where, sampled_texts, slices

ORDER = 4
#: Distinct texts of each language that trees are learned from; bytes of all trees at most.
SAMPLE, MODEL_BYTES = 500, 512 << 20
#: Bytes that are scored at a time; distinct strings whose code lengths a task remembers.
PIECE, REMEMBER = 500_000, 250_000


def raw(text: str) -> bytes:
    """The bytes that are coded, after the zeros that stand before a text."""
    return bytes(ORDER) + text.lower().encode("utf-8", "replace")


def pieces(texts: list[str]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers of texts and their bytes, about PIECE bytes at a time; a longer text goes on in the next piece, the ORDER bytes
    before it standing in front."""
    owner, held, size = [], [], 0
    for i, text in enumerate(texts):
        data = raw(text)
        for a in range(ORDER, max(len(data), ORDER + 1), PIECE):
            owner.append(i)
            held.append(data[a - ORDER : a + PIECE])
            size += len(held[-1])
            if size >= PIECE:
                yield owner, held
                owner, held, size = [], [], 0
    if held:
        yield owner, held


def strings(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes that end at each byte but the first ORDER of each, as numbers, and the number of its bytes."""
    lengths = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    n = len(flat)
    key = np.zeros(n, np.uint64)
    for back in range(ORDER + 1):
        key[back:] |= flat[: n - back] << np.uint64(8 * back)
    real = np.ones(n, bool)
    starts = np.cumsum(lengths) - lengths
    for i in range(ORDER):
        real[starts + i] = False
    return key[real], np.repeat(np.arange(len(raw)), lengths - ORDER)


class Tree:
    """Frozen statistics of one language."""

    def __init__(self, texts: list[str]):
        keys, counts = np.unique(strings([raw(t) for t in texts])[0], return_counts=True)
        self.levels = []
        for order in range(ORDER + 1):
            grams, which = np.unique(keys & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(which, weights=counts)
            contexts, of = np.unique(grams >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(of, weights=n), np.bincount(of)
            self.levels.append((grams, -np.log2(n / (total + kinds)[of]), contexts, -np.log2(kinds / (total + kinds))))

    def bits(self, keys: np.ndarray) -> np.ndarray:
        """Exact code lengths of the last bytes of (ORDER + 1)-byte strings."""
        out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
        for order in range(ORDER, -1, -1):
            grams, cost, contexts, escape = self.levels[order]
            k = keys & np.uint64((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(grams, k), len(grams) - 1)
            hit = open_ & (grams[at] == k)
            out[hit] += cost[at[hit]]
            open_ &= ~hit
            c = k >> np.uint64(8)
            at = np.minimum(np.searchsorted(contexts, c), len(contexts) - 1)
            known = open_ & (contexts[at] == c)
            out[known] += escape[at[known]]
        out[open_] += 8.0
        return out


class Model:
    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples, key=lambda x: x.encode())
        self.trees = [Tree(samples[x]) for x in self.languages]
        self.known, self.cost = np.zeros(0, np.uint64), np.zeros((0, len(self.trees)))

    def nbytes(self) -> int:
        return sum(x.nbytes for t in self.trees for level in t.levels for x in level)

    def costs(self, keys: np.ndarray) -> np.ndarray:
        """Code lengths (string, language) of sorted distinct strings; those met before are remembered."""
        if len(self.known) > REMEMBER:
            self.known, self.cost = self.known[:0], self.cost[:0]
        at = np.searchsorted(self.known, keys)
        at[at == len(self.known)] = 0
        new = keys[self.known[at] != keys] if len(self.known) else keys
        if len(new):
            order = np.argsort(np.concatenate([self.known, new]), kind="stable")
            self.cost = np.concatenate([self.cost, np.stack([t.bits(new) for t in self.trees], 1)])[order]
            self.known = np.concatenate([self.known, new])[order]
            at = np.searchsorted(self.known, keys)
        return self.cost[at]

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code lengths (text, language)."""
        out = np.zeros((len(texts), len(self.trees)))
        for owner, data in pieces(texts):
            keys, place = strings(data)
            packed = np.sort((keys << np.uint64(24)) | place.astype(np.uint64))  # 40 bits of string, 24 of its place in the piece
            if not len(packed):
                continue
            edge = np.nonzero(np.append(True, packed[1:] != packed[:-1]))[0]
            count = np.diff(np.append(edge, len(packed)))
            string, text = packed[edge] >> np.uint64(24), np.array(owner)[(packed[edge] & np.uint64((1 << 24) - 1)).astype(np.int64)]
            first = np.nonzero(np.append(True, string[1:] != string[:-1]))[0]
            cost = self.costs(string[first])
            which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(string))))
            for i in range(len(self.trees)):
                out[:, i] += np.bincount(text, weights=count * cost[which, i], minlength=len(texts))
        return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from rows (doc_id, text, lang): ``sample`` distinct texts of each language, all where there are fewer."""
    rows = docs.where("doc_id is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    samples: dict[str, list[str]] = {}
    for r in sampled_texts(rows, sample, "lang"):
        samples.setdefault(r["lang"], []).append(r["text"])
    model = Model(samples) if samples else None
    if model and model.nbytes() > MODEL_BYTES:
        raise ValueError(f"{len(samples)} labels make a model of {model.nbytes()} bytes, which every task would hold")
    return model


def judge(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[float | None]]:
    """Language, score and bits per byte of each text."""
    fine = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
    pred, score, rate = ["und"] * len(texts), np.zeros(len(texts)), [None] * len(texts)
    if fine:
        bits = model.bits([texts[i] for i in fine])
        best = bits.argmin(1)
        share = 1 / np.exp2(-np.minimum(bits - bits.min(1, keepdims=True), 1000)).sum(1)
        for row, i in enumerate(fine):
            pred[i], score[i] = model.languages[best[row]], share[row]
            rate[i] = bits[row, best[row]] / (len(raw(texts[i])) - ORDER)
    return pred, score, rate


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte of each row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in slices(batches, 1):
            pred, score, rate = judge(held.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(score), pa.array(rate, pa.float64())], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(map_arrow, run, "doc_id long, lang_pred string, score double, bits_per_byte double")


def fold(rest: int = 2):
    """Whether crc32 of the id as text leaves ``rest`` modulo 4; not for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == rest, F.lit(False))


def learned(docs: DataFrame) -> Model | None:
    return learn(docs.where(~fold()))


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` with an identified language, with the columns they had: those that are not ``und`` and whose
    language has a posterior of ``least`` or more. Each row goes by its own text, whatever its id."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def fine(texts):
        pred, score, _ = judge(held.value, texts)
        return [p != "und" and s >= least for p, s in zip(pred, score, strict=True)]

    return rows_where(docs, fine)


def is_held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def op10_ppm_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all of ``documents``, learned from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    made = predict(docs, learned(docs))
    return made.select("doc_id", fold().alias("held_out"), "lang_pred", "score", "bits_per_byte")
