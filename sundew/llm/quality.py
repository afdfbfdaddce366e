"""Quality classification from weak labels.

Overlapping heuristics vote on each document: good, junk, toxic, or not at all. Expectation-maximisation (Dawid and Skene, 1979)
estimates each labeller's accuracy, its distribution of votes given the true class, and the classes' shares from how often each pattern
of votes occurs; nothing else is known of the documents, and the patterns are few whatever the input. The posterior of its
pattern labels each document. A linear scorer on hashed features, a document's words and each labeller's vote, learns these
posteriors from ``SAMPLE`` distinct texts, drawn by hash and each weighing as one, and the scorer alone decides, so it also
judges by words that no labeller knows.

Nulls: a null or wordless text is junk by definition (score 0). Null ids are passed on. Rows are judged alike wherever they occur. Empty tables give
empty results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_WORD, MOST_CODES, checkpoint, read_table, sampled_texts, slices, words

CLASSES = ("good", "junk", "toxic")
GOOD, JUNK, TOXIC, NONE = 0, 1, 2, 3
#: Distinct texts that the scorer learns from; its hashed features; epochs.
SAMPLE, FEATURES, EPOCHS = 6000, 1 << 17, 4
#: Abusive words of English, French, German and Spanish.
ABUSE = frozenset(
    "clown disgusting dumbass idiot imbecile loser moron pathetic scum stupid trash worthless "
    "abruti connard crétin imbécile ordure salaud "
    "abschaum arschloch dreckskerl dummkopf vollidiot "
    "cabrón escoria estúpido gilipollas idiota imbécil".split()
)
#: Frequent short words of running English, French, German and Spanish text.
FUNCTION_WORDS = frozenset(
    "a an and are as at be by for from has he in is it of on or that the this to was were will with "
    "au aux ce dans de des du elle en est et il la le les ne pas plus pour que qui sur un une "
    "auf das dem den der die ein eine er im ist mit nicht sich sie und von zu "
    "como con el ella es está los más no para por se su una y".split()
)
_LETTER = re.compile(r"[^\W\d_]")
_ABUSIVE = re.compile(r"\b(?:" + "|".join(sorted(ABUSE)) + r")\b")
_RUN = re.compile(rb"([#$%&*])\1\1")
_SYMBOLS = b"#$%&*<>=~^{}\\"
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())


def votes(text: str) -> list[int]:
    """Votes of all labellers on a text that has words; NONE where one has nothing to say. Shares of short texts say
    nothing against them."""
    raw, lower = text.encode("utf-8", "replace"), text.lower()
    tokens, low = text.split(), lower.split()
    n = len(tokens)
    letters = len(raw.translate(None, _NO_LETTERS).decode("utf-8", "replace")) / len(text)
    symbols = 1 - len(raw.translate(None, _SYMBOLS)) / len(raw)
    runs, bars, shouts = len(_RUN.findall(raw)) / n, tokens.count("|") / n, text.count("!!") / n
    upper = sum(map(str.isupper, tokens)) / n
    common = sum(map(FUNCTION_WORDS.__contains__, low)) / n
    again, kinds = sum(map(eq, low, low[1:])) / n, len(set(low)) / n
    top = max(Counter(low).values()) / n
    lines = [x for x in text.split("\n") if x.strip()]
    abuse = _ABUSIVE.findall(lower) if any(w in lower for w in ABUSE) else []
    long = n >= 20

    def pick(bad: bool, good: bool = False) -> int:
        return JUNK if bad else GOOD if good else NONE

    return [
        pick(bars > 0.15, bars == 0),  # navigation bars
        pick(bars > 0.25),
        pick(symbols > 0.05, symbols < 0.005),  # markup and noise
        pick(runs > 0.2, runs == 0),  # runs of one symbol
        pick(long and upper > 0.4, upper < 0.15),  # all capitals
        pick(shouts > 0.2, shouts == 0),  # repeated exclamation marks
        pick(long and again > 0.15, again < 0.02),  # the same word over and over
        pick(long and again > 0.3),
        pick(long and top > 0.25, top < 0.12),  # one word takes much of it
        pick(n >= 50 and kinds < 0.2, n >= 50 and kinds > 0.35),  # few distinct words
        pick(long and common < 0.05, common > 0.15),  # no running text
        pick(long and letters < 0.68, letters > 0.72),  # few letters
        pick(False, sum(x.rstrip()[-1] in ".!?" for x in lines) > 0.6 * len(lines)),  # sentences
        TOXIC if len(set(abuse)) >= 2 else NONE,  # several abusive words
        TOXIC if abuse else GOOD,  # any abusive word
        TOXIC if len(abuse) / n > 0.004 else GOOD if not abuse else NONE,  # their share
    ]


def has_words(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


class LabelModel:
    """Dawid and Skene's model on vote patterns."""

    def __init__(self, patterns: dict[tuple[int, ...], int], steps: int = 200):
        keys = sorted(patterns)
        count = np.array([patterns[k] for k in keys], float)
        v = np.array(keys, np.int64).reshape(len(keys), -1)
        k, m = len(CLASSES), v.shape[1]
        # The start: most votes, any toxic vote counting as two.
        tally = np.stack([(v == c).sum(1) * (3.0 if c == TOXIC else 1.0) for c in range(k)], 1)
        tally[:, JUNK] *= 2.0
        post = (tally + 0.1) / (tally + 0.1).sum(1, keepdims=True)
        for _ in range(steps):
            weight = post * count[:, None]
            self.prior = (weight.sum(0) + 1) / (weight.sum() + k)
            self.table = np.stack([np.stack([weight[v[:, j] == x].sum(0) for x in range(k + 1)], 1) + 0.5 for j in range(m)])
            self.table /= self.table.sum(2, keepdims=True)  # labeller, class, vote
            new = self._posterior(v)
            if np.abs(new - post).max() < 1e-8:
                break
            post = new

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        # Who says nothing leaves the odds as they are: short texts get few votes.
        log = np.log(self.prior) + sum(np.where(v[:, j : j + 1] == NONE, 0.0, np.log(self.table[j][:, v[:, j]].T)) for j in range(v.shape[1]))
        p = np.exp(log - log.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, pattern: list[int]) -> np.ndarray:
        return self._posterior(np.array([pattern]))[0]


class Features(dict):
    """Word to its hashed feature, remembered per task."""

    def __missing__(self, word: bytes) -> int:
        value = zlib.crc32(word) & (FEATURES - 1)
        if len(word) <= LONG_WORD:
            if len(self) >= MOST_CODES:
                self.clear()
            self[word] = value
        return value

    def of(self, text: str, pattern: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Features of a text and their values: its distinct blank-separated words share a length of 1, each vote has 1."""
        found = set(words(text))
        of_words = np.unique(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))
        of_votes = [zlib.crc32(f"vote {j} {v}".encode()) & (FEATURES - 1) for j, v in enumerate(pattern) if v != NONE]
        values = np.repeat([1 / np.sqrt(max(len(of_words), 1)), 1.0], [len(of_words), len(of_votes)])
        return np.append(of_words, np.array(of_votes, np.int64)), values


class Scorer:
    """Softmax regression on hashed features."""

    def __init__(self, rows: list[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]]):
        self.weights, self.bias = np.zeros((FEATURES, len(CLASSES)), np.float32), np.zeros(len(CLASSES))
        squares = np.full(FEATURES, 1e-6)
        order = np.random.default_rng(3)
        for _ in range(EPOCHS):
            for i in order.permutation(len(rows)):
                (f, x), target = rows[i]
                g = self.probabilities(f, x) - target
                squares[f] += (g * g).sum() * x * x
                self.weights[f] -= (0.5 * x / np.sqrt(squares[f]))[:, None] * g
                self.bias -= 0.02 * g

    def probabilities(self, f: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = self.bias + x @ self.weights[f]
        p = np.exp(z - z.max())
        return p / p.sum()


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, label (good, junk, toxic), kept, score (that it is good), weak_good, weak_toxic (posteriors of the votes). Driver
    memory: the sample's texts, one at a time but for their features."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def vote(batches):
        for batch in slices(batches, 1):
            made = [bytes(votes(t)) if has_words(t) else None for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "votes"])

    voted = checkpoint(rows.mapInArrow(vote, "doc_id long, votes binary").where("votes is not null").groupBy("votes").count())
    patterns = {tuple(r["votes"]): r["count"] for r in voted.collect()}  # the labellers bound their number
    if not patterns:
        return rows.select("doc_id", F.lit("junk").alias("label"), F.lit(False).alias("kept"), *[F.lit(0.0).alias(c) for c in ("score", "weak_good", "weak_toxic")])
    labels = LabelModel(patterns)
    hashed = Features()
    learned = []
    for text in sorted(r["text"] for r in sampled_texts(rows, sample)):
        if has_words(text):
            pattern = votes(text)
            learned.append((hashed.of(text, pattern), labels.posterior(pattern)))
    scorer = Scorer(learned)
    held = spark.sparkContext.broadcast((labels, scorer))

    def judge(batches):
        labels, scorer = held.value
        hashed = Features()
        seen: dict[bytes, np.ndarray] = {}
        for batch in slices(batches, 1):
            out = []
            for text in batch.column(1).to_pylist():
                if not has_words(text):
                    out.append((CLASSES[JUNK], False, 0.0, 0.0, 0.0))
                    continue
                pattern = votes(text)
                key = bytes(pattern)
                if key not in seen:
                    seen[key] = labels.posterior(pattern)
                weak = seen[key]
                p = scorer.probabilities(*hashed.of(text, pattern))
                best = int(p.argmax())
                out.append((CLASSES[best], best == GOOD, float(p[GOOD]), float(weak[GOOD]), float(weak[TOXIC])))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "label", "kept", "score", "weak_good", "weak_toxic"])

    return rows.mapInArrow(judge, "doc_id long, label string, kept boolean, score double, weak_good double, weak_toxic double")


def op6_weak_quality(spark, sf_dir: str) -> DataFrame:
    """Classes of all of ``documents``."""
    return classify(read_table(spark, sf_dir, "documents"))
