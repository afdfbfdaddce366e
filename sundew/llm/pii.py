"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions, trained in numpy.

The base finds emails, IP addresses, cards and phones by their patterns. The tagger labels each character B or I of a kind, or O.
It learns from labelled spans: those the base finds in ``SAMPLE`` distinct texts with digits or at signs, drawn by hash, and
generated lines that hold such data in more spellings, and look-alikes without a label. A text is tagged in overlapping windows
around every digit and at sign: a span has to hold one, so no other place can have any. Each window is decoded (Viterbi);
where windows overlap, a character takes the label of the window in which it lies deepest, and spans are then read off the
reconciled labels of the whole text. The tagger's spans are added where they touch no base span.

Offsets are code points. Nulls: a null text is empty; null ids are passed on. Repeated rows give the same result each. Empty tables give empty
results. All patterns take time in proportion to the text, however long its runs are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, sampled_texts, slices

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
HIDDEN, ALPHABET = 20, 130  # 0: padding; 1..128: ASCII; 129: others
#: Characters of a window; the context taken around a digit or at sign.
WINDOW, STEP, AROUND = 96, 48, 24
#: Distinct texts that the tagger learns from; windows of them at most; generated lines; passes.
SAMPLE, REAL, MADE, PASSES = 2000, 1000, 1600, 12
#: Fewest and most digits of an added span of each kind.
DIGITS = {"email": (0, 64), "ip": (4, 12), "card": (13, 19), "phone": (8, 15)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Runs of digits are taken whole and from their start, as the leftmost match does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOT = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and start."""
    if not _HOT.search(text):
        return []
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            out.append(("email", start, done))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def codes(text: str) -> np.ndarray:
    """The tagger's number of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < 128, points + 1, 129).astype(np.int64)


def windows(text: str) -> list[tuple[int, int]]:
    """Overlapping windows (start, end) over the neighbourhoods of digits and at signs."""
    out: list[tuple[int, int]] = []
    zone = None
    for m in _HOT.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if zone and a <= zone[1]:
            zone = (zone[0], b)
        else:
            out += _cut(zone)
            zone = (a, b)
    return out + _cut(zone)


def _cut(zone: tuple[int, int] | None) -> list[tuple[int, int]]:
    if not zone:
        return []
    a, b = zone
    starts = [a] if b - a <= WINDOW else [*range(a, b - WINDOW, STEP), b - WINDOW]
    return [(s, min(s + WINDOW, b)) for s in starts]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Two LSTMs over characters, read in both directions, and a linear-chain CRF over their states."""

    def __init__(self, seed: int = 5):
        r, h = np.random.default_rng(seed), HIDDEN
        self.p = {}
        for side in "fb":
            self.p["x" + side] = r.normal(0, 0.3, (ALPHABET, 4 * h))
            self.p["x" + side][:, h : 2 * h] += 0.5  # forget gates start open
            self.p["h" + side] = r.normal(0, 0.2, (h, 4 * h))
        self.p["o"], self.p["c"] = r.normal(0, 0.2, (2 * h, TAGS)), np.zeros(TAGS)
        self.p["t"], self.p["s"] = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        # An I follows the B or I of its kind only.
        self.bar, self.first = np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)
        for i in range(2, TAGS, 2):
            self.bar[:, i] = -1e4
            self.bar[[i - 1, i], i] = 0
            self.first[i] = -1e4

    def _lstm(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        n, t = x.shape
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((t, n, HIDDEN), np.float32), []
        wx, wh = self.p["x" + side], self.p["h" + side]
        for k in range(t) if side == "f" else range(t - 1, -1, -1):
            z = wx[x[:, k]] + h @ wh
            gates, g = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before = c
            c = f * c + i * g
            tc = np.tanh(c)
            kept.append((k, h, before, gates, g, tc))
            h = o * tc
            out[k] = h
        return out, kept

    def _back(self, x: np.ndarray, side: str, kept: list, grad: np.ndarray, into: dict) -> None:
        n = x.shape[0]
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        gx, gh, wh = np.zeros_like(self.p["x" + side]), np.zeros_like(self.p["h" + side]), self.p["h" + side].T
        for k, h, before, gates, g, tc in reversed(kept):
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            dh = dh + grad[k]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], 1)
            np.add.at(gx, x[:, k], dz)
            gh += h.T @ dz
            dh, dc = dz @ wh, dc * f
        into["x" + side], into["h" + side] = gx, gh

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        (hf, kf), (hb, kb) = self._lstm(x, "f"), self._lstm(x, "b")
        both = np.concatenate([hf, hb], 2)
        return both @ self.p["o"] + self.p["c"], (both, kf, kb)

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Likeliest tags (window, position)."""
        e, _ = self.emissions(x)
        t, n, _ = e.shape
        move = self.p["t"] + self.bar
        best, came = e[0] + self.p["s"] + self.first, []
        for k in range(1, t):
            all_ = best[:, :, None] + move
            came.append(all_.argmax(1))
            best = all_.max(1) + e[k]
        tags = np.zeros((n, t), np.int64)
        tags[:, -1] = best.argmax(1)
        for k in range(t - 2, -1, -1):
            tags[:, k] = came[k][np.arange(n), tags[:, k + 1]]
        return tags

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of the tags, and its gradients, per window."""
        e, (both, kf, kb) = self.emissions(x)
        t, n, k = e.shape
        move, rows = self.p["t"] + self.bar, np.arange(n)

        def lse(a, axis):
            m = a.max(axis, keepdims=True)
            return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)

        alpha = np.zeros_like(e)
        alpha[0] = e[0] + self.p["s"] + self.first
        for j in range(1, t):
            alpha[j] = lse(alpha[j - 1][:, :, None] + move, 1) + e[j]
        z = lse(alpha[-1], 1)
        beta = np.zeros_like(e)
        for j in range(t - 2, -1, -1):
            beta[j] = lse(move + (e[j + 1] + beta[j + 1])[:, None, :], 2)
        one = np.zeros_like(e)
        one[np.arange(t)[:, None], rows, y.T] = 1
        de = (np.exp(alpha + beta - z[:, None]) - one) / n
        dt = np.zeros_like(move)
        score = self.p["s"][y[:, 0]] + e[0][rows, y[:, 0]]
        for j in range(1, t):
            pair = np.exp(alpha[j - 1][:, :, None] + move + (e[j] + beta[j])[:, None, :] - z[:, None, None]).sum(0)
            np.add.at(pair, (y[:, j - 1], y[:, j]), -1)
            dt += pair / n
            score = score + move[y[:, j - 1], y[:, j]] + e[j][rows, y[:, j]]
        g = {"t": dt, "s": de[0].sum(0), "o": np.einsum("tnh,tnk->hk", both, de), "c": de.sum((0, 1))}
        dboth = de @ self.p["o"].T
        self._back(x, "f", kf, dboth[:, :, :HIDDEN], g)
        self._back(x, "b", kb, dboth[:, :, HIDDEN:], g)
        return float((z - score).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, passes: int = PASSES, rate: float = 0.01, seed: int = 9) -> list[float]:
        """Adam over shuffled batches of 64 windows; the mean loss of each pass."""
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        r, step, losses = np.random.default_rng(seed), 0, []
        for n in range(passes):
            order, loss = r.permutation(len(x)), []
            for a in range(0, len(x), 64):
                at = order[a : a + 64]
                value, g = self.gradients(x[at], y[at])
                loss.append(value)
                step += 1
                size = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
                for k, q in g.items():
                    q = q * min(1.0, 5.0 / (size + 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * q
                    v[k] = 0.999 * v[k] + 0.001 * q * q
                    self.p[k] = (self.p[k] - rate * 0.85**n * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(loss)))
        return losses


def labels(length: int, found: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in found:
        if not out[a:b].any():
            out[a] = 1 + 2 * KINDS.index(kind)
            out[a + 1 : b] = 2 + 2 * KINDS.index(kind)
    return out


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(parts), WINDOW), np.int64)
    for i, p in enumerate(parts):
        out[i, : len(p)] = p
    return out


def generated(n: int = MADE, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with labelled spans, and look-alikes that have none."""
    r = np.random.default_rng(seed)
    pick = lambda s, k: "".join(s[i] for i in r.integers(0, len(s), k))
    letters, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"

    def word() -> str:
        w = pick(letters, r.integers(2, 9))
        return (w.title() if r.random() < 0.2 else w) + ("", "", "", ",", ".", "!!", " |", "###")[r.integers(8)]

    def card() -> str:
        body = pick(digits, 15)
        full = next(body + d for d in digits if luhn(body + d))
        sep = ("", "", " ", "-")[r.integers(4)]
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = pick(digits, 3), pick(digits, 3), pick(digits, 4)
        return f"+{pick('123456789', 1)}" + (f" ({a}) {b}-{c}", f"-{a}-{b}-{c}", f" {a} {b} {c}", f"{a}{b}{c}")[r.integers(4)]

    make = {
        "email": lambda: f"{pick(letters, r.integers(2, 9))}{('', '.', '_')[r.integers(3)]}{pick(digits + letters, r.integers(1, 5))}@{pick(letters, r.integers(3, 9))}.{('com', 'org', 'example.com', 'net')[r.integers(4)]}",
        "ip": lambda: ".".join(str(r.integers(0, 256)) for _ in range(4)),
        "card": card,
        "phone": phone,
    }
    decoys = (lambda: pick(hexes, 40), lambda: f'token = "{pick(hexes, 40)}"', lambda: str(r.integers(1900, 2100)), lambda: f"{r.integers(0, 100)}.{r.integers(0, 100)}", lambda: pick(digits, r.integers(1, 8)), lambda: "AKIA" + pick("ABCDEFGHIJ0123456789", 16), lambda: f"@{pick(letters, 6)}", lambda: f"v{r.integers(0, 9)}.{r.integers(0, 30)}.{r.integers(0, 9)}", lambda: f"{r.integers(1, 29)}-{r.integers(1, 13)}-{r.integers(1990, 2030)}")
    out = []
    for _ in range(n):
        text, found = " ".join(word() for _ in range(r.integers(0, 7))), []
        for _ in range(r.integers(1, 3)):
            text += " " if text else ""
            if r.random() < 0.6:
                kind = KINDS[r.integers(len(KINDS))]
                piece = make[kind]()
                found.append((kind, len(text), len(text) + len(piece)))
                text += piece + ("", "", "", ".", ",", "!!")[r.integers(6)]
            else:
                text += decoys[r.integers(len(decoys))]()
            text += " " + " ".join(word() for _ in range(r.integers(0, 5)))
        out.append((text, found))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    """A tagger from generated lines and from base spans in a sample of ``docs`` (doc_id, text)."""
    some = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]"))
    lines = generated()
    taken = 0
    for text in sorted(r["text"] for r in sampled_texts(some, sample)):
        found = base_spans(text)
        for a, b in windows(text):
            inside = [(k, s - a, e - a) for k, s, e in found if a <= s and e <= b]
            if taken < REAL and not any(s < b and a < e and not (a <= s and e <= b) for _, s, e in found):
                lines.append((text[a:b], inside))
                taken += 1
    x = _padded([codes(t[:WINDOW]) for t, _ in lines])
    y = _padded([labels(len(t), f)[:WINDOW] for t, f in lines])
    tagger = Tagger()
    tagger.fit(x, y)
    return tagger


def reconcile(length: int, cuts: list[tuple[int, int]], tags: list[np.ndarray]) -> np.ndarray:
    """Labels of a whole text: each character's from the window in which it lies deepest, the first of equals."""
    out, depth = np.zeros(length, np.int8), np.full(length, -1, np.int16)
    for (a, b), t in zip(cuts, tags, strict=True):
        at = np.arange(b - a)
        deep = np.minimum(at, b - a - 1 - at)
        deep[at < STEP] += (a == 0) * WINDOW  # the text's own ends are no edges
        deep[b - a - 1 - at < STEP] += (b == length) * WINDOW
        better = deep > depth[a:b]
        out[a:b][better] = t[: b - a][better]
        depth[a:b][better] = deep[better]
    return out


def read_spans(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of the labels; an I that does not go on from its kind starts a span."""
    out, start, kind = [], 0, -1
    for i in np.append(np.nonzero(np.diff(tags, prepend=0))[0], len(tags)).tolist():
        tag = int(tags[i]) if i < len(tags) else 0
        now = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (now != kind or tag % 2):
            out.append((KINDS[kind], start, i))
            kind = -1
        if now >= 0 and kind < 0:
            start, kind = i, now
    return out


def _pieces(text: str, kind: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The span, or for more digits than a card has its blank-separated parts, trimmed of punctuation."""
    parts = [(a, b)]
    if kind == "card" and len(_NOT_DIGIT.sub("", text[a:b])) > DIGITS["card"][1]:
        parts = [(a + m.start(), a + m.end()) for m in re.finditer(r"\S+", text[a:b])]
    for a, b in parts:
        while a < b and not (text[a].isalnum() or text[a] == "+"):
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        yield a, b


def added(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The tagger's spans that can be what their tags say and touch no base span: numbers have a fitting count of digits,
    cards a right checksum, addresses no part above 255."""
    out = []
    for kind, start, end in found:
        for a, b in _pieces(text, kind, start, end):
            piece = text[a:b]
            digits = _NOT_DIGIT.sub("", piece)
            fits = DIGITS[kind][0] <= len(digits) <= DIGITS[kind][1] and digits.isascii()
            if kind == "email":
                fits = fits and 0 < piece.find("@") < len(piece) - 3
            elif kind == "ip":
                parts = re.findall(r"[0-9]+", piece)
                fits = fits and len(parts) == 4 and all(int(x) <= 255 for x in parts)
            elif kind == "card":
                fits = fits and luhn(digits)
            if fits and all(e <= a or b <= s for _, s, e in base):
                out.append((kind, a, b))
    return out


def _text_of(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all), n_added of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        tagger = held.value
        for batch in slices(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            base = [base_spans(t) for t in texts]
            cuts = [windows(t) for t in texts]
            parts = [codes(t[a:b]).astype(np.uint8) for t, c in zip(texts, cuts, strict=True) for a, b in c]
            tags = []
            for a in range(0, len(parts), 512):
                tags += list(tagger.decode(_padded(parts[a : a + 512])).astype(np.int8))
            out, at = [], 0
            for t, b, c in zip(texts, base, cuts, strict=True):
                more = added(t, b, read_spans(reconcile(len(t), c, tags[at : at + len(c)]))) if c else []
                at += len(c)
                out.append((*(sum(k == kind for k, _, _ in b) for kind in KINDS), hashlib.sha256(_text_of(b).encode()).hexdigest(), _text_of(b + more), len(more)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def op8_lstm_crf(spark, sf_dir: str) -> DataFrame:
    """Personal data in all of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    return find(docs, train(docs))
