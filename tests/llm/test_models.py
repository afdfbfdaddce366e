"""Language, quality and personal data: brute force for the exact parts, held-out accuracy for the learned ones."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sundew.llm import language, pii, quality
from sundew.llm.common import sampled_texts

DOCS = "doc_id long, text string, lang string, source string, lang_pred string, score double"


def ppm_bits(samples, text, order=language.ORDER):
    """Code length by dictionaries, byte by byte."""
    count: dict = {}
    for s in samples:
        raw = bytes(order) + s.lower().encode()
        for i in range(order, len(raw)):
            for o in range(order + 1):
                count.setdefault(raw[i - o : i], Counter())[raw[i]] += 1
    raw, bits = bytes(order) + text.lower().encode(), 0.0
    for i in range(order, len(raw)):
        for o in range(order, -1, -1):
            at = count.get(raw[i - o : i])
            if at is None:
                continue
            whole = sum(at.values()) + len(at)
            if raw[i] in at:
                bits -= math.log2(at[raw[i]] / whole)
                break
            bits -= math.log2(len(at) / whole)
        else:
            bits += 8
    return bits


def test_code_lengths_equal_brute_force():
    samples = {"x": ["the cat sat on the mat", "a cat"], "y": ["der Hund und die Katze", "größer"]}
    model = language.Model(samples)
    texts = ["the cat", "Die Katze größer", "zzz", "é", "the cat"]
    got = model.bits(texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert abs(got[i, j] - ppm_bits(samples[lang], t)) < 1e-9


def test_long_texts_are_coded_piece_by_piece(monkeypatch):
    samples = {"x": ["the cat sat on the mat", "a cat"], "y": ["der Hund und die Katze", "größer"]}
    texts = ["the cat " * 40, "", "Die Katze größer " * 9, "é", "x"]
    whole = language.Model(samples).bits(texts)
    for size in (1, 3, 64):
        monkeypatch.setattr(language, "PIECE", size)
        assert np.abs(language.Model(samples).bits(texts) - whole).max() < 1e-9


def test_samples_are_distinct_and_bounded(spark):
    rows = [("a", f"text {i}") for i in range(300)] + [("b", "the same")] * 500 + [("b", f"b {i}") for i in range(5)] + [("c", None)]
    df = spark.createDataFrame(rows, "lang string, text string")
    made = {}
    for r in sampled_texts(df, 40, "lang"):
        made.setdefault(r.lang, {})[r.text] = r.n
    assert len(made["a"]) == 40 and set(made["a"]) <= {t for x, t in rows if x == "a"}
    assert made["b"]["the same"] == 500 and len(made["b"]) == 6 and set(made) == {"a", "b"}
    again = sampled_texts(df.repartition(9), 40, "lang")
    assert sorted(map(repr, again)) == sorted(repr(r) for r in sampled_texts(df, 40, "lang"))
    assert len(sampled_texts(df, 100)) == 100 and sampled_texts(df.limit(0), 5) == []


def test_language_query_is_accurate_on_held_out_texts(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = language.op10_ppm_language(spark, sf_dir).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and r.lang_pred != "und" and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held) > 0


def test_language_edge_cases(spark):
    rows = [(i, t, lang, "s", "x", 0.5) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    rows += [(100, None, "en", None, None, None), (101, "", None, None, None, None), (102, "123 ...", "en", None, None, None), (None, "the dog", None, None, None, None), (103, "the dog " * 20_000, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    model = language.learned(df)
    got = {r.doc_id: r for r in language.predict(df, model).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (100, 101, 102))
    assert got[None].lang_pred == got[103].lang_pred == "en"
    kept = language.keep_identified(df, model)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {100, 101, 102}
    nothing = df.limit(0)
    assert language.learned(nothing) is None
    assert {r.lang_pred for r in language.predict(df, None).collect()} == {"und"}
    assert language.keep_identified(nothing, None).count() == 0


def test_quality_finds_toxic_and_junk_and_keeps_the_rest(spark, sf_dir):
    known = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in quality.op6_weak_quality(spark, sf_dir).collect() if r.doc_id in known]
    # In the other languages no word tells those labelled toxic from the rest; only copies share words (see the README).
    english = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang = 'en'").collect()}
    toxic = [r for r in rows if known[r.doc_id].toxic and r.doc_id in english]
    clean = [r for r in rows if not known[r.doc_id].toxic and known[r.doc_id].quality]
    assert sum(r.label == "toxic" for r in toxic) >= 0.8 * len(toxic)
    assert sum(not r.kept for r in toxic) >= 0.95 * len(toxic)
    assert sum(r.kept for r in clean) >= 0.9 * len(clean)


def dawid_skene(patterns, steps=200):
    """Posteriors of each pattern, from dictionaries."""
    good, junk, toxic, none = 0, 1, 2, 3
    post = {}
    for v in patterns:
        tally = [sum(x == c for x in v) * (3.0 if c == toxic else 2.0 if c == junk else 1.0) + 0.1 for c in (good, junk, toxic)]
        post[v] = [t / sum(tally) for t in tally]
    for _ in range(steps):
        total = sum(patterns.values())
        mass = [sum(n * post[v][c] for v, n in patterns.items()) for c in range(3)]
        prior = [(m + 1) / (total + 3) for m in mass]
        new = {}
        table = {}
        for j in range(len(next(iter(patterns)))):
            for c in range(3):
                row = [sum(n * post[v][c] for v, n in patterns.items() if v[j] == x) + 0.5 for x in range(4)]
                table[j, c] = [x / sum(row) for x in row]
        for v in patterns:
            log = [math.log(prior[c]) + sum(math.log(table[j, c][x]) for j, x in enumerate(v) if x != none) for c in range(3)]
            p = [math.exp(x - max(log)) for x in log]
            new[v] = [x / sum(p) for x in p]
        done = max(abs(a - b) for v in patterns for a, b in zip(new[v], post[v], strict=True)) < 1e-8
        if done:
            return new
        post = new
    return post


def test_label_model_equals_brute_force():
    r = np.random.default_rng(6)
    patterns = Counter()
    for _ in range(3000):
        true = r.choice(3, p=[0.7, 0.2, 0.1])
        patterns[tuple(int(3 if r.random() < 0.2 else true if r.random() < q else r.integers(0, 3)) for q in (0.9, 0.8, 0.6, 0.4))] += 1
    model, want = quality.LabelModel(dict(patterns)), dawid_skene(dict(patterns))
    for v in patterns:
        assert np.abs(model.posterior(list(v)) - want[v]).max() < 1e-6
    assert model.table[0].diagonal().min() > model.table[3].diagonal().min()  # the better labeller is found to be so


def test_quality_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "### $$$ 123"), (None, "a quiet day by the river and the sea."), (5, "word " * 60_000), (6, "You idiot, you pathetic loser, you are scum.")]
    made = {r.doc_id: r for r in quality.classify(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, label string")).collect()}
    assert len(made) == len(rows)
    assert all((made[i].label, made[i].score, made[i].kept) == ("junk", 0.0, False) for i in (1, 2, 3))
    assert quality.classify(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fits:
                out.append((kind, *m.span()))
    return out


def test_base_equals_plain_expressions():
    r = np.random.default_rng(8)
    for size in (5, 20, 60, 200):
        for _ in range(1500):
            text = "".join("a@.0123456789 -+()Zé_%"[i] for i in r.integers(0, 22, size))
            assert pii.base_spans(text) == plain_spans(text), text
    for text, spans in pii.generated(200, 3):
        assert pii.base_spans(text) == plain_spans(text), (text, spans)


def test_gradients_are_those_of_the_loss():
    tagger = pii.Tagger()
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    r = np.random.default_rng(1)
    x = r.integers(1, 129, (3, 7))
    y = np.array([[0, 1, 2, 2, 0, 3, 4], [0] * 7, [5, 6, 0, 7, 8, 8, 0]])
    _, g = tagger.gradients(x, y)
    for name in ("o", "t", "s", "c", "hf", "hb", "xf"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        held = tagger.p[name][at]
        loss = []
        for d in (1e-3, -1e-3):
            tagger.p[name][at] = held + d
            loss.append(tagger.gradients(x, y)[0])
        tagger.p[name][at] = held
        assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(g[name][at], rel=0.03, abs=1e-4), name


def test_windows_cover_and_reconcile():
    text = "x" * 500 + "a1" * 200 + "y" * 300 + "@"
    cuts = pii.windows(text)
    for i, ch in enumerate(text):
        if ch in "1@":
            assert any(a <= i < b for a, b in cuts)
    assert all(b - a <= pii.WINDOW for a, b in cuts)
    truth = pii.labels(len(text), [("card", 510, 560)])
    assert pii.read_spans(pii.reconcile(len(text), cuts, [truth[a:b] for a, b in cuts])) == [("card", 510, 560)]


def test_find_keeps_base_spans_and_handles_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "mail a.b@c.org now"), (4, "é 🙂 10.0.0.1 and 4111 1111 1111 1111"), (4, "é 🙂 10.0.0.1 and 4111 1111 1111 1111"), (5, "q " * 100_000 + "+1 (555) 123-4567"), (6, "1" * 20_000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, spans string, n_ip string")
    made = pii.find(df, pii.Tagger()).collect()
    assert len(made) == len(rows)
    for r, (doc_id, text) in zip(sorted(made, key=lambda r: repr(r.doc_id)), sorted(rows, key=lambda r: repr(r[0])), strict=True):
        base = plain_spans(text or "")
        assert r.doc_id == doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
    assert pii.find(df.limit(0), pii.Tagger()).count() == 0


def test_query_trains_on_the_table_and_keeps_base_spans(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    made = pii.op8_lstm_crf(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in made) == sorted(texts)
    for r in made:
        base = plain_spans(texts[r.doc_id] or "")
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))
        assert len([x for x in r.spans.split(",") if x]) == len(base) + r.n_added


def test_trained_tagger_finds_cards_that_the_base_drops(spark):
    """A number before a card makes one run of 20 digits and more, which the base drops whole."""
    rows = [(1, "call +1 (555) 123-4567 or a.b@c.org")] * 3 + [(2, "no data here 12 and 7")]
    tagger = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    texts = [f"in {year} {card} was used" for year in (2024, 31999, 1987) for card in ("4111111111111111", "5500000000000004", "4012888888881881")]
    found = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tagger).collect()
    assert all(r.n_card == 0 for r in found) and sum(r.n_added for r in found) >= 1


def test_tagger_learns_spans():
    lines = pii.generated(pii.MADE, 21)
    x = pii._padded([pii.codes(t[: pii.WINDOW]) for t, _ in lines])
    y = pii._padded([pii.labels(len(t), f)[: pii.WINDOW] for t, f in lines])
    tagger = pii.Tagger()
    losses = tagger.fit(x, y)
    assert losses[-1] < 0.3 * losses[0]
    fresh = [(t, f) for t, f in pii.generated(200, 22) if len(t) <= pii.WINDOW]
    tags = tagger.decode(pii._padded([pii.codes(t) for t, _ in fresh]))
    hit = total = 0
    for (_, found), row in zip(fresh, tags, strict=True):
        got = set(pii.read_spans(row))
        total += len(found)
        hit += sum(s in got for s in found)
    assert hit >= 0.7 * total
