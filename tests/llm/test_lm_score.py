from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np

from sundew.llm import lm_score

SCHEMA = "doc_id long, text string, block long, part int"


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows):
    """id -> the contract's columns and the interpolated score, from dictionaries."""
    left = {i: zlib.crc32(str(i).encode()) % 10 for i, _ in rows}
    train = [(i, tokens(t)) for i, t in rows if left[i] != 0]
    uni, pair = Counter(), Counter()
    funi, fpair, fstarts = Counter(), Counter(), 0
    for i, t in train:
        uni.update(t)
        pair.update(zip([0, *t], t, strict=False))
        if left[i] == 1:
            funi.update(t)
            fpair.update(zip([0, *t], t, strict=False))
            fstarts += 1
    n, v = sum(uni.values()), len(uni)
    context = Counter({w: c for w, c in uni.items() if w is not None}) + Counter({0: len(train)})
    rest_n = n - sum(funi.values())
    seen: dict[int, list] = {}
    bucket = lambda c: 0 if c == 0 else 1 + int(math.log2(c))
    for i, t in train:
        if left[i] == 1:
            for a, b in zip([0, *t], t, strict=False):
                c = (len(train) - fstarts) if a == 0 else uni[a] - funi[a]
                seen.setdefault(bucket(c), []).append(((pair[a, b] - fpair[a, b]) / c if c else 0.0, (uni[b] - funi[b]) / max(rest_n, 1), 1 / (v + 1)))
    weights = {}
    for k in range(64):
        w = np.full(3, 1 / 3)
        if k in seen:
            p = np.array(seen[k])
            for _ in range(200):
                part = p * w
                part = (part / part.sum(1, keepdims=True)).sum(0) + 1
                w = part / part.sum()
        elif k > 1:
            w = weights[k - 1]
        weights[k] = w
    w0 = weights[0].copy()
    w0[0] = 0
    weights[0] = w0 / w0.sum()
    out = {}
    for i, text in rows:
        t = tokens(text)
        score = 0.0
        for a, b in zip([0, *t], t, strict=False):
            c, w = context[a], weights[bucket(context[a])]
            score += math.log10(w[0] * (pair[a, b] / c if c else 0.0) + w[1] * uni[b] / max(n, 1) + w[2] / (v + 1))
        base = sum(math.log10((uni[b] + 0.1) / (n + 0.1 * (v + 1))) for b in t)
        out[i] = (left[i] == 0, len(t), sum(uni[b] > 0 for b in t), n, base, score)
    return out


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH_TOKENS", 700)
    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcde") for _ in range(r.randint(1, 5))) for _ in range(150)]
    rows = [(i, " ".join(r.choice(vocabulary[: r.choice([5, 40, 150])]) for _ in range(r.randint(0, 120)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "never seen before"), (1003, "A " * 3000)]
    got = {x.doc_id: x for x in lm_score.lm_scores(spark.createDataFrame([(*x, 1, 1) for x in rows], SCHEMA)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, (held, n, known, total, base, score) in want.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held, n, known, total)
        assert abs(x.base_score - base) < 1e-6 * max(1, abs(base))
        assert abs(x.score - score) < 0.01 * max(1, abs(score))  # EM sees likelihoods in cells


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lm_score, "BATCH_TOKENS", 5000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lost = spark.range(1000).withColumnRenamed("id", "doc_id")
    forms = [docs, docs.repartition("doc_id"), docs.repartition(7), docs.join(lost, "doc_id", "left_semi")]
    got = [sorted((r.doc_id, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in lm_score.lm_scores(d).collect()) for d in forms]
    for other in got[1:]:
        assert [x[:3] for x in other] == [x[:3] for x in got[0]]
        assert all(abs(a[3] - b[3]) < 0.001 * max(1, abs(a[3])) for a, b in zip(other, got[0], strict=True))


def test_model_beats_its_base_on_held_out_texts(spark, sf_dir):
    rows = [x for x in lm_score.op4_deleted_interpolation(spark, sf_dir).collect() if x.held_out]
    assert sum(x.score for x in rows) > sum(x.base_score for x in rows)


def test_edge_cases(spark):
    made = lm_score.lm_scores(spark.createDataFrame([(None, "a b", 1, 1), (None, "a b", 1, 1), (3, None, 1, 1)], SCHEMA)).collect()
    assert len(made) == 3 and all(math.isfinite(x.score) for x in made)
    assert lm_score.lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0
