from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sundew.llm import token_files

SCHEMA = "doc_id long, text string, ids long, n long, start long"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=60))
def test_coding_round_trip(values):
    values = np.array(values, np.uint32)
    control, data = token_files.pack(values)
    assert len(control) == -(-len(values) // 4)
    assert token_files.unpack(control, data, len(values)).tolist() == values.tolist()


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    return [t.encode(x or "", add_special_tokens=False).ids + [2] for x in texts]


HARD = [
    None, "", "  \n\t ", "Plain words, with marks!", "don't can't it's l'été d’accord", "ÀÉÎ straße ŒUVRE", "a<|endoftext|>b <|startoftext|>", "日本語 text 🙂🙂 mixed",
    "é combining ́alone", "no break wide  line", "x" * 5000, "1234567 3.14 a1b2", "##### | !!! a|b", "İstanbul ﬁn", "tab\tsep\x0bvt\x0cff\x00nul", "(a) [b] {c}; d: e? f&g's", "A.B.C u.s.a.", "ẛ̣ 가가",
]


def test_words_give_the_ids_of_whole_texts():
    words = token_files.WordTokens(token_files.default_tokenizer())
    for _ in range(2):  # fresh, then remembered
        got = [x.tolist() + [2] for x in words.encode_many(HARD)]
        assert got == direct(HARD)


def test_fresh_words_pass_in_parts_and_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "FRESH_WORDS", 3)
    words = token_files.WordTokens(token_files.default_tokenizer(), most=20)
    seen, tokenize = [], words._tokenize
    monkeypatch.setattr(words, "_tokenize", lambda fresh: seen.append(len(fresh)) or tokenize(fresh))
    for text in HARD * 2:  # every text forgets or keeps what the one before left
        assert words.encode(text).tolist() + [2] == direct([text])[0]
    assert max(seen) == 3
    assert len(words) <= 20 + max(len((t or "").split()) for t in HARD)


def test_files_hold_the_ids_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 50)
    rows = [(100 - i, t) for i, t in enumerate(HARD)] + [(None, "last one")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    token_files.write_tokens(df, f"{tmp_path}/t", token_files.default_tokenizer())
    got = sorted(token_files.read_tokens(spark, f"{tmp_path}/t").collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    rows.sort(key=lambda r: (r[0] is None, r[0]))
    at = 0
    for r, (doc_id, _), ids in zip(got, rows, direct([t for _, t in rows]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_table(spark):
    assert token_files.write_and_read(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_equals_direct_encoding(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.op2_token_files(spark, sf_dir).collect()}
    at = 0
    for (doc_id, _), ids in zip(docs, direct([t for _, t in docs]), strict=True):
        assert got[doc_id] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert len(got) == len(docs)
