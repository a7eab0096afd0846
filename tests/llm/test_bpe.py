"""Encoding and decoding against the tokenizers library and a plain merge loop."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import bpe
from corvane.runtime import table

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def both():
    return bpe.Codec(PATH), Tokenizer.from_file(PATH)


def same(both, texts):
    mine, library = both
    got = [np.frombuffer(x, "<i4").tolist() for x in mine.encode(texts)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert got == want
    rows = pa.array(got, pa.list_(pa.int32()))
    assert mine.decode(rows, False).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want]
    assert mine.decode(rows, True).to_pylist() == [library.decode(x, skip_special_tokens=True) for x in want]


def test_every_code_point(both):
    same(both, [f"x{chr(c)}y 1{chr(c)}{chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(both, texts):
    same(both, texts)


def test_specials_spaces_and_marks(both):
    letters = [*"abcdefghij'stlldvemre  \n\t\x1c\x1d\x1f\x85\xa0ΣσςİıǅÀ́̈éñ中日12٣<|>.!?'’", "<|endoftext|>", "<|startoftext|>", " <|endoftext|>x", "ſ"]
    draw = random.Random(5)
    same(both, ["".join(draw.choices(letters, k=draw.randint(0, 60))) for _ in range(5000)])


def test_long_pieces(both):
    draw = random.Random(6)
    same(both, ["a" * 5000, "ab" * 3001, "".join(draw.choices("abcdefghilmnoprstu", k=20000)), "", "a b " * 30000])


def plain(symbols, ranks):
    """Merges the leftmost pair of the lowest rank, again and again."""
    symbols = list(symbols)
    while found := [(ranks[p], k) for k, p in enumerate(zip(symbols, symbols[1:])) if p in ranks]:
        (rank, merged), k = min(found)
        symbols[k : k + 2] = [merged]
    return symbols


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_forest_against_plain_merges(data):
    pairs = data.draw(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=30, unique=True))
    merged = [data.draw(st.integers(0, 9)) for _ in pairs]
    ranks = {p: (k, m) for k, (p, m) in enumerate(zip(pairs, merged))}
    words = data.draw(st.lists(st.lists(st.integers(0, 9), min_size=1, max_size=20), min_size=1, max_size=8))
    forest = bpe.Forest(np.array(pairs), np.array(merged))
    out, counts = forest.merge(np.concatenate([np.array(w) for w in words]), np.array([len(w) for w in words]))
    assert [x.tolist() for x in np.split(out, np.cumsum(counts)[:-1])] == [plain(w, ranks) for w in words]


def test_memo_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    for k in range(20):
        same(both, [f"word{k} other{k}x plain", "z" * 1500])
    assert not any(isinstance(p, str) and len(p) > bpe.LONG for p in both[0].memo)


def test_query(spark, both):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = bpe.query(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = both[1].encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(both[1].decode(ids, skip_special_tokens=False)))


def test_odd_rows(spark, both):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, "")], "doc_id long, text string")
    docs = docs.select("*", *(F.lit("mine").alias(c) for c in ("ids", "n_tokens", "Batch")))
    rows = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.text) for r in rows) == [(0, 1, "c</w>"), (1, 2, "a</w> b</w>"), (1, 2, "a</w> b</w>"), (2, 0, ""), (3, 0, "")]
    assert bpe.encode(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [320, None, 999999, -4, 49407])], "doc_id long, ids array<int>")
    assert [r.text for r in bpe.decode(odd, PATH).orderBy("doc_id").collect()] == ["", both[1].decode([320, 49407], skip_special_tokens=False)]


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"))
