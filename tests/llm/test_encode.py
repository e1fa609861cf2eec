import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm.encode import ByteBpe, PairTable, count_tokens, encode_corpus, load_tokenizer, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


TEXTS = ["", "a", "Hello world", "aaaaaaaaaaaaaaaaaaaaaaa", "a" * 3000, "ab" * 900 + "🎤" * 150, "   \n\n  x", "<|endoftext|>", "0123456789" * 30, "​​", " " * 500, "ß Straße 東京録音室 استوديو", "don't we'll I'VE", "\x00\x01\x7f"]


def check(bpe: ByteBpe, reference, texts):
    offsets, flat = bpe.encode_batch(texts)
    got = [flat[offsets[k] : offsets[k + 1]].tolist() for k in range(len(texts))]
    assert got == [e.ids for e in reference.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_against_library(reference):
    check(load_tokenizer(tokenizer_path()), reference, [*TEXTS, None])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=8))
def test_any_text(texts):
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    check(load_tokenizer(tokenizer_path()), t, texts)


def test_round_trip(reference):
    bpe = load_tokenizer(tokenizer_path())
    offsets, flat = bpe.encode_batch(TEXTS)
    assert [reference.decode(flat[offsets[k] : offsets[k + 1]].tolist(), skip_special_tokens=False) for k in range(len(TEXTS))] == TEXTS


def test_pair_table():
    keys = np.random.default_rng(1).choice(10**9, 5000, replace=False).astype(np.int64)
    table = PairTable(keys, np.arange(5000), np.arange(5000, dtype=np.int32))
    assert (table.rank[table.find(keys)] == np.arange(5000)).all()
    assert (table.find(np.array([[10**9 + 1, 10**9 + 2]])) == -1).all()


def test_frames(spark, reference):
    df = spark.createDataFrame([(1, "Hello", "x"), (2, None, "y"), (2, None, "y"), (3, "", None)], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids, r.text) for r in encode_corpus(df).collect())
    assert got == sorted([(1, reference.encode("Hello", add_special_tokens=False).ids, "Hello"), (2, [], None), (2, [], None), (3, [], "")], key=lambda r: (r[0], r[1], r[2] or ""))
    assert sorted(r.n_tokens for r in count_tokens(df).collect()) == [0, 0, 0, 1]
    assert encode_corpus(df.filter("false")).count() == 0
