import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callmetrics.llm import bpe
from callmetrics.llm.q_bpe import vocabulary_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    with open(vocabulary_path(), encoding="utf-8") as file:
        return bpe.Bpe(file.read(), keep_words=2_000), tokenizers.Tokenizer.from_file(vocabulary_path())


def same(pair, texts):
    ours, library = pair
    ids = ours.encode_batch(texts)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert ids == [w.ids for w in want]
    assert [ours.decode(i) for i in ids] == [library.decode(w.ids, skip_special_tokens=False) for w in want]


def test_odd_texts(pair):
    same(pair, ["", " ", "<|endoftext|>x<|startoftext|>", "<|ENDOFTEXT|>", "it's WE'LL I'd", "ΣΑΣ İ ß é é", "\x1c\x1da\x85b\xa0c d", "漢字 👍🏽", "a" * 3000, "aba" * 2000, "0123 4.5"])


def test_words_that_share_beginnings(pair):
    rng = random.Random(4)
    same(pair, ["".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 25))) for _ in range(4000)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_any_text(pair, texts):
    same(pair, [t for t in texts if t.isprintable() or all(not 0xD800 <= ord(c) < 0xE000 for c in t)])


def test_operator(spark):
    rows = [(1, "Hello world", "x"), (2, None, "y"), (1, "Hello world", "x"), (3, "", None)]
    got = bpe.encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string, key string"), vocabulary_path()).collect()
    assert sorted((r.doc_id, r.key or "", len(r.ids)) for r in got) == [(1, "x", 2), (1, "x", 2), (2, "y", 0), (3, "", 0)]
    assert {r.decoded for r in got if r.doc_id == 1} == {"hello</w> world</w>"}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_and_decode(empty, vocabulary_path()).count() == 0
    clash = bpe.encode_and_decode(spark.createDataFrame([(1, "a")], "ids long, text string"), vocabulary_path())
    assert clash.columns == ["ids", "decoded"] and len(clash.first().ids) == 1
