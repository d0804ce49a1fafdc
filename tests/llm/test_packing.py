import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callmetrics.llm import packing, q_packing

PATH = q_packing.vocabulary_path()
SCHEMA = "doc_id long, text string, part int, window string, ids string, offset long"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def same(library, texts):
    ours = packing.encoder(PATH)
    for text in texts:
        assert ours.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_every_code_point(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    same(library, ["".join(points[i : i + 512]) for i in range(0, len(points), 512)])
    same(library, ["a" + " a1".join(points[i : i + 512]) for i in range(0, 0x3100, 512)])


def test_hostile_texts(library):
    same(library, ["", " ", "a<|endoftext|>b", " <|endoftext|> x", "<|endoftext|>" * 3, "it's I'LL we'Ve", "\r\n x  y \t\n", " x  y", "  lead", "trail  ", "é́é", "x" * 3_000])


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aé 1.'\n\ts<|>endoftx日 "), max_size=80))
def test_stretches_change_nothing(text):
    from tokenizers import Tokenizer

    test_stretches_change_nothing.library = library = getattr(test_stretches_change_nothing, "library", None) or Tokenizer.from_file(PATH)
    encode = packing.encoder(PATH)._one
    parts = list(packing.stretches(text, 3))
    assert "".join(parts) == text
    assert [i for p in parts for i in encode.encode(p, allowed_special="all")] == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 5), st.integers(0, 4))
def test_windows(sizes, most_open, most_padding):
    windows, closed = packing.Windows(16, most_open, most_padding), []
    for i, n in enumerate(sizes):
        closed += windows.place(i, np.arange(n, dtype=packing.ID))
        assert len(windows.room) <= most_open and sorted(windows.room) == windows.room and len(windows.waiting) == len(windows.room)
    full, left = windows.leave()
    held = lambda window: sum(len(p[3]) // 4 for p in window)
    assert all(16 - most_padding <= held(w) <= 16 for w in closed + full) and all(0 < held(w) < 16 - most_padding for w in left)
    tokens = {}
    for doc, start, n, ids in (p for w in closed + full + left for p in w):
        assert n == sizes[doc]
        tokens.setdefault(doc, []).append((start, np.frombuffer(ids, packing.ID).tolist()))
    assert [[t for _, part in sorted(tokens[i]) for t in part] for i in range(len(sizes))] == [list(range(n)) for n in sizes]


def held_to_contract(rows, wanted, size, most_padding):
    """rows (doc_id, start, length, doc_tokens, sequence_id, offset, ids); wanted: sorted token lists of the documents."""
    sequences, documents = {}, {}
    for doc, start, length, n, sequence, offset, ids in rows:
        assert len(ids) == 4 * length and length > 0
        sequences.setdefault(sequence, []).append((offset, length))
        documents.setdefault((doc, n), []).append((start, np.frombuffer(bytes(ids), "<u4").tolist()))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size and (size - at <= most_padding or not at & (at - 1))
    assert {d: sorted(t for _, part in sorted(p) for t in part) for (d, _), p in documents.items()} == wanted


@pytest.mark.parametrize("partitions", [1, 7])
def test_pieces_and_sequences(spark, library, partitions):
    rng = random.Random(3)
    texts = {i: " ".join(rng.choice(("alpha", "beta", "gamma")) for _ in range(rng.choice((0, 1, 5, 30, 200)))) for i in range(150)} | {1_000: None, 1_001: "", 1_002: "x <|endoftext|> y"}
    frame = spark.createDataFrame([(i, t, 1, "clash", "clash", 2) for i, t in texts.items()], SCHEMA).repartition(partitions)
    rows = [tuple(r) for r in packing.pack(frame, PATH, 1, size=64, open_windows=4, most_padding=2).collect()]
    wanted = {i: sorted([*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in texts.items()}
    held_to_contract(rows, wanted, 64, 2)
    whole = {}
    for doc, start, length, n, *_, ids in rows:
        whole.setdefault(doc, bytearray(4 * n))[4 * start : 4 * (start + length)] = ids
    assert {d: np.frombuffer(bytes(b), "<u4").tolist() for d, b in whole.items()} == {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}


def test_long_repeated_and_empty(spark, library):
    long = "word and number 12, " * 40_000
    frame = spark.createDataFrame([(1, long, 0, "", "", 0), (2, "twice", 0, "", "", 0), (2, "twice", 0, "", "", 0), (None, "no id", 0, "", "", 0)], SCHEMA).coalesce(1)
    rows = packing.pack(frame, PATH, 1).collect()
    n = len(library.encode(long, add_special_tokens=False).ids) + 1
    assert sum(r.length for r in rows if r.doc_id == 1) == n and {r.doc_tokens for r in rows if r.doc_id == 1} == {n}
    assert sum(r.length for r in rows if r.doc_id == 2) == 2 * (len(library.encode("twice", add_special_tokens=False).ids) + 1)
    assert any(r.doc_id is None for r in rows)
    assert packing.pack(frame.limit(0), PATH, 1).collect() == []


def test_powers_and_size():
    assert packing.powers(0) == [] and packing.powers(1_500) == [1024, 256, 128, 64, 16, 8, 4]
    with pytest.raises(ValueError):
        packing.pack(None, PATH, 1, size=100)


def test_query(spark, library, tmp_path):
    rows = [(i, "some words " * i, 0, "", "", 0) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for r in q_packing.op13_packing(spark, str(tmp_path)).collect():
        ids = np.array([*library.encode("some words " * r.doc_id, add_special_tokens=False).ids, 1], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
