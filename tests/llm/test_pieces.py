"""SentencePiece codec against the library: odd texts, long ones without spaces, random ones, and the query over a table."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import pieces
from lodestone.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a", "  a  b ", "hello\tworld\n\nfoo", "▁x", "▁", "▁▁ ▁a", "ﬁ Ⅳ é é", "日本\x00語", "<s> </s> <unk>", "a　b\xa0c", "𝒳 🙂🙂 👩‍👩‍👧", "<0x41>A", " " * 40, "x" + " " * 17 + "y", "\n" * 30, "aaaaaaaaaaaaaaaaaaaaaaaaa", "the the thethe THE", "�￾\x7f\x01"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(PATH)


def same(own, library, texts):
    for t, c in zip(texts, own.encode(texts), strict=True):
        want = library.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(c, "<u4").tolist() == want, repr(t[:80])
        assert own.decode(np.array(want)) == library.decode(want), repr(t[:80])


def test_odd_texts(own, library):
    same(own, library, ODD)


@pytest.mark.parametrize("long", [0, 3, 10**9])
def test_rounds_and_heap_agree(library, long, monkeypatch):
    """All chunks through the heap, most of them, and none."""
    monkeypatch.setattr(pieces, "LONG", long)
    rnd = random.Random(long)
    letters = ["the", "ing", "a", "b", "aa", "é", "ß", " ", "  ", "▁", "\n", "日", "🙂", "0", "00", ".", "ion", "==", "--"]
    same(pieces.Pieces(PATH), library, ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 90))) for _ in range(800)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_text(texts):
    same(pieces.pieces(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH), texts)


def test_long_text_without_spaces(own, library):
    rnd = random.Random(3)
    same(own, library, ["".join(rnd.choice("etaoinshrdlu") for _ in range(200_000)), "ab" * 60_000, "=" * 50_000])


def test_memory_of_chunks_is_bounded(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 30)
    tool = pieces.Pieces(PATH)
    for k in range(0, 400, 7):
        same(tool, library, [" ".join(f"w{j}x" for j in range(k, k + n)) for n in (3, 14)])
        assert len(tool.known) <= 60


def test_decode_of_any_ids(own, library):
    rnd = random.Random(8)
    for _ in range(300):
        want = [rnd.choice([0, 1, 2, 259, 28705, rnd.randrange(259, 32000), rnd.randrange(259, 32000)]) for _ in range(rnd.randrange(12))]
        if 0 not in want:
            assert own.decode(np.array(want, np.int64)) == library.decode(want), want


def test_query(spark, library, tmp_path):
    rnd = random.Random(1)
    texts = [*ODD, None, "ab " * 3000, "the " * 2, "the " * 2, "".join(rnd.choice("abc dé") for _ in range(2_000_000))]
    rows = [(None if k == 3 else k % 20, t, "own", 7) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, packed int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op13_sentencepiece_codec"](spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    plain = pieces.ids(spark.read.parquet(f"{tmp_path}/documents.parquet").filter(F.length("text") < 100), PATH).collect()
    assert sorted(map(tuple, (tuple(r.ids) for r in plain))) == sorted(tuple(library.encode(t, add_bos=True, add_eos=True)) for t in texts if t is not None and len(t) < 100)
