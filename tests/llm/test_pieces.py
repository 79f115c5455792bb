import random

import numpy as np
import pandas as pd
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.llm import pieces
from flowloom.llm.queries import PIECE_MODEL, QUERIES

CODER = pieces.Coder(open(PIECE_MODEL, "rb").read())
WORDS = ["the", "ing", "graphics", "======", "////////", "return", "ab\n\n", "springframework", "über", "漢字", "😀", "", " ", "responsibility", "x\u0000y"]
TEXT = st.one_of(st.lists(st.sampled_from(WORDS), max_size=20).map(" ".join), st.text(alphabet="ertionsahl=/-#* \n", max_size=80), st.text(max_size=30).filter(lambda t: pieces.SPACE not in t))


@settings(max_examples=400, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_chunks_give_the_library_s_ids(text, size):
    assert pieces.encode_by_chunks(CODER, text, size) == CODER.sp.encode(text)


@settings(max_examples=100, deadline=None)
@given(TEXT, st.integers(1, 9), st.integers(0, 5))
def test_product_is_associative(text, size, cut):
    parts = [pieces.Chunk(CODER, *x) for x in pieces.chunks_of(text, CODER.longest, size)] if text else []
    move = lambda m, n: {(i, (j[0] - n, j[1] - n)): w for (i, j), w in m.items()}
    m = [move(c.matrix(), c.end - c.left) for c in parts]
    for a, b, c in zip(m, m[1:], m[2:], strict=False):
        assert pieces.product(pieces.product(a, b), c) == pieces.product(a, pieces.product(b, c))


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=6), st.lists(st.lists(st.integers(0, 31999), max_size=8), max_size=5))
def test_whole_texts_and_decoding(texts, odd):
    ids = CODER.sp.encode(texts)
    assert [np.frombuffer(x, np.int32).tolist() for x in CODER.encode(texts)] == ids
    for lists in (ids, odd):
        flat = np.array([i for x in lists for i in x], np.int64)
        assert CODER.decode(flat, np.cumsum([0, *map(len, lists)])).to_pylist() == (CODER.sp.decode(lists) if lists else [])


def test_encoding_rows(spark, docs, with_clashes):
    r = random.Random(1)
    giant = " ".join(r.choice(WORDS) for _ in range(900))
    solid = "".join(r.choice("ertionsahl=/") for _ in range(3000))
    texts = [(1, None), (2, ""), (3, "plain text"), (4, giant), (4, giant), (5, solid), (6, "a ▁ b"), (7, giant + "!"), (None, "no id")]
    df = with_clashes(docs(texts))
    out, at, same = pieces.encode(df, PIECE_MODEL, chunk=256)
    rows = out.withColumn("back", pieces.decoder(spark, PIECE_MODEL)(F.col(at))).collect()
    assert out.columns == [*df.columns, at, same] and len(rows) == len(texts) and all(x[same] for x in rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for x in rows:
        assert x[at] == sp.encode(x.text or "")
        assert x.back == (x.text or "").replace(pieces.SPACE, " ")
    assert pieces.encode(df.limit(0), PIECE_MODEL)[0].count() == 0


def test_a_vocabulary_with_inner_word_starts_is_refused(monkeypatch):
    monkeypatch.setattr(pieces, "SPACE", "e")
    with pytest.raises(ValueError, match="word start"):
        pieces.Coder(open(PIECE_MODEL, "rb").read())


def test_query_equals_the_library(spark):
    out = QUERIES["op3_sentencepiece"](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    t = pd.read_parquet("/root/testdata/sf0.001/documents.parquet").set_index("doc_id").text
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    assert out.round_trip.all() and (out.n_tokens == t.map(lambda x: len(sp.encode(x)))[out.index]).all()
