import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tablescope.llm import pieces

from tests.conftest import SF001

from .conftest import run

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
with open(MODEL, "rb") as _f:
    TABLE = pieces.ChunkTable(_f.read())
HARD = [
    "", " ", "   ", "a", " a", "a ", "  a  b   ", "a\nb\t c\r\n", "é€𝄞\x00x", "a▁b ▁", "<s> </s> <unk> <0x0A>", "　x \xa0y", "é x",
    "a" + " " * 45 + "b", "​﻿x", "x" * 3000, "word " * 500, "日本語 テキスト", "�", "!!??..,,  --", "ﬁ x², ½ ",
]


def plain(text):
    ids = LIBRARY.encode(text or "", add_bos=True, add_eos=True)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_table_is_exact(limit):
    with open(MODEL, "rb") as f:
        table = pieces.ChunkTable(f.read(), limit)
    for t in HARD * 2:
        ids = LIBRARY.encode(t, add_bos=True, add_eos=True)
        packed, text = table.encode(t)
        assert np.frombuffer(packed, "<u4").tolist() == ids, repr(t)
        assert text == LIBRARY.decode(ids), repr(t)


def test_query_is_exact_on_all_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    out = run(spark, "op4_sentencepiece", SF001).collect()
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == plain(texts[r.doc_id])


def test_nulls_repeats_clashes_and_round_trip(spark, corpus):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), *((10 + i, t) for i, t in enumerate(HARD))]
    docs = spark.read.parquet(f"{corpus(rows)}/documents.parquet").selectExpr("*", "'x' AS ids", "'y' AS decoded", "'z' AS n_tokens")
    coded = pieces.encode(docs, MODEL)
    out = {r.doc_id: r for r in pieces.digest(coded).collect()}
    assert coded.count() == len(rows)
    for i, t in rows:
        assert tuple(out[i])[1:] == plain(t)
    back = pieces.decode(coded.select("doc_id", "ids", "decoded").withColumnRenamed("decoded", "first"), MODEL).collect()
    assert all(r.decoded == r.first for r in back)


def test_empty_table(spark, corpus):
    assert run(spark, "op4_sentencepiece", corpus([])).collect() == []


@pytest.mark.parametrize("piece,fine", [("a▁b", False), ("a.", False), ("1a", False), ("a\nb", False), ("▁▁ab", True), ("▁1.", True)])
def test_a_model_whose_pieces_cross_borders_is_refused(piece, fine):
    class Fake:
        def get_piece_size(self):
            return 2

        def id_to_piece(self, i):
            return ["▁a", piece][i]

        is_control = is_unknown = is_byte = lambda self, i: False

    if fine:
        return pieces.check_boundaries(Fake())
    with pytest.raises(ValueError):
        pieces.check_boundaries(Fake())


@given(st.text(st.one_of(st.sampled_from("ab é.,1_²½▁\n\t 　\x00日😀́-"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=1500, deadline=None)
def test_any_text(text):
    ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
    packed, back = TABLE.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids and back == LIBRARY.decode(ids)
