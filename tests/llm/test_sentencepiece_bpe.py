"""The prefix table against the sentencepiece library, id by id."""
import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import sentencepiece_bpe as S
from tests_llm_util import frame, rows_of

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
OWN = S.PrefixTableCodec(PATH)
HARD = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "\n\n a", "a\n  b\n", "\t x", "▁a ▁", "<s></s><unk>", "<0x0A>",
        "é\U0001f600ß中文字 한국어", "\0\x01", "á", "x" * 5000, " " * 100 + "z", "ab" * 3000, "\r\nq", "  y",
        "aaaaaaaaaaaaa", "           code  =   1", "ﬁ ½ Å", "﻿b", "�"]


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    ids = OWN.encode(text)
    assert ids == LIB.encode(text)
    assert OWN.decode(ids) == LIB.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁\nabcdeit.,0 "), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    ids = LIB.encode(text)
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIB.decode(ids)
    n, a, b = OWN.digest(text)
    assert (n, a) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert b == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(3, 31999), max_size=12))
def test_decode_any_ids(ids):
    assert OWN.decode(ids) == LIB.decode(ids)


def test_prefix_table_has_the_last_piece_of_each_prefix():
    text = S.SPACE + "unhappinesses"
    for n, piece in list(enumerate(OWN.prefix_table(text)))[1:]:
        assert piece == LIB.encode(text[1:n].replace(S.SPACE, " "))[-1] if n > 1 else True


def test_query_on_whole_fixture(spark):
    from ledgerline.llm.queries import op4_sentencepiece
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in docs:
        ids = LIB.encode(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(LIB.decode(ids).encode()).hexdigest())
    got = {r.doc_id: tuple(r)[1:] for r in op4_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_nulls_repeats_empty_table_and_columns(spark):
    df = frame(spark, [(1, None, 5), (1, "a b", 6), (1, "a b", 7)], "doc_id long, text string, n_tokens int")
    got = rows_of(S.encode_digest(df, PATH))
    assert sorted(r.n_tokens for r in got) == [0, 2, 2]
    assert S.encode_digest(df.limit(0), PATH).count() == 0
    back = df.select(S.decode(S.encode(df.text, PATH), PATH).alias("t")).collect()
    assert sorted(r.t for r in back) == ["", "a b", "a b"]
