"""Encoding against the library, normalisation and spans against the library's own."""

import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerlens.llm import sentencepiece_codec as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CASES = ["", " ", "  a  b ", "\n\n", "a▁b", "😀 x\u0000y", "▁", "Zukeit  \t\n über ñ", "word\nword  \n x", "a" * 5000, "日本語 テキスト"]


@pytest.mark.parametrize("text", CASES)
def test_equals_library(text):
    check(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab \n▁\té😀日.x")), max_size=40))
def test_equals_library_on_any_text(text):
    check(text)


def check(text):
    own = C.codec(MODEL)
    got = own.encode(text)
    ids = own.library.encode(text)
    assert got.ids.tolist() == ids
    assert got.decimal.decode() == ",".join(map(str, ids))
    assert got.decoded.decode() == own.library.decode(ids)
    raw = text.encode()
    if ids:  # the spans tile the text in order
        assert got.starts[0] == 0 and got.ends[-1] == len(raw)
        assert (got.starts[1:] == got.ends[:-1]).all()


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
def test_normaliser_equals_library(rule):
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    spec = {}
    for number, _, value, _ in C.fields(library.serialized_model_proto()):
        if number == C.NORMALIZER:
            spec = {k: v for k, _, v, _ in C.fields(value)}
    own = C.Normalizer(C.CharsMap(spec.get(C.CHARSMAP, b"")), bool(spec.get(C.DUMMY_PREFIX, 1)), bool(spec.get(C.REMOVE_EXTRA, 1)), bool(spec.get(C.ESCAPE, 1)))
    for text in [*CASES, "ﬁne ①② Ⅷ ｶﾞ　x", "  A B  c​d ", "é é ＡＢＣ", "ЁЖ\tß"]:
        normal, origin = own(text.encode())
        assert normal.decode() == library.normalize(text)
        assert len(origin) == len(normal) + 1
        assert (origin[1:] >= origin[:-1]).all()


def test_table(spark):
    docs = spark.createDataFrame([(1, "a b", "z"), (2, None, "z"), (2, "", "z"), (3, "x\ny", "z")], "doc_id bigint, text string, ids string")
    own = C.codec(MODEL)
    for r in C.encode_digests(docs, MODEL).collect():
        text = {1: "a b", 2: "", 3: "x\ny"}[r["doc_id"]]
        assert r["n_tokens"] == len(own.library.encode(text))
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    encoded = C.encode_documents(docs, MODEL)
    assert sorted((r["doc_id"], r["text"]) for r in C.decode_documents(encoded, MODEL).collect()) == [(1, "a b"), (2, ""), (2, ""), (3, "x\ny")]
    assert C.encode_digests(docs.limit(0), MODEL).count() == 0
