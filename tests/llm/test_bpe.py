import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from logquarry.llm.bpe import WordBpe, digests
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
OWN, LIBRARY = WordBpe(PATH), Tokenizer.from_file(PATH)
TEXTS = [None, "", " ", "Hello  WORLD's 123 a<|endoftext|>bİX y <|STARTOFTEXT|> \x85q ​ z", "é ÀÉ don'T I'LL '''s \x1c\x1f kÅ ﬁ", "  <|startoftext|><|endoftext|> hi ", "ΑΣ ΌΣΟΣ.", "ab" * 3000, "the " * 5000 + "x" * 2000, "中文 กำ \U0001f600\U0001f600"]


def expected(text):
    e = LIBRARY.encode(text or "", add_special_tokens=False)
    return b"".join(i.to_bytes(4, "little") for i in e.ids), LIBRARY.decode(e.ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_as_the_library(text):
    got = OWN.encode(text)
    assert got == expected(text)
    assert OWN.decode(got[0]) == got[1]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", max_codepoint=0x24FF, exclude_categories=["Cn", "Cs"]), max_size=60))
def test_any_text(text):
    assert OWN.encode(text) == expected(text)


def test_query(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "same", None), (3, "same", None)]
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()}
    want = {(i, len(a) // 4, hashlib.sha256(a).hexdigest(), hashlib.sha256(b.encode()).hexdigest()) for i, t, _ in rows for a, b in [expected(t)]}
    assert got == want
    assert digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
