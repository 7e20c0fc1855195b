"""Token counts and SentencePiece against the libraries."""

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlens.llm import sentencepieces as sp
from cohortlens.llm import token_counts as tc

BPE = public_tokenizers.path(tc.TOKENIZER)
PIECES = public_tokenizers.path(sp.MODEL)
LONG = ["a" * 5000, "ab" * 3000 + " x", " " * 700, "é" * 900, "ing" * 2000, "the quick " * 900]
PARTS = st.sampled_from([*"ab  \n\t'sté½中🙂.,!09\x1c\x85\xa0▁<|>", "<|endoftext|>", "'ll", " the", "ing", "\r\n"])
texts = st.lists(PARTS, max_size=30).map("".join) | st.text(max_size=40)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_counts_of_any_text(library, text):
    assert tc.counter(BPE).count(text) == len(library[0].encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(texts)
def test_pieces_of_any_text(library, text):
    coder = sp.pieces(PIECES)
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<i4").tolist() == library[1].encode(text)
    assert coder.decode(ids) == library[1].decode(library[1].encode(text)) == text.replace("▁", " ")


@pytest.mark.parametrize("text", LONG)
def test_long_pretokens(library, text):
    assert tc.counter(BPE).count(text) == len(library[0].encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(sp.pieces(PIECES).encode(text), "<i4").tolist() == library[1].encode(text)


def test_stream_keeps_a_short_window(library):
    """Ids come out long before the end of a word without blanks."""
    coder = sp.pieces(PIECES)
    word = "▁" + "encyclopaedia" * 300
    parts = [word[i : i + 10] for i in range(0, len(word), 10)]
    handed = list(coder.stream(parts))
    assert len(handed) > 50 and max(map(len, handed)) < 40
    assert [i for some in handed for i in some] == library[1].encode(word[1:])


def test_memory_of_workers_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 5)
    monkeypatch.setattr(sp, "REMEMBERED", 5)
    counter, coder = tc.Counter(BPE), sp.Pieces(PIECES)
    text = " ".join(f"word{i}" for i in range(50))
    assert counter.count(text) == tc.counter(BPE).count(text)
    assert coder.encode(text) == sp.pieces(PIECES).encode(text)
    assert len(counter.known) <= 5 and len(coder.known) <= 5 and len(coder.former) <= 5


def test_token_counts_of_rows(odd_docs, odd_texts, no_docs, library):
    found = sorted(map(tuple, tc.token_counts(odd_docs).collect()), key=str)
    expected = []
    for doc_id, text in odd_texts:
        n = len(library[0].encode(text or "", add_special_tokens=False).ids)
        expected.append((doc_id, len((text or "").encode()), n, n > 1024))
    assert found == sorted(expected, key=str)
    assert tc.token_counts(no_docs).count() == 0


def test_pieces_of_rows(odd_docs, odd_texts, no_docs, library):
    found = sp.encoded(odd_docs)
    rows = [(r.doc_id, list(r.ids), r.n_ids, r.round_trip) for r in found.collect()]
    expected = [
        (i, ids := library[1].encode(t or ""), len(ids), True) for i, t in odd_texts
    ]
    assert sorted(rows, key=str) == sorted(expected, key=str)
    back = sorted((tuple(r) for r in sp.decoded(found).collect()), key=str)
    assert back == sorted(((i, (t or "").replace("▁", " ")) for i, t in odd_texts), key=str)
    assert sp.encoded(no_docs).count() == 0


def test_null_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [tuple(r) for r in sp.decoded(rows).orderBy("doc_id").collect()] == [(1, None), (2, "")]
