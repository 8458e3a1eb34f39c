import hashlib
import random

import public_tokenizers
import pytest
from edge_tables import ROWS, documents, edge_docs, empty_docs, with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from cartlift.llm import bpe
from conftest import SF001

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ours():
    with open(PATH, encoding="utf-8") as fh:
        return bpe.Tokenizer(fh.read())


@pytest.fixture(scope="module")
def library():
    t = Library.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(ours, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert ours.encode(text) == ids
    assert ours.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", "  \n", "Hello, World's 123", "a<|endoftext|>b <|startoftext|>", "ΟΔΥΣΣΕΥΣ Σ",
                                  "İI ẞß ﬁ", "é é ẛ̣", "日本語 テスト", "👩‍👩‍👧 😀", "x\x1cy\x85z", "I'VE don't 'll", "½²٣", "\x00"])
def test_cases(ours, library, text):
    same(ours, library, text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(ours, library, text):
    same(ours, library, text)


@pytest.mark.parametrize("letters", ["ab", "the", "aAéß!", "in g"])
def test_long_words_stream(ours, library, letters):
    rnd = random.Random(3)
    for n in (40, 127, 128, 129, 700, 5000):
        same(ours, library, "".join(rnd.choice(letters) for _ in range(n)))


def test_memory_of_the_transducer_is_bounded(ours):
    rnd = random.Random(4)
    enc, most = bpe.Encoder(ours.merges), 0
    for _ in range(20_000):
        enc.push(rnd.choice("abcdefinorst"))
        most = max(most, len(enc.symbols))
    assert most <= 8 * ours.merges.lookahead


def test_byte_level_decoding_is_incremental():
    alphabet = bpe.byte_alphabet()
    text = "né 😀 日"
    tokens = [alphabet[b] for b in text.encode()]  # one token a byte
    d = bpe.Decoder(tokens, set(), byte_level=True)
    out = [d.push(i) for i in range(len(tokens))]
    assert "".join(out) + d.flush() == text and out[1] == "" and out[2] == "é"
    broken = bpe.Decoder([alphabet[0xE6], alphabet[0x41]], set(), byte_level=True)
    assert broken.push(0) + broken.push(1) + broken.flush() == "�A"


def test_column_functions(spark, ours, library):
    docs = with_clashes(edge_docs(spark).drop("n_chars"))
    got = bpe.decode_column(bpe.encode_column(docs, PATH, ids_col="tok"), PATH, ids_col="tok").collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["tok"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.digest_tokens(empty_docs(spark), PATH).count() == 0


def test_query_against_the_library(spark, library):
    from cartlift.llm.queries import QUERIES
    got = {r["doc_id"]: r for r in QUERIES["op4_bpe"](spark, SF001).collect()}
    d = documents(SF001)
    assert len(got) == len(d)
    for i, t in zip(d.doc_id.tolist(), d.text):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
