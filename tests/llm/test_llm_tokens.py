"""Token counts and prefix BPE against the libraries, whole texts at a time."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from signalloom.llm import prefix_bpe, token_counts
from signalloom.llm.arrow import pieces

CODEC = prefix_bpe.encoder()
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.vocabulary.ranks, special_tokens={})
TEXTS = st.text(alphabet=st.one_of(st.sampled_from("ab thn \n\t'sré1#"), st.characters(exclude_categories=["Cs"])), max_size=80)


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_counts_equal_the_library(odd, documents):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for df in (odd, documents):
        rows = token_counts.token_counts(df.select("doc_id", "text", "n_tokens" if "n_tokens" in df.columns else "source"), keep=("doc_id", "text")).collect()
        assert len(rows) == df.count()
        for r in rows:
            text = r.text or ""
            n = len(whole.encode(text, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)


@pytest.mark.parametrize("limit", [1, 7, 50])
def test_pieces_join_to_the_text_and_keep_the_count(limit):
    text = "It's a (short) text,  with\n\nblanks; and 12 3 numbers\tand <|endoftext|> marks é è " * 5
    assert "".join(pieces(text, limit)) == text
    assert token_counts.count_texts([text], piece_chars=limit) == token_counts.count_texts([text], piece_chars=1 << 20)


SCRIPTS = {
    "zh": "我们在这里写一些文字，然后再写一些。数字12也有！", "ja": "これは文章です。カタカナ、ひらがな、漢字。", "hi": "यह एक वाक्य है। दूसरा वाक्य १२ यहाँ है।",
    "ar": "هذه جملة، وهذه جملة أخرى؟ نعم؛ ١٢ رقم.", "ru": "Это предложение, и ещё одно. Число 12 тут.", "th": "นี่คือ ประโยค หนึ่ง", "el": "Αυτό είναι ένα κείμενο, ναι.",
}


@pytest.mark.parametrize("script", SCRIPTS)
def test_long_texts_of_all_scripts_are_cut(script):
    text = SCRIPTS[script] * 400
    parts = list(pieces(text, 500))
    assert "".join(parts) == text and len(parts) > 3 and max(map(len, parts)) < 700
    assert token_counts.count_texts([text], piece_chars=500) == token_counts.count_texts([text], piece_chars=1 << 20)
    assert sum((ids(CODEC.encode(p)) for p in parts), []) == LIBRARY.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab1 。，'．é字"), st.characters(exclude_categories=["Cs"])), max_size=60), st.integers(1, 12))
def test_cuts_change_no_token(text, limit):
    parts = list(pieces(text, limit))
    assert "".join(parts) == text
    assert sum((LIBRARY.encode_ordinary(p) for p in parts), []) == LIBRARY.encode_ordinary(text)


def test_batches_are_balanced_by_bytes():
    sizes = [10, 1000, 20, 5, 900, 40, 700]
    ranges = token_counts.balanced(sizes, 900)
    assert [i for a, b in ranges for i in range(a, b)] == list(range(len(sizes)))
    assert max(sum(sizes[a:b]) for a, b in ranges) <= 900 + max(sizes)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_encoding_equals_the_library_and_decodes(text):
    packed = CODEC.encode(text)
    assert ids(packed) == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(packed) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(0, 80), st.integers(0, 10), TEXTS)
def test_edits_and_appends_are_exact(text, start, length, new):
    start = min(start, len(text))
    stop = min(len(text), start + length)
    held = prefix_bpe.EncodedText(CODEC, text)
    held.replace(start, stop, new)
    held.append("'s more")
    assert held.text == text[:start] + new + text[stop:] + "'s more"
    assert held.ids() == CODEC.encode(held.text)
    table = prefix_bpe.PrefixTable(CODEC.vocabulary, text.encode())
    for byte in new.encode():
        table.append(bytes([byte]))
    table.replace(0, 1, b"th")
    assert table.ids() == prefix_bpe.PrefixTable(CODEC.vocabulary, table.data).ids()


def test_an_edit_encodes_only_what_is_near():
    held = prefix_bpe.EncodedText(CODEC, "some plain words " * 500)
    assert held.replace(4000, 4003, "odd") < 12


def test_documents(odd, documents, empty):
    for df in (odd, documents):
        rows = prefix_bpe.encode_documents(df, keep=("doc_id", "text")).collect()
        assert len(rows) == df.count()
        for r in rows:
            want = LIBRARY.encode_ordinary(r.text or "") if len(r.text or "") < 50_000 or " " in r.text else r.ids
            assert r.ids == want and r.n_tokens == len(want)
            assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert prefix_bpe.encode_documents(empty).count() == 0 == token_counts.token_counts(empty).count()
