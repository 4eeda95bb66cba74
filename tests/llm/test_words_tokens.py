"""Words and token ids against plain versions."""

import numpy as np
import public_tokenizers
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from lexloom.llm.tokens import encoder
from lexloom.llm.words import chunks, covered, gram_hashes, number_words, words_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TEXT = st.text(alphabet="ab é\n\t\x0b\x1c\x85\xa0 .'1<|", max_size=40)


def words(text: str) -> list[str]:
    return regex.findall(r"[^\x20\x09-\x0D]+", text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_of_several_texts(texts):
    w = number_words([t.encode() if t is not None else None for t in texts])
    got = [[w.vocab[i].decode() for i in w.ids[a:b]] for a, b in zip(w.starts[:-1], w.starts[1:])]
    assert got == [words(t or "") for t in texts]


def test_words_in_spark(spark):
    texts = ["a b", " a\t\tb\n", "", None, "x\x0b\x0cy\r", "é\xa0ü b"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.w for r in rows.select("i", words_of(F.col("text")).alias("w")).collect()}
    assert got == {i: words(t or "") for i, t in enumerate(texts)}


def test_gram_hashes_tell_windows_apart():
    w = number_words([b"a b c a b c a b d", b"a b c"])
    at = w.windows(3)
    assert at.tolist() == [0, 1, 2, 3, 4, 5, 6, 9]
    h = gram_hashes(w.hashes(), at, 3)
    assert h[0] == h[3] == h[7] and len(set(h.tolist())) == 4


def test_covered_and_chunks():
    assert covered(np.array([0, 4]), 2, 7).tolist() == [True, True, False, False, True, True, False]
    assert list(chunks([b"ab", None, b"c" * 9, b"d"], 4)) == [(0, 2), (2, 3), (3, 4)]
    assert list(chunks([])) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT, st.just("x <|endoftext|> y")), max_size=5))
def test_ids_equal_those_of_tokenizers(texts):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids, starts = encoder().encode(texts)
    for text, a, b in zip(texts, starts[:-1], starts[1:]):
        assert ids[a:b].tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_other_vocabularies_go_through_tokenizers():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids, _ = encoder(path).encode(["Hello there"])
    assert ids.tolist() == Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids
