"""Piece ids and decoded text against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from corpus_fixtures import SF001, make_docs  # noqa: F401
from custlytics.llm import sentencepiece_bpe as S
from custlytics.llm.word_cache import from_bytes

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return S.Encoder(S.load_model(PATH))


def encode(encoder, texts):
    return [from_bytes(i).tolist() for i in encoder.encode(texts)]


ALPHABET = [" ", "  ", "    ", "\n", "\t", "a", "b", "th", "the", "▁", "日", "本", "𝕏", "é", "é", "ing", "0", "!", "<s>",
            "</s>", "<0x41>", "aaaa", " " * 17, "tion", "\x00", " ", "ab" * 5]


def test_random_texts_encode_and_decode_like_the_library(encoder, library):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    ids = encode(encoder, texts)
    assert ids == [library.encode(t) + [2] for t in texts]
    assert [encoder.model.decode(i) for i in ids] == [library.decode(i) for i in ids]


def test_any_ids_decode_like_the_library(encoder, library):
    rng = random.Random(2)
    some = [0, 1, 2, 3, 3 + 0x41, 3 + 0xC3, 3 + 0xA9, 3 + 0xE4, 3 + 0x80, 259, 260, 263, 5000, 28705]
    for _ in range(3000):
        ids = [rng.choice(some) for _ in range(rng.randint(0, 7))]
        assert encoder.model.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("text", ["x" * 9000, "abcde " * 3000, " " * 9000 + "thing" * 3000, "ab" * 5000, "the" * 900 + "▁" * 40])
def test_long_words_take_the_same_merges(encoder, library, text):
    assert encode(encoder, [text])[0] == library.encode(text) + [2]


def test_rounds_and_agenda_agree(encoder):
    rng = random.Random(4)
    model = encoder.model
    for _ in range(300):
        word = "▁" * rng.randint(1, 6) + "".join(rng.choice("abcdetinghos") for _ in range(rng.randint(1, 40)))
        sym, _ = model._symbols([word])
        assert from_bytes(model.encode_words([word])[0]).tolist() == model._agenda(sym).tolist()


def test_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in S.digests(S.encode_decode(docs, keep=["doc_id"])).collect():
        ids = library.encode(texts[r.doc_id]) + [2]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_edge_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (3, " "), (None, "a b"), (4, "a b"), (4, "a b")], extra={"ids": "clash", "decoded": "x"})
    rows = S.encode_decode(docs).collect()
    assert len(rows) == 6
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.ids, r.decoded))
    assert by_id[1] == by_id[2] == [([2], "")]
    assert by_id[3][0][1] == " "
    assert by_id[4] == by_id[None] * 2 and by_id[4][0][1] == "a b"
    assert S.encode_decode(docs.limit(0)).count() == 0


def test_ids_decode_in_a_table(spark, make_docs):
    encoded = S.encode_decode(make_docs([(1, "un éxemple  ▁ 日"), (2, None)]), decode=False)
    got = {r.doc_id: r.decoded for r in S.decode_ids(encoded).collect()}
    assert got == {1: "un éxemple    日", 2: ""}


def test_other_model_kinds_are_refused(tmp_path):
    with pytest.raises(Exception):
        (tmp_path / "m").write_bytes(b"no model")
        S.PieceModel(str(tmp_path / "m"))
