"""Encoding of long words against the library, and in time."""

import base64
import random
import string
import time

import public_tokenizers
import pytest
import sentencepiece

from fieldloom.llm import piece_bpe

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def names(library):
    found = [library.id_to_piece(i).replace("▁", "") for i in range(300, library.vocab_size())]
    return [x for x in found if x and not x.startswith("<")]


def test_small_limits_take_every_way(library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "CUT_CHARS", 4)
    monkeypatch.setattr(piece_bpe, "QUEUE_SYMBOLS", 6)
    rng, pieces, codec = random.Random(2), names(library), piece_bpe.PieceBpe(MODEL)
    for i in range(1500):
        text = "".join(rng.choice(pieces[: rng.choice([50, 400, 5000])]) for _ in range(rng.randint(1, 30)))
        if i % 5 == 0:
            text = "".join(rng.choice("thein ▁\n\x01é") for _ in range(rng.randint(1, 60)))
        codec.cache.forget()
        assert codec.encode([text])[0].tolist() == library.encode(text), repr(text)


@pytest.mark.parametrize("kind", ["th", "the", "a", "tion", "base64", "letters", "pieces", "common", "odd"])
def test_texts_without_spaces(library, kind):
    rng, pieces = random.Random(3), names(library)
    text = {
        "base64": lambda: base64.b64encode(rng.randbytes(750_000)).decode(),
        "letters": lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(10**6)),
        "pieces": lambda: "".join(rng.choice(pieces) for _ in range(200_000)),
        "common": lambda: "".join(rng.choice(pieces[:400]) for _ in range(300_000)),
        "odd": lambda: "\x01é" * 300_000,
    }.get(kind, lambda: kind * (10**6 // len(kind)))()
    began = time.perf_counter()
    got = piece_bpe.load(MODEL).encode(["word", text, "words and more"])
    assert time.perf_counter() - began < 15
    assert [x.tolist() for x in got] == library.encode(["word", text, "words and more"])
    assert piece_bpe.load(MODEL).decode(got[1]) == text


def test_tables(spark, library):
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, "x" * 100_000), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'other' as n_tokens")
    out = [tuple(r)[:2] for r in piece_bpe.encoding_report(docs, MODEL).collect()]
    assert sorted(out, key=str) == sorted([(i, len(library.encode(t or ""))) for i, t in rows], key=str)
    assert piece_bpe.encoding_report(docs.limit(0), MODEL).count() == 0
