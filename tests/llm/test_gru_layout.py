"""Scores of the language model don't depend on how the input lies in files, and words are told apart by their bytes."""

import random

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import gru_lm
from fieldloom.llm.textbatch import text_values
from tests.llm.test_operators import SCHEMA


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "Ärger", "x."]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), "en", "s", 0) for i in range(300)]
    return [*out, (None, None, None, None, None), (7, "", "en", "s", 0), (8, "the same", "en", "s", 0), (8, "the same", "en", "s", 0), (9, " ".join(rng.choice(words) for _ in range(20_000)), "en", "s", 0)]


def test_equal_scores_for_any_number_of_files(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(gru_lm, "BUCKET_WORDS", 4000)
    found = []
    for files in (1, 4, 40):
        path = str(tmp_path / f"d{files}")
        mixed = rows[:]
        random.Random(files).shuffle(mixed)
        spark.createDataFrame(mixed, SCHEMA).repartition(files).write.parquet(path)
        out = gru_lm.score_documents(spark.read.parquet(path)).collect()
        found.append(sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6), r.score) for r in out))
    for other in found[1:]:
        assert [r[:5] for r in other] == [r[:5] for r in found[0]]
        assert np.allclose([r[5] for r in other], [r[5] for r in found[0]], rtol=1e-5, atol=1e-4)


def test_words_are_told_apart_by_their_bytes():
    one, other = thue_morse(4096, "a", "b"), thue_morse(4096, "b", "a")
    tokens = gru_lm.tokens_of(*text_values(pa.array([f"{one} {other} {one}", None, "", "A a Ä ä "])))
    assert tokens.sizes.tolist() == [4, 1, 1, 5]
    assert tokens.distinct.to_pylist() == [one.encode(), other.encode(), b"a", "Ä".encode(), "ä ".encode(), b""]
    assert tokens.numbers.tolist() == [0, 1, 0, 5, 5, 5, 2, 2, 3, 4, 5]
    assert tokens.groups[2] == 0 and tokens.groups[4] == 60


def test_words_that_only_held_out_documents_have(spark):
    import zlib

    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, "new new word", "en", "s", 0) if i in set(held) else (i, "old word", "en", "s", 0) for i in range(2000)]
    out = gru_lm.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_tokens, r.n_known) for r in out if r.held_out} == {(4, 2)}
    assert {(r.n_tokens, r.n_known) for r in out if not r.held_out} == {(3, 3)}


def test_average_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "ADDED_BY_ONE", 3)
    rng = np.random.default_rng(1)
    weights, n = rng.standard_normal((20, 5)).astype("<f4"), rng.integers(1, 9, 20)
    df = spark.createDataFrame([(i, int(n[i]), weights[i].tobytes()) for i in range(20)], "bucket long, n long, weights binary").repartition(4)
    got = np.frombuffer(gru_lm._average(df), "<f4")
    assert np.allclose(got, (weights * n[:, None]).sum(0) / n.sum(), atol=1e-6)
    assert gru_lm._average(df.limit(0)) is None
