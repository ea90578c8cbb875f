"""Stages on awkward tables, and what they leave behind."""

import glob

import corpus_pipeline
from fieldloom.llm import scratch
from tests.llm.test_operators import SCHEMA


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", row string, doc string, bands int, _doc int")


def test_stages_on_null_empty_repeated_and_long_rows(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, "the house of the tree is in the river and it was there for a day of light and stone so that all saw it", "en", "s", 1, "r", "d", 1, 2)]
    rows += [(None, None, None, None, None, None, None, None, None)] * 2 + [(2, "", "en", "s", 0, "r", "d", 1, 2), (3, long, None, "s", 5, None, "d", 1, 2), (3, long, None, "s", 5, None, "d", 1, 2)]
    docs = table(spark, rows)
    kept = corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 3]
    once = corpus_pipeline.STAGES[1][1](spark, docs, "")
    assert once.columns == docs.columns and sorted((r.doc_id for r in once.collect()), key=str) == [1, 2, 3]
    clean = corpus_pipeline.STAGES[2][1](spark, docs, "")
    assert clean.columns == docs.columns and clean.count() == 6 and clean.where("text is null").count() == 2
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, "")
    assert mixed.columns == docs.columns and mixed.where("doc_id = 3").count() % 2 == 0
    encoded = corpus_pipeline.STAGES[4][1](spark, docs, "")
    assert encoded.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and encoded.count() == 6
    assert encoded.where("doc_id is null and n_tokens = 0").count() == 2


def test_empty_table_through_all_stages_leaves_only_the_result(spark, tmp_path, monkeypatch):
    docs = table(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(scratch, "shared_folder", lambda spark: f"file://{tmp_path}/shared")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    left = glob.glob(f"{tmp_path}/shared/fieldloom/*")
    assert len(left) == 1 and "stage-piece_encoding" in left[0]
