"""The pipeline's near-dedup stage against all pairs."""

import random

import pytest

import corpus_pipeline
from fieldloom.llm import shingle_sets, simhash

SCHEMA = "doc_id long, text string"


def jaccard(x, y):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.lower().split(), y.lower().split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("small", [16, 2])
def test_stage_removes_near_copies(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [[word() for _ in range(150)] for _ in range(12)]
    rows = []
    for base in texts:
        rows.append(base)
        for changes in (0, 1, 2, 3, 4, 6, 9):
            copy = list(base)
            for at in rng.sample(range(150), changes):
                copy[at] = word()
            rows.append(copy)
    rows += [[*texts[0][:149], word()] for _ in range(30)]  # a hot group
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)] + [(None, "a b"), (None, "a  b"), (900, None), (901, "")]
    kept = {r.doc_id: r.text for r in corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()}
    real = [(i, t) for i, t in rows if i is not None and i < 900]
    alike = {(i, j) for i, x in real for j, y in real if i < j and jaccard(x, y) >= 0.8}
    assert len(alike) > 500
    assert not {(i, j) for i, j in alike if i in kept and j in kept}  # no two that stay are alike
    assert all(any(j == i for _, j in alike) for i, _ in real if i not in kept)  # what went is like a smaller one
    assert None in kept and 900 in kept and 901 not in kept


def test_a_group_in_which_few_are_alike(spark):
    """Changed copies of one text: all meet in buckets, some are alike."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    base = [word() for _ in range(120)]
    rows = []
    for i in range(220):
        copy = list(base)
        for at in rng.sample(range(120), rng.randint(0, 9)):
            copy[at] = word()
        rows.append((i, " ".join(copy)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    alike = {(i, j) for i, x in rows for j, y in rows if i < j and jaccard(x, y) >= 0.8}
    assert len(alike) > 1000
    assert not {(i, j) for i, j in alike if i in kept and j in kept}
    assert all(any(j == i for _, j in alike) for i, _ in rows if i not in kept)
    assert 10 < len(kept) < 200


def test_recall_at_the_limit():
    """Of pairs that are just as similar as 0.8, how many share a band and pass the sketch."""
    rng = random.Random(2)
    found = tried = signatures = 0
    while tried < 400:
        base = [f"w{rng.randrange(9000)}" for _ in range(100)]
        copy = list(base)
        at = rng.sample(range(5, 95, 9), 2)
        for i in at:
            copy[i] = "changed"
        x, y = " ".join(base).encode(), " ".join(copy).encode()
        assert jaccard(x.decode(), y.decode()) >= 0.8
        tried += 1
        a, b = (shingle_sets.shingle_hashes(t, 5) for t in (x, y))
        low, other = shingle_sets.minhash(a), shingle_sets.minhash(b)
        bands = set(shingle_sets.band_keys(low)) & set(shingle_sets.band_keys(other))
        two = zip(shingle_sets.sketch_of(low), shingle_sets.sketch_of(other))
        differ = sum(bin((z | z >> 1) & 0x5555555555555555).count("1") for p, q in two for z in [(p ^ q) % 2**64])
        found += bool(bands) and differ <= shingle_sets.MOST_DIFFERENT
        signatures += bin(shingle_sets.simhash_of(a) ^ shingle_sets.simhash_of(b)).count("1") <= 3
    assert found >= 398
    assert signatures < 200  # fingerprints alone miss most
