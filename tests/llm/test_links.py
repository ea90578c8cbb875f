"""Links of fingerprints, whether a task holds a bucket or its signatures are dealt out, and how much is dealt out."""

import itertools
import random

import numpy as np
import pytest

from fieldloom.llm import simhash


def near_ones(seed, bases=40, each=15, flips=5, low=0):
    """Random fingerprints and copies with a few bits changed, of which all share the bits from ``low`` down."""
    rng = random.Random(seed)
    found = {rng.getrandbits(64 - low) << low for _ in range(bases)}
    for b in sorted(found):
        for _ in range(each):
            x = b
            for _ in range(rng.randint(1, flips)):
                x ^= 1 << rng.randrange(low, 64)
            found.add(x)
    return sorted(found)


def signed(prints):
    return [(x - (1 << 64) if x >> 63 else x,) for x in prints]


@pytest.mark.parametrize("low", [0, 16, 33])
@pytest.mark.parametrize("together, split_above", [(1, 4096), (1, 1), (20, 2), (10**6, 1)])
def test_links_of_crowded_and_small_buckets(spark, monkeypatch, low, together, split_above):
    monkeypatch.setattr(simhash, "_TOGETHER", 100)
    monkeypatch.setattr(simhash, "_PAIRS", 7)
    prints = near_ones(3 + low, low=low)
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame(signed(prints), "fp long"), split_above=split_above, together=together).collect()]
    values = [x for x, in signed(prints)]
    want = {(min(a, b), max(a, b)) for a, b in itertools.combinations(values, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3}
    assert len(want) > 100 and len(got) == len(want) and set(got) == want


def test_four_rows_of_a_fingerprint_are_dealt_out(spark):
    prints = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 3000).tolist()
    found = simhash.links(spark.createDataFrame([(x,) for x in prints], "fp long"))
    found.write.format("noop").mode("overwrite").save()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # before: 68 signatures of each, for the groups and once more for the join
    assert plan.count("Generate") == 1 and plan.count("Join") == 0
