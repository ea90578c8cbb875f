"""Each feature can reject a text by itself, and a single repeated line stays."""

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import quality_rules, textbatch

WORDS = [f"word{i}" for i in range(300)]
CLEAN = " ".join(WORDS[:60])
TEN = " ".join(WORDS[:10])


@pytest.mark.parametrize(
    "text, kept",
    [
        ("\n".join([*(" ".join(WORDS[i : i + 5]) for i in range(0, 40, 5)), "menu item", "menu item"]), True),
        ("\n".join(["menu item"] + [" ".join(WORDS[:20])] + ["menu item", "log"] * 3 + [" ".join(WORDS[20:40])]), False),  # f_lines: 5 of 9
        (f"{TEN} {' '.join(WORDS[10:60])} {TEN} {' '.join(WORDS[60:90])}", True),
        (" ".join(f"{TEN} {' '.join(WORDS[10 + 30 * i : 40 + 30 * i])}" for i in range(3)), False),  # f_repeats: 30 of 120
        (" ".join(w * 12 for w in WORDS[:60]), False),  # f_length
        (" ".join(f"{w}***" for w in WORDS[:60]), False),  # f_symbols
        (CLEAN.upper(), False),  # f_upper
    ],
)
def test_each_feature_can_reject(text, kept):
    stats = quality_rules.text_statistics(*textbatch.text_values(pa.array([CLEAN] * 200 + [text])))
    assert 100 * stats["n_repeat_words"][-1] <= 30 * stats["n_words"][-1]
    x = np.stack([stats[f] for f in quality_rules.FEATURES], 1).astype(float)
    mu, inv, _ = quality_rules.estimate(200, x[:-1].sum(0), x[:-1].T @ x[:-1], 1.0)
    d = x[-1] / quality_rules.SCALE - mu
    assert (d @ inv @ d <= quality_rules.chi2_quantile(1 - quality_rules.TAIL, len(quality_rules.FEATURES))) == kept
