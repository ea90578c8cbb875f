"""The language model's softmaxes: rows are taken in blocks, of any size and with any states, and no table of all rows is made."""

import tracemalloc

import numpy as np
import pytest

from fieldloom.llm import gru_lm


def model_of(rng, *shape, groups):
    model = gru_lm.Gru(*shape, groups=groups)
    model.begin(rng.integers(1, 99, model.words), rng.integers(1, 99, groups))
    return model


def plain(model, states, target):
    """Log-probabilities and gradients in double precision, row by row."""
    w = {k: v.astype(np.float64) for k, v in model.w.items()}
    found, back, grads = [], np.zeros(states.shape), {k: np.zeros_like(v) for k, v in w.items()}

    def layer(i, s, weights, bias, y, gw, gb):
        logits = s @ weights + bias
        p = np.exp(logits - logits.max())
        p /= p.sum()
        log = logits[y] - logits.max() - np.log(np.exp(logits - logits.max()).sum())
        p[y] -= 1
        gw += np.outer(s, p)
        gb += p
        back[i] += weights @ p
        return max(log, np.log(1e-30))

    for i, (s, y) in enumerate(zip(states.astype(np.float64), target.tolist())):
        k = y // model.class_words if y < model.words else y - model.words + model.classes
        total = layer(i, s, w["wc"], w["bc"], k, grads["wc"], grads["bc"])
        if y < model.words:
            total += layer(i, s, w["ww"][k], w["bw"][k], y - k * model.class_words, grads["ww"][k], grads["bw"][k])
        found.append(total)
    return np.array(found), back, grads


@pytest.mark.parametrize("rows", [1, 7, 1024])
@pytest.mark.parametrize("scale", [1, 400])  # the larger one is beyond what exp can hold
def test_blocks_equal_a_plain_softmax(monkeypatch, rows, scale):
    monkeypatch.setattr(gru_lm, "LAYER_ROWS", rows)
    rng = np.random.default_rng(3)
    model = model_of(rng, 4, 8, 6, groups=5)
    states, target = (scale * rng.standard_normal((60, 6))).astype(np.float32), rng.integers(0, model.first, 60).astype(np.int32)
    grads = {k: np.zeros_like(v) for k, v in model.w.items()}
    found, back = model.outputs(states, target, grads)
    want, want_back, want_grads = plain(model, states, target)
    assert np.allclose(found, want, rtol=1e-4, atol=1e-4) and np.allclose(model.outputs(states, target)[0], found, rtol=1e-6, atol=1e-6)
    assert np.allclose(back, want_back, atol=1e-3)
    for k in ("wc", "bc", "ww", "bw"):
        assert np.allclose(grads[k], want_grads[k], rtol=1e-3, atol=1e-3 * scale), k


def test_no_table_of_all_rows_is_made():
    rng = np.random.default_rng(4)
    model, n = model_of(rng, 32, 64, 24, groups=61), 1 << 16
    states, target = rng.standard_normal((n, 24)).astype(np.float32), rng.integers(0, model.first, n).astype(np.int32)
    grads = {k: np.zeros_like(v) for k, v in model.w.items()}
    tracemalloc.start()
    model.outputs(states, target, grads)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < n * (32 + 61) * 4  # floats of one such table
