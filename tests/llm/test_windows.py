"""Every pair of neighbouring words is scored, in training and after it."""

import numpy as np
import pytest

from redactlake.llm import toxicity


def test_scores_of_all_pairs():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 3, 1 << 12).astype(np.float32), -0.3, 0.25, 12)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    own = dict(zip(words, model.words(words).tolist()))
    for n in range(1, 8):
        for _ in range(20):
            ws = rng.choice(words, n).tolist()
            s = [own[w] for w in ws]
            best = max((a + b) / 2 for a, b in zip(s, s[1:])) if n > 1 else s[0]
            want = pytest.approx(1 / (1 + np.exp(-(best - 0.3))))
            assert model.texts([" ".join(ws)], {}) == [want]
            assert model.texts([" -- ".join(ws) + " ..."], {}) == [want], "punctuation is no word"
    assert model.texts(["... --", None, ""], {}) == [0.25] * 3


def test_windows_of_training():
    start, first = toxicity.windows(np.array([1, 2, 4]), 2)
    assert start.tolist() == [0, 1, 3, 4, 5] and first.tolist() == [0, 1, 2]
    s, width = np.array([1.0, 2, 4, 8, 16, 32, 64]), np.array([1, 2, 2, 2, 2])
    assert toxicity.means(s, start, width).tolist() == [1.0, 3.0, 12.0, 24.0, 48.0]
