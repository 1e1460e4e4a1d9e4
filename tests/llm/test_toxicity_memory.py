"""The working arrays of the toxicity model are bounded, and cutting them up changes no result."""

import random

import numpy as np

from folioflow.llm import toxicity as X


def rows():
    rng = random.Random(3)
    word = lambda: f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}"
    return [(" ".join([word() for _ in range(60)] + (["zzbad", "yyvile"] if k % 3 == 0 else [])), int(k % 3 == 0)) for k in range(300)]


def test_arrays_stay_small(monkeypatch):
    data = rows()
    whole = X.fit(data)
    plain, sizes = X.marginals, []

    def noted(emits, trans):
        sizes.append(sum(map(len, emits)))
        return plain(emits, trans)

    monkeypatch.setattr(X, "marginals", noted)
    monkeypatch.setattr(X, "BATCH_TOKENS", 1000)
    cut = X.fit(data)
    assert sizes and max(sizes) <= 1000 + 256
    assert np.allclose(cut.logistic, whole.logistic) and np.allclose(cut.trans, whole.trans)
    a, b = (X._scored(m, [t for t, _ in data])[0] for m in (whole, cut))
    assert np.allclose(a, b)


def test_a_batch_of_texts_is_bounded():
    assert X.BATCH_TOKENS <= 250_000  # eight arrays of doubles: 16 MB
