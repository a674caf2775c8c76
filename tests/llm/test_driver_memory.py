"""What the driver makes from counters of fixed number needs little more than its result."""

import tracemalloc

import numpy as np

from scoreframe.llm import prefixes, toxicity


def test_frequency_classes_are_made_in_parts():
    counts = np.random.default_rng(1).integers(0, 1 << 20, prefixes.COUNTERS).astype(np.uint32)
    tracemalloc.start()
    classes = prefixes.frequency_classes(counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    some = np.round(prefixes.SCALE * np.log2(1.0 + counts[::1000])).astype(np.uint8)
    assert (classes[::1000] == some).all()
    assert peak < 3 * len(counts)


def test_words_of_texts_are_counted_alike_in_parts(monkeypatch):
    sample = [(n % 2, f"{'bad' if n % 2 else 'fine'} word {n % 7} here") for n in range(40)] + [(0, "")]
    whole = toxicity.train(sample)
    monkeypatch.setattr(toxicity, "TEXTS", 3)
    parts = toxicity.train(sample)
    assert whole["scale"] == parts["scale"]
    assert all((whole["parameters"][k] == parts["parameters"][k]).all() for k in whole["parameters"])
