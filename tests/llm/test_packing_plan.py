"""Plans of histograms with one length far more frequent than the others."""

import random

from facetloom.llm.packing import plan


def sequences(histogram):
    return sum(count for count, _ in plan(histogram))


def test_one_short_length_fills_its_sequences():
    assert sequences({40: 1000}) == 40
    assert sequences({33: 3100}) == 100


def test_a_hot_short_length_beside_others():
    rng = random.Random(4)
    for top in (300, 1024):
        histogram = {40: 1000}
        for _ in range(2000):
            n = rng.randint(33, top)
            histogram[n] = histogram.get(n, 0) + 1
        bound = sum(n * c for n, c in histogram.items()) / 1024
        assert sequences(histogram) <= 1.02 * bound + 1
