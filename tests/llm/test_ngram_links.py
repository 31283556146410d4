"""n_links of the n-gram join against brute force, in families larger than a block of an uncommon n-gram."""

import random

import pytest

from facetloom.llm import ngram_join
from facetloom.llm.ngram_join import NgramJoin
from tests.llm.test_operators import documents, truth

SCHEMA = "doc_id long, text string"


def links(rows, n, percent):
    """Links to texts with other sets, a set counted once however many rows hold it."""
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    distinct = {s for s in sets.values() if s}
    degree = {s: sum(s != o and 100 * len(s & o) >= percent * len(s | o) for o in distinct) for s in distinct}
    return {i: degree.get(s, 0) for i, s in sets.items()}


@pytest.mark.parametrize("n, percent, block", [(3, 90, 512), (5, 80, 7)])
def test_links_of_large_families_are_counted_exactly(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    rng = random.Random(9)
    words = [f"x{i}" for i in range(300)]
    family = [rng.choice(words) for _ in range(300)]
    rows = [(i, text) for i, text, *_ in documents() if i < 1000]  # with the family of 50
    for i in range(2000, 2045):  # copies of very different lengths as well, so that size classes meet
        copy = list(family[: 300 - 3 * (i - 2000)])
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.n_links for r in NgramJoin(width=n, percent=percent).classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == links(rows, n, percent)


@pytest.mark.parametrize("most", [1, 40, 300])
def test_a_full_table_of_common_ngrams_loses_nothing(spark, most):
    """Where not all common n-grams fit the broadcast, the blocks of the others are found by counting."""
    rows = [(i, text) for i, text, *_ in documents() if i < 1000]
    rows += [(3000 + i, f"shared passage that stands in many texts {i} " + rows[i][1][:60]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    figures = lambda join: {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in join.classes(df).collect()}
    assert figures(NgramJoin(max_common=most)) == figures(NgramJoin())
    assert {i: n for i, (_, _, n) in figures(NgramJoin(max_common=most)).items()} == links(rows, 3, 90)


def test_hot_keys_are_dealt_to_several_tasks(spark, monkeypatch):
    """Copies, pivots and stars of many rows, with a few rows a task, give the same classes."""
    for name in ("hot_keys",):
        original = getattr(ngram_join, name)
        monkeypatch.setattr(ngram_join, name, lambda many, key, *a: original(many, key, 5, 100))
    rows = [(i, text) for i, text, *_ in documents()] + [(4000 + i, documents()[70][1]) for i in range(50)] + [(5000 + i, "") for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in NgramJoin().classes(df).collect()}
    assert got == truth(rows)
