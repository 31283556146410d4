"""Stages of the pipeline against brute force."""

import random

import corpus_pipeline
from tests.llm.test_operators import truth

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts):
    return [(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]


def test_near_duplicates_are_those_of_five_words_and_80_percent(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    texts = []
    for share in (0.08, 0.13, 0.18, 0.24, 0.3):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(200)]
            added = [rng.choice(words) for _ in range(int(200 * share))]
            texts += [" ".join(base), " ".join(base + added)]
    for changed in (2, 4, 6):
        base = [rng.choice(words) for _ in range(200)]
        copy = list(base)
        for at in rng.sample(range(200), changed):
            copy[at] = "other"
        texts += [" ".join(base), " ".join(copy)]
    rows = rows_of(texts)
    want = {root for _, root in truth(rows, 5, 80).values()}
    assert want != {root for _, root in truth(rows, 3, 90).values()}
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(want)
