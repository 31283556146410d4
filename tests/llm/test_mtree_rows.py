"""Repeated ids and rows, ties, many chunks of headers and a cell of equal vectors, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetloom.llm.mtree import MTreeIndex

SCHEMA = "vec_id long, embedding array<float>, q long, id long, page int, score long"


def brute(rows, k=5):
    v = [(i, np.floor(256 * np.asarray(e, np.float32).astype(float)).astype(int)) for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all()]
    out = []
    for a, (q, x) in enumerate(v):
        if q % 50 == 0:
            found = sorted((-int(x @ y), o) for b, (o, y) in enumerate(v) if a != b and len(x) == len(y))[:k]
            out += [(q, r, o, -s) for r, (s, o) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("page, leaf, headers", [(64, 8, 3), (32, 32, 1), (4096, 256, 4096)])
def test_every_row_is_one_of_its_own(spark, page, leaf, headers):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 12)) * 4
    rows = [(i, (centers[i % 6] + rng.normal(size=12) * 0.3).round(2).tolist()) for i in range(500)]
    rows += [(50, rows[7][1]), (50, rows[50][1]), (100, rows[100][1]), (100, rows[100][1]), (7, None), (None, rows[0][1]), (150, []), (200, [1.0, float("inf")]), (250, [0.5] * 3), (300, [0.25] * 3)]
    rows += [(1000 + i, [1.0] * 12) for i in range(300)]  # a cell of equal vectors, and ties without end
    df = spark.createDataFrame([(i, e, 1, 2, 3, 4) for i, e in rows], SCHEMA).repartition(5)
    got = MTreeIndex(page, leaf, 16, headers).fit(df, F.col("vec_id") % 50 == 0).top(5)
    assert sorted(map(tuple, got.collect())) == brute(rows)
