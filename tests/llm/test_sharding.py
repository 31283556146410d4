"""The law of the shards, groups of equal texts, and gapless slots, on the result of the registered query."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from facetloom.llm.sharding import KdSharder, op2_kd_sharding, sides

SCHEMA = "doc_id long, text string, lang string, source string, size long, part int, shard int"


def rows(copied):
    rng = random.Random(7)
    out = [(i, "".join(rng.choice("abc é") for _ in range(rng.randint(0, 300))), rng.choice(["en", "de", None]), f"s{i % 5}", 1, 2, 3) for i in range(3000)]
    for k, n in enumerate(copied):
        text = f"copy {k} " * 20
        out += [(10_000 * (k + 1) + i, text, rng.choice(["en", "fr"]), f"s{i % 3}", 1, 2, 3) for i in range(n)]
    return out + [(5000, None, None, None, None, None, None), (5001, "", "en", "s1", 0, 0, 0), (5002, "x" * 5000, "en", "s1", 0, 0, 0), (5002, "x" * 5000, "en", "s1", 0, 0, 0)]


@pytest.mark.parametrize("copied", [[], [30, 70, 90, 120, 130, 40], [900, 150, 140], [160] * 6])
def test_groups_below_a_shard_stay_whole_and_sizes_are_near_equal(spark, tmp_path, copied):
    given = rows(copied)
    spark.createDataFrame(given, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = op2_kd_sharding(spark, str(tmp_path)).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in given)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)} and {r.shard for r in got} == set(range(16))
    slots, sizes, where = defaultdict(list), Counter(), defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        where[r["size"], r.text_crc32].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    target, total = sum(sizes.values()) / 16, Counter()
    for i, t, *_ in given:
        total[size(t), zlib.crc32((t or "").encode())] += size(t)
    assert all(len(where[g]) == 1 for g, w in total.items() if 0.02 * target <= w <= target)
    assert all(len(where[g]) <= -(-w // target) + 1 for g, w in total.items() if w > target)
    assert max(sizes.values()) - min(sizes.values()) <= max(0.06 * target, 12_000)


def test_sides_leave_room():
    rng = random.Random(1)
    for _ in range(300):
        weights = [rng.randint(1, 90) for _ in range(rng.randint(0, 8))]
        left, right = rng.randint(100, 400), rng.randint(100, 400)
        while sum(weights) > 0.6 * (left + right):
            weights.pop()
        goes = sides([(w, rng.random()) for w in weights], left, right)
        assert sum(w for w, g in zip(weights, goes) if g) <= left and sum(w for w, g in zip(weights, goes) if not g) <= right


def test_repeated_use_and_empty_tables(spark):
    sharder = KdSharder(4)
    df = spark.createDataFrame(rows([50]), SCHEMA)
    first = sorted(map(tuple, sharder.assign(df).collect()), key=str)
    assert sharder.assign(df.where("false")).count() == 0
    assert sorted(map(tuple, sharder.assign(df).collect()), key=str) == first and {r[3] for r in first} == {0, 1, 2, 3}
    assert {r.shard for r in KdSharder(1).assign(df).collect()} == {0}
