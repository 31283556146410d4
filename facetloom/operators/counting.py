"""Counts of facet values: one pass over the rows for any number of facets.

Rows are grouped by what they show (spelling, label, group) with grouping sets, one set a facet, so that the map
side combines rows into counts at once. Only these counts, as many as there are spellings, are then folded to keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.operators.facets import Facet

RID = "__rid"
RANGES = 64  # in which the values of a facet are ranked, where there are that many
VALUES = "facet int, key string, value string, label string, grp string, first_rid long, total long, filtered long"


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contexts(facets: list[Facet], predicates: dict[str, Column]) -> dict[str, Column]:
    """Per facet the rows under every selection but its own. Facets without a selection share one context."""
    return {f.key: all_of([p for k, p in predicates.items() if k != f.key]) for f in facets}


def _spelled(f: Facet) -> Column:
    """(k, v) of each distinct folded item of a row, in the spelling that stands first."""
    items = F.col(f"__v_{f.key}")
    folded = F.transform(items, f.folded)
    return F.transform(F.array_distinct(folded), lambda k: F.struct(k.alias("k"), F.element_at(items, F.array_position(folded, k).cast("int")).alias("v")))


def _row_columns(f: Facet) -> dict[str, Column]:
    """The columns that rows are grouped by for a facet; labels that are functions of the value are left for later."""
    shown = {"v": F.col(f"__v_{f.key}") if f.valued else f.bucket()}
    for name, c in (("l", f.label), ("g", f.group)):
        if isinstance(c, Column):
            shown[name] = c.cast("string")
    return shown


def _entry(f: Facet, at: dict[str, Column]) -> dict[str, Column]:
    """key, value, label, grp of a facet from its grouped columns."""
    none, v = F.lit(None).cast("string"), at["v"]
    if not f.valued:
        return {"key": v.cast("string"), "value": v.cast("string"), "label": none, "grp": none}
    label, group = (at[n] if n in at else c(v).cast("string") if c is not None else none for n, c in (("l", f.label), ("g", f.group)))
    return {"key": f.folded(v), "value": f.text(v), "label": label, "grp": F.when(v.isNotNull(), group)}


def _pick(of: dict[int, dict[str, Column]], which: Column, name: str) -> Column:
    out = F
    for i, entry in of.items():
        out = out.when(which == i, entry[name])
    return out


def value_counts(rows: DataFrame, facets: dict[int, Facet], predicates: dict[str, Column], scope: Column | None) -> DataFrame:
    """``VALUES``: the values of the facets (by number) among all rows, counted in the scope and in their contexts.

    first_rid and spelling are those of all rows; in a scope, values without a row of it are gone, buckets are not.
    """
    facets = {i: f for i, f in facets.items() if f.kind != "text"}
    parts = [_single(rows, {i: f for i, f in facets.items() if f.kind != "multi"}, predicates, scope)]
    parts += [_multi(rows, i, f, predicates, scope) for i, f in facets.items() if f.kind == "multi"]
    parts = [p for p in parts if p is not None]
    if not parts:
        return rows.sparkSession.createDataFrame([], VALUES)
    counted = reduce(DataFrame.unionAll, parts)
    if any(f.valued and (f.item_type not in ("boolean", "tinyint", "smallint", "int", "bigint") or f.fold or f.label is not None or f.group is not None) for f in facets.values()):
        first = F.min_by(F.struct("value", "label", "grp"), "first_rid")
        counted = counted.groupBy("facet", "key").agg(first.alias("f"), F.min("first_rid").alias("first_rid"), F.sum("total").alias("total"), F.sum("filtered").alias("filtered"))
        counted = counted.select("facet", "key", "f.value", "f.label", "f.grp", "first_rid", "total", "filtered")
    if scope is not None:
        bucketed = [i for i, f in facets.items() if not f.valued]
        counted = counted.where((F.col("total") > 0) | F.col("facet").isin(bucketed))
    return counted


def _measures(scope: Column, contexts_: dict[str, Column]):
    """Aggregates for a row's total and each context among ``contexts_`` (name -> boolean column)."""
    return [F.min(RID).alias("first_rid"), F.count_if(scope).alias("total"), *[F.count_if(scope & c).alias(n) for n, c in contexts_.items()]]


def _flagged(rows: DataFrame, predicates: dict[str, Column], scope: Column | None, shown: list[Column]) -> tuple[DataFrame, dict[str, str]]:
    """The columns that counting reads: the selections a row fails as bits, and whether it is in the scope."""
    bits = {k: 1 << i for i, k in enumerate(predicates)}
    mask = reduce(lambda a, k: a + F.when(predicates[k], F.lit(0)).otherwise(bits[k]), bits, F.lit(0).cast("long"))
    inside = F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))
    return rows.select(RID, mask.cast("long").alias("__mask"), inside.alias("__in"), *shown), bits


def _single(rows: DataFrame, facets: dict[int, Facet], predicates, scope) -> DataFrame | None:
    if not facets:
        return None
    shown, names = [], {}
    for i, f in facets.items():
        names[i] = {n: f"__c{i}{n}" for n in _row_columns(f)}
        shown += [c.alias(names[i][n]) for n, c in _row_columns(f).items()]
    flagged, bits = _flagged(rows, predicates, scope, shown)
    fails = {"other": F.col("__mask") == 0} | {f"own{i}": F.col("__mask").bitwiseAND(F.lit(~bits[f.key])) == 0 for i, f in facets.items() if f.key in bits}
    columns = [c for i in facets for c in names[i].values()]
    if len(facets) == 1:
        counted, which = flagged.groupBy(*columns).agg(*_measures(F.col("__in"), fails)), F.lit(next(iter(facets)))
    else:
        sets = [[F.col(c) for c in names[i].values()] for i in facets]
        counted = flagged.groupingSets(sets, *[F.col(c) for c in columns]).agg(*_measures(F.col("__in"), fails), F.grouping_id().alias("__gid"))
        gid = {sum(1 << len(columns) - 1 - p for p, c in enumerate(columns) if c not in names[i].values()): i for i in facets}
        which = F.coalesce(*[F.when(F.col("__gid") == g, F.lit(i)) for g, i in gid.items()])
    counted = counted.withColumn("facet", which.cast("int"))
    entries = {i: _entry(f, {n: F.col(c) for n, c in names[i].items()}) for i, f in facets.items()}
    own = F.col("other")
    for i, f in facets.items():
        if f.key in bits:
            own = F.when(F.col("facet") == i, F.col(f"own{i}")).otherwise(own)
    return counted.select("facet", *[_pick(entries, F.col("facet"), n).alias(n) for n in ("key", "value", "label", "grp")], F.col("first_rid"), "total", own.alias("filtered"))


def _multi(rows: DataFrame, i: int, f: Facet, predicates, scope) -> DataFrame:
    fixed = {n: c for n, c in _row_columns(f).items() if n != "v"}
    flagged, bits = _flagged(rows, predicates, scope, [_spelled(f).alias("__pairs"), *[c.alias(f"__{n}") for n, c in fixed.items()]])
    each = flagged.select(RID, "__mask", "__in", F.explode_outer("__pairs").alias("__p"), *[f"__{n}" for n in fixed]).withColumn("__v", F.col("__p.v"))
    counted = each.groupBy("__v", *[f"__{n}" for n in fixed]).agg(*_measures(F.col("__in"), {"filtered": F.col("__mask").bitwiseAND(F.lit(~bits.get(f.key, 0))) == 0}))
    entry = _entry(f, {"v": F.col("__v"), **{n: F.col(f"__{n}") for n in fixed}})
    return counted.select(F.lit(i).alias("facet"), *[entry[n].alias(n) for n in ("key", "value", "label", "grp")], "first_rid", "total", "filtered")


def ranking(f: Facet) -> list[Column]:
    """Ascending, and no two values are equal in it: where row numbers repeat, so that values share the first, the key decides."""
    a, b = ("filtered", "total") if f.rank == "filtered" else ("total", "filtered")
    return [-F.col(a), -F.col(b), F.col("key").isNull(), F.col("first_rid"), F.col("key")]


def ranked(values: DataFrame, order: list[Column]) -> DataFrame:
    """The values of one facet with their rank, however many they are: ranges are numbered apart, and begin where the ranges
    before them end. A range is found from the values alone, so that it is the same in both readings, cached or not."""
    placed = values.withColumn("__at", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(order)]))
    sample = placed.select("__at").orderBy(F.xxhash64("__at"), "__at").limit(RANGES * 64)
    cuts = sample.agg(F.filter(F.sort_array(F.collect_list("__at")), lambda c, i: i % 64 == 63).alias("__cuts"))
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(RANGES.bit_length()))])
    below = F.aggregate(halves, F.lit(0), lambda n, s: F.when(F.get("__cuts", n + s - 1) <= F.col("__at"), n + s).otherwise(n))  # halving search
    parts = placed.crossJoin(F.broadcast(cuts)).withColumn("__part", below).drop("__cuts")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy("__at"))
    return parts.withColumn("__inside", inside).join(F.broadcast(starts), "__part").withColumn("rank", (F.col("__start") + F.col("__inside")).cast("int")).drop("__part", "__at", "__start", "__inside")


def stride_sample(rows: DataFrame, column: Column, most: int = 100_000) -> tuple[int, object, object, list]:
    """Count, least and largest of the values of ``column``, and a sorted sample of at most ``most``: every n-th in the order
    in which the rows are read. Two narrow passes; only one row a partition, then the sample, come to the driver."""
    values = rows.select(column.alias("v")).where("v IS NOT NULL")
    each = values.groupBy(F.spark_partition_id().alias("p")).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("p").collect()
    total = sum(r["n"] for r in each)
    if not total:
        return 0, None, None, []
    stride = max(1, -(-total // most))
    if stride > 1:
        starts, at = [], 0
        for r in each:
            starts.append((r["p"], at))
            at += r["n"]
        offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "p int, start long"))
        placed = values.select("v", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
        values = placed.join(offsets, "p").where((F.col("start") + F.col("i")) % stride == 0).select("v")
    return total, min(r["lo"] for r in each), max(r["hi"] for r in each), sorted(r[0] for r in values.collect())
