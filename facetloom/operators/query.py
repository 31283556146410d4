"""Bounded questions to a dashboard: group by at most two dimensions, or list rows."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import nullcontext
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.errors import DashboardError
from facetloom.functions.instants import instant_of, period_of, utc_of
from facetloom.functions.names import resolve_name
from facetloom.functions.periods import GRANULARITIES
from facetloom.functions.selection import Interval, Selections
from facetloom.operators.counting import RID
from facetloom.operators.dashboard import bucket_interval
from facetloom.operators.facets import NUMERIC, aggregated, is_text, number

ROWS_DEFAULT, ROWS_MOST = 100, 10_000
#: Types that an aggregation buffer updates in place.
FIXED = (*NUMERIC, "boolean", "date", "timestamp", "timestamp_ntz")


@dataclass(frozen=True)
class Dimension:
    name: str
    period: str | None = None
    plain: bool = False
    alias: str | None = None

    @property
    def key(self) -> str:
        return self.alias or (f"{self.period.capitalize()}({self.name})" if self.period else self.name)


@dataclass(frozen=True)
class Value:
    """An aggregation over a facet or property, or, without one, the metric ``name``. Count needs no name."""

    name: str | None = None
    aggregation: str | None = None
    alias: str | None = None

    @property
    def key(self) -> str:
        return self.alias or (self.name if self.aggregation is None else "Count" if self.aggregation == "count" else f"{self.aggregation.capitalize()}({self.name})")


@dataclass(frozen=True)
class Order:
    key: str
    descending: bool = False


@dataclass(frozen=True)
class Query:
    """``where``: a condition, SQL text, or a function of the rows that returns a condition."""

    group_by: tuple = ()
    values: tuple = ()
    columns: tuple = ()
    selections: Selections = field(default_factory=Selections)
    where: Column | str | Callable[[DataFrame], Column] | None = None
    order_by: Order | None = None
    take: int | None = None


@dataclass(frozen=True)
class ColumnInfo:
    key: str
    role: str
    kind: str
    source: str | None = None
    aggregation: str | None = None
    granularity: str | None = None


@dataclass
class QueryResult:
    """``df``: a range cell is a struct (index, from, to, from_inclusive, to_inclusive), a period cell one of (start, from,
    to, granularity), where from and to are instants; other cells are plain values."""

    df: DataFrame
    columns: list[ColumnInfo]
    whole: DataFrame
    take: int | None
    dash: object = None
    cancellation: object = None

    def _under(self):
        return self.cancellation.on(self.df.sparkSession) if self.cancellation else nullcontext()

    def collect(self) -> list:
        with self._under():
            return self.df.collect()

    @property
    def total(self) -> int:
        """Groups or rows before the cut."""
        with self._under():
            return self.whole.count()

    def labelled(self) -> DataFrame:
        """``df`` with a column ``<key> label`` beside each column of a labelled facet, in the same order."""
        out, names = self.df.withColumn("__at", F.monotonically_increasing_id()), []
        for c in self.columns:
            names.append(c.key)
            f = self.dash.facets.get(c.source)
            if c.kind == "value" and c.role != "value" and f is not None and f.label is not None and f.kind != "multi":
                known = self.dash.dictionary(c.source).select(F.col("key").alias("__key"), F.col("label").alias(f"{c.key} label"))
                out = out.join(known, f.folded(F.col(c.key)).eqNullSafe(F.col("__key")), "left").drop("__key")
                names.append(f"{c.key} label")
        return out.orderBy("__at").select(*[F.col(f"`{n}`") for n in names])

    @property
    def is_cut(self) -> bool:
        return self.take is not None and self.total > self.take


def selection_of(info: ColumnInfo, cell):
    """What a cell stands for in a selection: an interval, or the value itself."""
    if cell is not None and info.kind == "interval":
        return Interval(cell["from"], cell["to"], not cell["from_inclusive"], not cell["to_inclusive"])
    if cell is not None and info.kind == "period":
        from datetime import timezone

        return Interval(*(cell[c].astimezone(timezone.utc) for c in ("from", "to")), False, True)
    return cell


def run(dash, q: Query, cancellation=None) -> QueryResult:
    if cancellation is not None:
        cancellation.check()
    if q.take is not None and q.take < 0:
        raise DashboardError("take can't be negative", "take")
    for k in q.selections.keys():
        dash.facet(k)
    rows = dash.matching(q.selections, q.where)
    result = _rows(dash, q, rows) if q.columns else _groups(dash, q, rows)
    result.dash, result.cancellation = dash, cancellation
    return result


def _dtype(dash, name: str) -> str:
    return dict(dash.df.dtypes)[name]


def _dimension(dash, d: Dimension, path: str):
    """The facet or property's key column, the shown value, its info, and whether rows stand in several groups."""
    kind, name = resolve_name(dash, d.name, d.plain, path)
    if kind == "metric":
        raise DashboardError(f"{name} is a metric, not a dimension", path)
    if d.period is not None and d.period not in GRANULARITIES:
        raise DashboardError(f"unknown period {d.period}", path)
    if kind == "facet":
        f = dash.facets[name]
        if f.kind == "text":
            raise DashboardError(f"the text facet {name} can't be a dimension", path)
        if d.period and f.kind != "date":
            raise DashboardError(f"{name} has no periods", path)
        if f.kind == "range":
            return dash.shaped(name).bucket(), None, ColumnInfo(d.key, "dimension", "interval", name), dash.shaped(name)
        if f.kind == "date":
            unit = d.period or dash.shaped(name).unit
            return f.local_period(F.col(f"__v_{name}"), unit), None, ColumnInfo(d.key, "dimension", "period", name, granularity=unit), f
        return F.col(f"__k_{name}"), F.col(f"__v_{name}"), ColumnInfo(d.key, "dimension", "value", name), f
    dtype, c = _dtype(dash, name), F.col(name)
    if d.period:
        if dtype not in ("timestamp", "timestamp_ntz", "date"):
            raise DashboardError(f"{name} has no periods", path)
        return period_of(utc_of(c, dtype, "UTC"), "UTC", d.period), None, ColumnInfo(d.key, "dimension", "period", name, granularity=d.period), None
    if dtype.startswith(("struct", "map", "binary")):
        raise DashboardError(f"{name} can't be grouped by", path)
    fold = F.lower if is_text(dtype) else (lambda x: x)
    if dtype.startswith("array<"):
        items = F.filter(F.coalesce(c, F.array().cast(dtype)), lambda x: x.isNotNull())
        return F.array_distinct(F.transform(items, lambda x: fold(x))), items, ColumnInfo(d.key, "dimension", "value", name), "array"
    return fold(c), c, ColumnInfo(d.key, "dimension", "instant" if dtype.startswith("timestamp") else "date" if dtype == "date" else "value", name), None


def _number(dash, name: str, path: str) -> Column:
    kind, name = resolve_name(dash, name, False, path)
    if kind == "facet":
        f = dash.facets[name]
        if f.kind == "range":
            return F.col(f"__v_{name}")
        if f.kind == "value" and (f.dtype in NUMERIC or f.dtype.startswith("decimal")):
            return number(F.col(f"__v_{name}"))
    elif kind == "property" and (_dtype(dash, name) in NUMERIC or _dtype(dash, name).startswith("decimal")):
        return number(F.col(name))
    raise DashboardError(f"{name} isn't a number", path)


def _distinct(dash, name: str, path: str) -> tuple[Column, bool]:
    """What is told apart, and whether a row holds several."""
    kind, name = resolve_name(dash, name, False, path)
    if kind == "facet":
        f = dash.facets[name]
        if f.kind == "text":
            raise DashboardError(f"{name} can't be counted", path)
        if f.kind in ("range", "date"):
            v = F.col(f"__v_{name}")
            return (v + F.lit(0.0) if f.kind == "range" else v), False
        return F.col(f"__k_{name}"), f.kind == "multi"
    if kind == "metric":
        raise DashboardError(f"{name} is a metric", path)
    dtype, c = _dtype(dash, name), F.col(name)
    if dtype.startswith("array<"):
        return (F.transform(c, F.lower) if is_text(dtype) else c), True
    return (F.lower(c) if is_text(dtype) else c), False


def _cell(info: ColumnInfo, f, key: Column) -> Column:
    """The shown cell of a grouped range or period; null for the group without a value."""
    if info.kind == "interval":
        parts = [bucket_interval(f, b) for b in range(max(len(f.edges) - 1, 0))] or [Interval()]
        bounds = [F.struct(F.lit(p.lo).cast("double").alias("from"), F.lit(p.hi).cast("double").alias("to"), F.lit(not p.lo_open).alias("from_inclusive"), F.lit(not p.hi_open).alias("to_inclusive")) for p in parts]
        at = F.element_at(F.array(*bounds), key + 1)
        return F.when(key.isNotNull(), F.struct(key.alias("index"), *[at[n].alias(n) for n in ("from", "to", "from_inclusive", "to_inclusive")]))
    days, months = {"day": 1, "week": 7}.get(info.granularity), {"month": 1, "quarter": 3, "year": 12}.get(info.granularity)
    following = F.date_add(key, days) if days else F.add_months(key, months)
    zone = f.zone if f is not None else "UTC"
    start, end = (instant_of(utc_of(x, "date", zone)) for x in (key, following))
    return F.when(key.isNotNull(), F.struct(key.alias("start"), start.alias("from"), end.alias("to"), F.lit(info.granularity).alias("granularity")))


def _groups(dash, q: Query, rows: DataFrame) -> QueryResult:
    dims = [Dimension(d) if isinstance(d, str) else d for d in q.group_by]
    if len(dims) > 2:
        raise DashboardError("at most two dimensions", "groupBy[2]")
    values = [Value(v) if isinstance(v, str) else v for v in q.values] or [Value(aggregation="count")]
    keys = [x.key for x in [*dims, *values]]
    if len(set(keys)) < len(keys):
        again = next(k for i, k in enumerate(keys) if k in keys[:i])
        raise DashboardError(f"the column {again} is there twice", "values")
    infos, names, facets = [], [], []
    for i, d in enumerate(dims):
        key, shown, info, f = _dimension(dash, d, f"groupBy[{i}]")
        infos.append(info)
        facets.append(f)
        several = f == "array" or getattr(f, "kind", None) == "multi"
        if several:
            if shown is not None:
                fold = f.folded if f != "array" else F.lower if is_text(_dtype(dash, info.source)) else (lambda x: x)
                pairs = _spelled(shown, fold)
            rows = rows.withColumn(f"__p{i}", F.explode_outer(pairs)).withColumn(f"__d{i}", F.col(f"__p{i}.k")).withColumn(f"__s{i}", F.col(f"__p{i}.v"))
        else:
            rows = rows.withColumn(f"__d{i}", key).withColumn(f"__s{i}", shown if shown is not None else key)
        names.append(f"__d{i}")
    aggs, later, sides = [], [], []
    metrics = {m.key: m for m in dash.metrics}
    for j, v in enumerate(values):
        path = f"values[{j}]"
        if v.aggregation is None:
            if v.name not in metrics:
                resolve_name(dash, v.name, False, path, only="metric")
            m = metrics[v.name]
            if m.aggregation == "calculated":
                later.append((v.key, m))
            else:
                aggs.append(m.aggregate().alias(v.key))
        elif v.aggregation == "count":
            aggs.append(F.count(F.lit(1)).alias(v.key))
        elif v.aggregation == "distinct":
            what, several = _distinct(dash, v.name, path)
            if several:
                sides.append((v.key, what))
            else:
                aggs.append(F.nullif(F.count_distinct(what), F.lit(0)).alias(v.key))
        elif v.aggregation in ("sum", "average", "min", "max"):
            aggs.append(aggregated(v.aggregation, _number(dash, v.name, path)).alias(v.key))
        else:
            raise DashboardError(f"unknown aggregation {v.aggregation}", path)
        infos.append(ColumnInfo(v.key, "value", "number", v.name, v.aggregation or metrics[v.name].aggregation))
    need = [m for m in dash.metrics if m.aggregation != "calculated"] if later else []
    aggs += [m.aggregate().alias(f"__m_{m.key}") for m in need]
    # what a group shows is read from its first row, unless it is made from the group's key. Texts are looked up among
    # the groups' spellings: a text in an aggregation buffer would have all rows sorted
    read = [i for i, info in enumerate(infos[: len(dims)]) if info.kind not in ("interval", "period")]
    kinds = dict(rows.dtypes)
    fixed = [F.min_by(f"__s{i}", RID).alias(f"__o{i}") for i in read if kinds[f"__s{i}"] in FIXED]
    spelled = [i for i in read if kinds[f"__s{i}"] not in FIXED]
    made = rows.groupBy(*names).agg(F.min(RID).alias("__first"), *fixed, *aggs) if names else rows.agg(F.min(RID).alias("__first"), *aggs)
    if spelled:
        texts = [f"__s{i}" for i in spelled]
        first = rows.groupBy(*names, *texts).agg(F.min(RID).alias("__r")).groupBy(*names).agg(F.min_by(F.struct(*texts), "__r").alias("__t"))
        first = first.select(*[F.col(n).alias(f"{n}t") for n in names], *[F.col(f"__t.__s{i}").alias(f"__o{i}") for i in spelled])
        made = made.join(first, [F.col(n).eqNullSafe(F.col(f"{n}t")) for n in names], "left").drop(*[f"{n}t" for n in names])
    for key, what in sides:
        side = rows.select(*names, F.explode(what).alias("__x")).groupBy(*names).agg(F.nullif(F.count_distinct("__x"), F.lit(0)).alias(key)) if names else rows.select(F.explode(what).alias("__x")).agg(F.nullif(F.count_distinct("__x"), F.lit(0)).alias(key))
        side = side.select(*[F.col(n).alias(f"{n}r") for n in names], key)
        made = made.join(side, [F.col(n).eqNullSafe(F.col(f"{n}r")) for n in names], "left") if names else made.crossJoin(F.broadcast(side))
    for key, m in later:
        made = made.withColumn(key, _calculated(dash, m))
    out_dims = [(_cell(infos[i], facets[i], F.col(f"__d{i}")) if infos[i].kind in ("interval", "period") else F.col(f"__o{i}")).alias(d.key) for i, d in enumerate(dims)]
    natural = [_ordinal(facets[i], F.col(n)).asc_nulls_last() for i, n in enumerate(names)] + [F.col("__first")]
    order = natural
    if q.order_by is not None:
        if q.order_by.key not in keys:
            raise DashboardError(f"no column {q.order_by.key} to order by", "orderBy")
        at = next((names[i] for i, d in enumerate(dims) if d.key == q.order_by.key), None) or q.order_by.key
        c = F.col(at)
        order = [c.desc_nulls_last() if q.order_by.descending else c.asc_nulls_last(), *natural]
    ordered = made.orderBy(*order)
    ordered = ordered.limit(q.take) if q.take is not None else ordered
    return QueryResult(ordered.select(*out_dims, *[F.col(v.key) for v in values]), infos, made, q.take)


def _ordinal(f, key: Column) -> Column:
    """Groups of an enumeration stand in the order of its members."""
    members = getattr(f, "members", None)
    return F.nullif(F.array_position(F.array(*[F.lit(m.lower()) for m in members]), F.lower(key)), F.lit(0)) if members else key


def _spelled(items: Column, fold) -> Column:
    """(k, v) of each distinct folded item and the spelling that stands first."""
    folded = F.transform(items, lambda x: fold(x))
    return F.transform(F.array_distinct(folded), lambda k: F.struct(k.alias("k"), F.element_at(items, F.array_position(folded, k).cast("int")).alias("v")))


def _calculated(dash, m) -> Column:
    """A calculated metric of a group from the group's other metrics; shares are null there."""
    done: dict[str, Column] = {}
    for x in dash.metrics:
        done[x.key] = F.col(f"__m_{x.key}").cast("double") if x.aggregation != "calculated" else _finite(x.formula(lambda k: done[k], lambda k: F.lit(None).cast("double")))
        if x.key == m.key:
            return done[x.key]
    raise DashboardError(f"no metric {m.key}")


def _finite(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def _rows(dash, q: Query, rows: DataFrame) -> QueryResult:
    if q.group_by or q.values:
        raise DashboardError("a listing of rows has no groups or values", "columns")
    take = ROWS_DEFAULT if q.take is None else q.take
    if take > ROWS_MOST:
        raise DashboardError(f"at most {ROWS_MOST} rows", "take")
    out, infos = [], []
    for i, d in enumerate(Dimension(c) if isinstance(c, str) else c for c in q.columns):
        path = f"columns[{i}]"
        kind, name = resolve_name(dash, d.name, d.plain, path)
        if kind == "metric":
            raise DashboardError(f"{name} is a metric", path)
        if kind == "facet":
            f = dash.facets[name]
            if f.kind == "text":
                raise DashboardError(f"the text facet {name} is no column", path)
            shape = {"range": "number", "date": "instant"}.get(f.kind, "value")
            out.append((d.key, instant_of(F.col(f"__v_{name}")) if f.kind == "date" else F.col(f"__v_{name}")))
        else:
            dtype = _dtype(dash, name)
            if dtype.startswith(("struct", "map")):
                raise DashboardError(f"{name} is no simple column", path)
            shape = "instant" if dtype.startswith("timestamp") else "date" if dtype == "date" else "number" if dtype in NUMERIC else "value"
            out.append((d.key, F.array_distinct(F.col(name)) if dtype.startswith("array<") else F.col(name)))
        infos.append(ColumnInfo(d.key, "column", shape, name))
    if len({k for k, _ in out}) < len(out):
        raise DashboardError("a column is there twice", "columns")
    order = [*dash.order, F.col(RID)]
    if q.order_by is not None:
        found = dict(out).get(q.order_by.key)
        if found is None:
            kind, name = resolve_name(dash, q.order_by.key, False, "orderBy")
            found = F.col(f"__v_{name}") if kind == "facet" else F.col(name)
        order = [found.desc_nulls_last() if q.order_by.descending else found.asc_nulls_last(), F.col(RID)]
    return QueryResult(rows.orderBy(*order).limit(take).select(*[c.alias(k) for k, c in out]), infos, rows, take)


__all__ = ["Query", "Dimension", "Value", "Order", "QueryResult", "ColumnInfo", "bucket_interval", "selection_of"]
