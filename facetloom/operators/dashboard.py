"""The dashboard: one table, its facets and metrics, and states under selections.

Nothing is read until something is asked: counts of one facet read the columns of that facet and of the selections,
metrics those of the matching rows. ``build(snapshot=...)`` writes the rows with their numbers once, so that later
changes of the source are not seen; ``persist=True`` keeps them in memory instead, until ``close``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.errors import DashboardError
from facetloom.functions.buckets import auto_edges, body, explicit_edges
from facetloom.functions.names import near
from facetloom.functions.periods import auto_granularity, next_period, resolve, to_instant
from facetloom.functions.instants import local_date, utc_literal
from facetloom.functions.selection import Interval, RangeSelection, Selections, TextSelection, ValueSelection, normalised
from facetloom.operators.counting import RID, all_of, ranked, ranking, stride_sample, value_counts
from facetloom.operators.facets import Facet, Metric, finite, number, resolved

STATES = 8
PRESENTED = 10_000  # values of a facet that a state holds on the driver; those beyond are read when asked for


class DashboardBuilder:
    """Declares filters, facets, metrics and the order of rows, then builds."""

    def __init__(self, source: DataFrame, order_key: str | None = None):
        self.source, self.order_key = source, order_key
        self.filters, self.facets, self.metrics, self.order = [], [], [], []
        self.clock = lambda: datetime.now(timezone.utc)
        self.frozen = False

    def _open(self):
        if self.frozen:
            raise DashboardError("the dashboard is built already")

    def _add(self, group: list, item):
        self._open()
        if not item.key or not item.key.strip():
            raise DashboardError("a key can't be blank")
        if any(item.key == x.key for x in [*self.facets, *self.metrics]):
            raise DashboardError(f"the key {item.key} is taken")
        group.append(item)
        return self

    def where(self, condition: Column):
        self._open()
        self.filters.append(condition)
        return self

    def _facet(self, kind: str, column, key: str | None, **options):
        if key is None:
            if not isinstance(column, str):
                raise DashboardError("an expression needs a key")
            key = column.rpartition(".")[2]
        return self._add(self.facets, Facet(key, kind, column, **options))

    def value(self, column, key=None, **options):
        return self._facet("value", column, key, **options)

    def boolean(self, column, key=None, **options):
        return self._facet("boolean", column, key, **options)

    def multi(self, column, key=None, **options):
        return self._facet("multi", column, key, **options)

    def range(self, column, key=None, **options):
        if options.get("cuts") is not None:
            options |= {"cuts": tuple(options["cuts"]), "edges": tuple(explicit_edges(options["cuts"]))}
        return self._facet("range", column, key, **options)

    def date(self, column, key=None, **options):
        return self._facet("date", column, key, **options)

    def text(self, key: str, predicate, **options):
        return self._facet("text", None, key, predicate=predicate, **options)

    def count(self, key="Count", **options):
        return self._add(self.metrics, Metric(key, "count", **options))

    def metric(self, aggregation: str, column, key=None, **options):
        if aggregation not in ("sum", "average", "min", "max", "distinct"):
            raise DashboardError(f"unknown aggregation {aggregation}")
        return self._add(self.metrics, Metric(key or column, aggregation, column, **options))

    def calculated(self, key: str, formula, uses: tuple[str, ...] = (), **options):
        """``formula(values, shares)`` over the metrics declared before; ``uses`` names them for an early check."""
        for u in uses:
            if not any(u == m.key for m in self.metrics):
                raise DashboardError(f"no earlier metric {u}")
        return self._add(self.metrics, Metric(key, "calculated", formula=formula, **options))

    def order_by(self, *columns: Column, key=None):
        """``key`` maps each column to what is compared, such as ``F.lower``; null first ascending, last descending."""
        self._open()
        if self.order:
            raise DashboardError("the order is set already; use then_by")
        self.order = [key(c) if key else c for c in columns]
        return self

    def then_by(self, *columns: Column, key=None):
        self._open()
        if not self.order:
            raise DashboardError("then_by needs order_by before it")
        self.order += [key(c) if key else c for c in columns]
        return self

    def now(self, clock):
        self.clock = clock
        return self

    def build(self, snapshot: str | None = None, persist: bool = False) -> "Dashboard":
        """``snapshot``: a folder that all executors share, for the rows as they are now, with their numbers."""
        self.frozen = True
        source = reduce(lambda d, c: d.where(c), self.filters, self.source)
        source = source.withColumn(RID, (F.col(self.order_key) if self.order_key else F.monotonically_increasing_id()).cast("long"))
        if snapshot is not None:
            source.write.parquet(snapshot)
            source = source.sparkSession.read.schema(source.schema).parquet(snapshot)
        if persist:
            source = source.persist()
        probe = source.select(*[f.raw.alias(f"f_{f.key}") for f in self.facets if f.column is not None], *[m.raw.alias(f"m_{m.key}") for m in self.metrics if m.column is not None])
        kinds = dict(probe.dtypes)
        facets = [replace(f, dtype=kinds.get(f"f_{f.key}", "string")) for f in self.facets]
        metrics = [m.typed(kinds.get(f"m_{m.key}", "string")) for m in self.metrics]
        rows = source.select("*", *[c.alias(n) for f in facets for n, c in f.columns().items()])
        return Dashboard(_Core(rows, {f.key: f for f in facets}, metrics, list(self.order), self.clock, [source] if persist else [], bool(self.order_key or snapshot)))


class _Core:
    """What a dashboard and its scopes share: all rows, definitions, and what was found out about them once."""

    def __init__(self, rows: DataFrame, facets: dict[str, Facet], metrics: list[Metric], order, clock, held: list, numbered: bool):
        self.rows, self.facets, self.metrics, self.order, self.clock, self.held, self.numbered = rows, facets, metrics, order, clock, held, numbered
        self.numbers = {k: i for i, k in enumerate(facets)}
        self._shaped: dict[str, Facet] = {}
        self._bounds: dict[str, tuple] | None = None

    def shaped(self, key: str) -> Facet:
        """The facet with its edges or period, which are found once, over all rows."""
        f = self.facets[key]
        if key not in self._shaped:
            v = F.col(f"__v_{key}")
            if f.kind == "range" and f.edges is None:
                _, lo, hi, sample = stride_sample(self.rows, v)
                f = replace(f, edges=tuple(auto_edges(lo, hi, *body(sample), f.buckets)))
            elif f.kind == "date" and not f.unit:
                f = replace(f, unit=auto_granularity(*body(stride_sample(self.rows, local_date(v, f.zone))[3]), f.max_periods))
            self._shaped[key] = f
        return self._shaped[key]

    def bounds(self, key: str) -> tuple:
        """Least and largest value of a range facet; all range facets are read in one pass."""
        if self._bounds is None:
            keys = [k for k, f in self.facets.items() if f.kind == "range"]
            row = self.rows.agg(*[a(f"__v_{k}") for k in keys for a in (F.min, F.max)]).first()
            self._bounds = {k: (row[2 * i], row[2 * i + 1]) for i, k in enumerate(keys)}
        return self._bounds[key]


@dataclass
class ValueState:
    key: str | None
    value: object
    label: str | None
    group: str | None
    total: int
    filtered: int
    selected: bool = False
    interval: Interval | None = None
    start: object = None


class ValueStates(Sequence):
    """Values in ranked order. The first stand on the driver; beyond them, iteration reads partition by partition."""

    def __init__(self, head: list[ValueState], size: int, whole):
        self.head, self.size, self._whole = head, size, whole

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at):
        if isinstance(at, slice):
            start, stop, step = at.indices(self.size)
            return [self[i] for i in range(start, stop, step)] if max(start, stop) <= len(self.head) else list(self)[at]
        at = at + self.size if at < 0 else at
        if not 0 <= at < self.size:
            raise IndexError(at)
        return self.head[at] if at < len(self.head) else next(v for i, v in enumerate(self) if i == at)

    def __iter__(self) -> Iterator[ValueState]:
        return iter(self.head) if self.size == len(self.head) else self._whole()

    def __eq__(self, other):
        return list(self) == list(other)


@dataclass
class FacetState:
    key: str
    kind: str
    name: str
    values: Sequence[ValueState]
    context_count: int
    selection: object = None
    other: tuple[int, int] | None = None
    groups: list[tuple] = field(default_factory=list)
    presets: list[ValueState] = field(default_factory=list)
    minimum: float | None = None
    maximum: float | None = None
    unit: str | None = None


class MetricState:
    def __init__(self, key: str, value, share):
        self.key, self.value, self._share = key, value, share

    @property
    def share(self) -> float | None:
        """Of the total over all rows; of counts, sums and distinct counts alone."""
        return self._share()

    def __eq__(self, other):
        return (self.key, self.value, self.share) == (other.key, other.value, other.share)

    def __repr__(self):
        return f"MetricState({self.key!r}, {self.value!r})"


class FacetStates(Mapping):
    """One facet is counted when it is asked for, all of them in one pass when they are iterated."""

    def __init__(self, dash, selections, now):
        self.dash, self.selections, self.now, self.found = dash, selections, now, {}

    def __getitem__(self, key: str) -> FacetState:
        if key not in self.found:
            self.found |= self.dash._present([self.dash.facet(key).key], self.selections, self.now)
        return self.found[key]

    def __iter__(self):
        missing = [k for k in self.dash.facets if k not in self.found]
        if missing:
            self.found |= self.dash._present(missing, self.selections, self.now)
        return iter(self.dash.facets)

    def __len__(self) -> int:
        return len(self.dash.facets)


class State:
    """Counts and metrics under selections at one moment. What is read is computed once and then kept."""

    def __init__(self, dash: "Dashboard", selections: Selections, now: datetime):
        self.dashboard, self.selections, self.now = dash, selections, now
        self.facets = FacetStates(dash, selections, now)
        self._numbers: dict | None = None
        self._metrics: dict[str, MetricState] | None = None

    def _matched(self) -> dict:
        if self._numbers is None:
            self._numbers = self.dashboard.totals if not len(self.selections) else self.dashboard._measured(self.dashboard.matching(self.selections, now=self.now))
        return self._numbers

    @property
    def total_count(self) -> int:
        return self.dashboard.total_count

    @property
    def matching_count(self) -> int:
        return self._matched()[None]

    @property
    def metrics(self) -> dict[str, MetricState]:
        if self._metrics is None:
            self._metrics = self.dashboard._metric_states(self._matched())
        return self._metrics

    @property
    def items(self) -> DataFrame:
        """The matching rows in dashboard order."""
        return self.dashboard.rows(self.selections, self.now)

    def get_items(self, skip: int, take: int) -> DataFrame:
        return self.items.offset(skip).limit(take)


class Dashboard:
    """``within``: the scope, a condition on all rows; None is all of them."""

    def __init__(self, core: _Core, within: Column | None = None):
        self.core, self.within = core, within
        self.facets, self.metrics, self.order, self.clock = core.facets, core.metrics, core.order, core.clock
        self.df = core.rows if within is None else core.rows.where(within)
        self.base_columns = [c for c in self.df.columns if not c.startswith("__")]
        self._states: OrderedDict[tuple, State] = OrderedDict()
        self._totals: dict | None = None

    def close(self) -> None:
        """Release what is cached for this dashboard and its scopes."""
        for df in self.core.held:
            df.unpersist()
        self.core.held.clear()

    # -- rows

    def facet(self, key: str) -> Facet:
        if key not in self.facets:
            hint = near(key or "", list(self.facets))
            raise DashboardError(f"no facet {key}" + (f"; did you mean {hint}?" if hint else ""), f"selections.{key}")
        return self.facets[key]

    def shaped(self, key: str) -> Facet:
        return self.core.shaped(self.facet(key).key)

    def bounds(self, key: str) -> tuple:
        return self.core.bounds(key)

    def _predicates(self, selections: Selections, now) -> dict[str, Column]:
        if len(selections) > 63:
            raise DashboardError("more than 63 facets are selected")
        return {k: self.facet(k).predicate_for(s, now) for k, s in selections.items()}

    def matching(self, selections: Selections, where=None, now=None) -> DataFrame:
        """``where``: a condition, SQL text, or a function of the rows that returns a condition."""
        df = reduce(DataFrame.where, self._predicates(selections, now or self.clock()).values(), self.df)
        if where is None:
            return df
        return df.where(where(df) if callable(where) and not isinstance(where, Column) else where)

    def rows(self, selections: Selections = Selections(), now=None) -> DataFrame:
        return self.matching(selections, now=now).orderBy(*self.order, RID).select(*self.base_columns)

    # -- counting

    def values_frame(self, keys, selections: Selections = Selections(), now=None) -> DataFrame:
        """facet (its number), key, value, label, grp, first_rid, total, filtered of the values of some facets."""
        chosen = {self.core.numbers[k]: self.shaped(k) for k in keys}
        return value_counts(self.core.rows, chosen, self._predicates(selections, now or self.clock()), self.within)

    def facet_counts(self, key: str, selections: Selections = Selections(), now=None, ranked_too: bool = True) -> DataFrame:
        """key, value, label, grp, total, filtered, rank of one facet's values, those counted zero included."""
        found = self.values_frame([self.facet(key).key], selections, now)
        if ranked_too:
            if not self.core.numbered:  # row numbers might differ from one reading to the next
                self.core.held.append(found := found.persist())
            found = ranked(found, ranking(self.facets[key]))
        return found.select("key", "value", "label", "grp", "total", "filtered", *["rank"] * ranked_too)

    def dictionary(self, key: str) -> DataFrame:
        return self.values_frame([self.facet(key).key]).select("key", "value", "label", "grp", "first_rid", "total")

    # -- metrics

    def _measured(self, df: DataFrame) -> dict:
        """The number of rows (under None) and every metric that is no formula, in one pass."""
        plain = [m for m in self.metrics if m.aggregation != "calculated"]
        row = df.agg(F.count(F.lit(1)), *[m.aggregate().alias(m.key) for m in plain]).first()
        return {None: row[0]} | {m.key: finite(row[i]) for i, m in enumerate(plain, 1)}

    @property
    def totals(self) -> dict:
        if self._totals is None:
            self._totals = self._measured(self.df)
        return self._totals

    @property
    def total_count(self) -> int:
        return self.totals[None]

    def _metric_states(self, values: dict) -> dict[str, MetricState]:
        out: dict[str, MetricState] = {}

        def share_of(m: Metric):
            def share():
                v, total = values[m.key], self.totals[m.key]
                return v / total if v is not None and total else None

            return share if m.aggregation in ("count", "sum", "distinct") else lambda: None

        for m in self.metrics:
            out[m.key] = MetricState(m.key, _formula(m, out), lambda: None) if m.aggregation == "calculated" else MetricState(m.key, values[m.key], share_of(m))
        return out

    # -- states

    def calculate(self, selections: Selections = Selections()) -> State:
        """Presets mean what they mean at this moment; a state is used again only while they mean the same."""
        now = self.clock()
        for key, s in selections.items():
            self.facet(key).check(s)
        moments = [tuple(resolve(p, now, f.zone) for p in (*f.presets, *getattr(selections.get(k), "presets", ()))) for k, f in self.facets.items() if f.kind == "date"]
        key = (selections, tuple(moments))
        state = self._states.pop(key, None) or State(self, selections, now)
        self._states[key] = state
        if len(self._states) > STATES:
            self._states.popitem(last=False)
        return state

    def _contexts(self, keys, selections: Selections, now) -> dict:
        """Context counts of multi-valued and text facets, and (in all rows, in the context) of presets: one pass."""
        predicates = self._predicates(selections, now)
        asked: dict = {}
        for k in keys:
            f, own = self.facets[k], all_of([p for o, p in predicates.items() if o != k])
            if f.kind in ("multi", "text"):
                asked[k] = F.count_if(own)
            for p in f.presets if f.kind == "date" else ():
                lo, hi = resolve(p, now, f.zone)
                inside = (F.col(f"__v_{k}") >= utc_literal(lo)) & (F.col(f"__v_{k}") < utc_literal(hi))
                asked[k, p, 0], asked[k, p, 1] = F.count_if(inside), F.count_if(inside & own)
        return dict(zip(asked, self.df.agg(*asked.values()).first())) if asked else {}

    def _picked(self, key: str, selections: Selections) -> Column:
        """Whether a value is selected, by the facet's own key."""
        selection = selections.get(key)
        if not self.facets[key].valued or not selection:
            return F.lit(False)
        wanted = self.facets[key].wanted(selection.values)
        hit = F.coalesce(F.col("key").isin(wanted), F.lit(False)) if wanted else F.lit(False)
        return hit | (F.col("key").isNull() if None in selection.values else F.lit(False))

    def _present(self, keys: list[str], selections: Selections, now) -> dict[str, FacetState]:
        facets = {k: self.shaped(k) for k in keys}
        number = self.core.numbers
        counted = [k for k in keys if facets[k].kind != "text"]
        extra = self._contexts(keys, selections, now)
        rows: dict[str, list] = {k: [] for k in keys}
        sums: dict[str, list] = {k: [] for k in keys}
        if counted:
            of = {number[k]: k for k in counted}
            by_facet = lambda value, default: reduce(lambda c, k: F.when(F.col("facet") == number[k], value(k)).otherwise(c), counted, F.lit(default))
            found = self.values_frame(counted, selections, now).withColumn("picked", by_facet(lambda k: self._picked(k, selections), False)).persist()
            try:
                by_total = F.col("facet").isin([number[k] for k in counted if facets[k].rank != "filtered"])
                best = found.withColumn("a", F.when(by_total, F.col("total")).otherwise(F.col("filtered"))).withColumn("b", F.when(by_total, F.col("filtered")).otherwise(F.col("total")))
                valued = [number[k] for k in counted if facets[k].valued]
                limits = {k: facets[k].top or PRESENTED for k in counted if facets[k].valued}
                order = Window.partitionBy("facet").orderBy(F.desc("picked"), F.desc("a"), F.desc("b"), F.col("key").isNull(), "first_rid", "key")
                tops = best.where(F.col("facet").isin(valued)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(limits.values(), default=0))
                tops = tops.where(F.col("rank") <= by_facet(lambda k: F.lit(limits.get(k, 0)), 0)).drop("rank") if limits else None
                buckets = best.where(~F.col("facet").isin(valued)) if len(valued) < len(counted) else None
                for r in (tops.unionAll(buckets) if tops is not None and buckets is not None else buckets if tops is None else tops).collect():
                    rows[of[r["facet"]]].append(r)
                each = found.groupBy("facet", F.lower("grp").alias("g")).agg(F.min_by("grp", "first_rid").alias("grp"), F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"), F.sum("filtered").alias("filtered"))
                for r in each.collect():
                    sums[of[r["facet"]]].append(r)
            finally:
                found.unpersist()
        return {k: self._state(facets[k], rows[k], sums[k], extra, selections, now) for k in keys}

    def _state(self, f: Facet, rows, sums, extra: dict, selections: Selections, now) -> FacetState:
        selection = selections.get(f.key)
        whole = sum(r["filtered"] for r in sums)
        state = FacetState(f.key, f.kind, f.name or f.key, [], extra.get(f.key, whole), selection, unit=f.unit)
        if f.valued:
            make = lambda r: ValueState(r["key"], f.typed(r["value"]), r["label"], r["grp"], r["total"], r["filtered"], bool(r["picked"]))
            head = [make(r) for r in sorted(rows, key=lambda r: (-r["a"], -r["b"], r["key"] is None, r["first_rid"], r["key"] or ""))]
            size = sum(r["n"] for r in sums)
            if f.top or len(head) == size:
                state.values = ValueStates(head, len(head), None)
            else:  # selected values stand where they rank, as everywhere; all are read in order when they are iterated
                every = lambda: map(make, self.values_frame([f.key], selections, now).withColumn("picked", self._picked(f.key, selections)).orderBy(*ranking(f)).toLocalIterator())
                state.values = ValueStates([] if selection else head, size, every)
            if f.top and f.kind != "multi" and size > len(head):
                state.other = (sum(r["total"] for r in sums) - sum(v.total for v in head), whole - sum(v.filtered for v in head))
            if f.group is not None:
                ordered = (lambda g: (-g["filtered"], -g["total"])) if f.rank == "filtered" else (lambda g: (-g["total"], -g["filtered"]))
                named = sorted((r for r in sums if r["g"] is not None), key=lambda r: (*ordered(r), r["g"]))
                state.groups = [(r["grp"], r["total"], r["filtered"]) for r in named]
            return state
        by_key = {r["key"]: (r["total"], r["filtered"]) for r in rows}
        if f.kind == "range":
            state.minimum, state.maximum = self.bounds(f.key)
            for b in range(max(len(f.edges) - 1, 0)):
                part = bucket_interval(f, b)
                state.values.append(ValueState(str(b), b, None, None, *by_key.get(str(b), (0, 0)), bool(selection and selection.contains(part)), part))
        elif f.kind == "date":
            chosen = normalised(resolved(selection, now, f.zone)) if selection else ()
            for k in sorted(k for k in by_key if k is not None):
                start = datetime.fromisoformat(k).date()
                part = period_interval(f, start, f.unit)
                state.values.append(ValueState(k, start, None, None, *by_key[k], any(p.covers(part) for p in chosen), part, start))
            for p in f.presets:
                part = Interval(*resolve(p, now, f.zone), False, True)
                total, filtered = extra[f.key, p, 0], extra[f.key, p, 1]
                if total or not f.skip_empty_presets:
                    state.presets.append(ValueState(p, p, None, None, total, filtered, bool(selection) and (p in selection.presets or part in selection.intervals), part))
        if None in by_key:
            state.values.append(ValueState(None, None, None, None, *by_key[None], bool(selection and selection.nulls)))
        return state

    def search(self, key: str, text: str, most: int = 20, selections: Selections = Selections()) -> list[ValueState]:
        """Values whose label, or value if they have none, contains the text, ignoring case; best ranked first."""
        if most < 1:
            raise DashboardError("at least one value must be asked for")
        f = self.facet(key)
        hit = F.col("key").isNotNull() & F.contains(F.lower(F.coalesce("label", "value")), F.lit(text.lower()))
        rows = self.values_frame([key], selections).where(hit).withColumn("picked", self._picked(key, selections)).orderBy(*ranking(f)).limit(most).collect()
        return [ValueState(r["key"], f.typed(r["value"]), r["label"], r["grp"], r["total"], r["filtered"], r["picked"]) for r in rows]

    def labels(self, key: str, values) -> dict:
        """Key -> (value, label or None) of the given values, in any form that the facet takes."""
        f = self.facet(key)
        wanted = f.wanted(values)
        return {r["key"]: (f.typed(r["value"]), r["label"]) for r in self.dictionary(key).where(F.col("key").isin(wanted)).collect()} if wanted else {}

    def label_of(self, key: str, value) -> str | None:
        found = list(self.labels(key, [value]).values())
        return found and (found[0][1] or str(found[0][0])) or None

    def group_values(self, key: str, group: str) -> list:
        f = self.facet(key)
        rows = self.dictionary(key).where(F.col("key").isNotNull() & (F.lower("grp") == group.lower())).orderBy("first_rid").collect()
        return [f.typed(r["value"]) for r in rows]

    def toggle_group(self, selections: Selections, key: str, group: str) -> Selections:
        return selections.toggle(key, *self.group_values(key, group))

    # -- scopes

    def scope(self, by: Column | Selections) -> "Dashboard":
        """A dashboard over part of the rows, with this one's buckets and periods; presets are resolved now."""
        condition = all_of(self._predicates(by, self.clock()).values()) if isinstance(by, Selections) else F.coalesce(by, F.lit(False))
        return Dashboard(self.core, condition if self.within is None else self.within & condition)

    def query(self, query, cancellation=None):
        from facetloom.operators.query import run

        return run(self, query, cancellation)


class _NoValue(Exception):
    pass


def _formula(m: Metric, states: dict[str, MetricState]):
    """A formula's value; null where it reads a null, divides by zero or isn't finite."""

    def read(part):
        def of(key):
            v = getattr(states[key], part)
            if v is None:
                raise _NoValue
            return v

        return of

    try:
        return finite(m.formula(read("value"), read("share")))
    except (_NoValue, ZeroDivisionError):
        return None


def bucket_interval(f: Facet, b: int) -> Interval:
    lo, hi = f.edges[b], f.edges[b + 1]
    last = b == len(f.edges) - 2
    return Interval(None if lo == float("-inf") else lo, None if hi == float("inf") else hi, False, hi != float("inf") and not last)


def period_interval(f: Facet, start, unit: str) -> Interval:
    return Interval(to_instant(start, f.zone), to_instant(next_period(start, unit), f.zone), False, True)


__all__ = ["Dashboard", "DashboardBuilder", "State", "RangeSelection", "TextSelection", "ValueSelection", "Selections", "number", "Facet", "Metric", "PRESENTED"]
