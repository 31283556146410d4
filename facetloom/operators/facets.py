"""Facet and metric definitions, and what each adds to a row."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import date, datetime, timezone
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetloom.errors import DashboardError
from facetloom.functions.instants import instant_of, period_of, utc_literal, utc_of
from facetloom.functions.periods import resolve
from facetloom.functions.selection import DateSelection, Interval, RangeSelection, TextSelection, ValueSelection

INTEGERS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
NUMERIC = (*INTEGERS, "float", "double")
SELECTION_KINDS = {"value": ValueSelection, "boolean": ValueSelection, "multi": ValueSelection, "range": RangeSelection, "date": DateSelection, "text": TextSelection}


def number(c: Column) -> Column:
    """Any number as a double, NaN as null."""
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def precise_sum(x: Column) -> Column:
    """A compensated sum of doubles that does not depend on the order of rows.

    Each value is split into two halves of its mantissa; sums of the upper halves are exact as long as the values
    lie within a factor of about 2 ** 27 of each other and of their number, and the lower halves are added apart.
    """
    scaled = x * F.lit(134_217_729.0)  # 2 ** 27 + 1
    upper = F.when(F.abs(x) < 1e290, scaled - (scaled - x)).otherwise(x)
    return F.sum(upper) + F.sum(F.when(F.abs(x) < 1e290, x - upper).when(x.isNotNull(), 0.0))


def is_text(dtype: str) -> bool:
    return dtype.startswith(("string", "varchar", "char", "array<string"))


@dataclass(frozen=True)
class Facet:
    """kind: value, boolean, multi, range, date or text. ``column``: a name or an expression.

    ``label`` and ``group`` are columns of the row, or functions of the value. ``fold`` replaces the key by which
    values are one. ``members`` are the names of an enumeration in order. ``format`` and ``parse`` turn a value
    into text and back where selections are written to JSON and query strings.
    """

    key: str
    kind: str
    column: object
    name: str | None = None
    label: Column | Callable[[Column], Column] | None = None
    group: Column | Callable[[Column], Column] | None = None
    fold: Callable[[Column], Column] | None = None
    top: int | None = None
    rank: str = "filtered"
    cuts: tuple | None = None
    buckets: int = 10
    edges: tuple | None = None
    unit: str | None = None
    zone: str = "UTC"
    max_periods: int = 30
    presets: tuple[str, ...] = ()
    skip_empty_presets: bool = False
    predicate: Callable[[str], Column] | None = None
    members: tuple[str, ...] | None = None
    format: Callable[[object], str] | None = None
    parse: Callable[[str], object] | None = None
    dtype: str = "string"

    @property
    def raw(self) -> Column:
        return F.col(self.column) if isinstance(self.column, str) else self.column

    @property
    def item_type(self) -> str:
        return self.dtype.removeprefix("array<").removesuffix(">") if self.dtype.startswith("array<") else self.dtype

    @property
    def valued(self) -> bool:
        return self.kind in ("value", "boolean", "multi")

    def folded(self, c: Column) -> Column:
        """The key by which values are one: strings ignoring case, unless ``fold`` says otherwise."""
        if self.fold:
            return self.fold(c).cast("string")
        kind = self.item_type
        if is_text(kind):
            return F.lower(c)
        if kind in ("float", "double"):
            return (c + F.lit(0.0)).cast("string")  # -0 and 0 are one
        return F.unix_micros(c).cast("string") if kind == "timestamp" else c.cast("string")

    def text(self, c: Column) -> Column:
        """A value as text that ``typed`` reads back, the same in every session."""
        return F.unix_micros(c).cast("string") if self.item_type == "timestamp" else c.cast("string")

    def typed(self, text: str | None):
        kind = self.item_type
        if text is None:
            return None
        if kind == "boolean":
            return text == "true"
        if kind in INTEGERS:
            return int(text)
        if kind in ("float", "double"):
            return float(text)
        if kind.startswith("decimal"):
            return Decimal(text)
        if kind == "timestamp":
            return datetime.fromtimestamp(int(text) // 1_000_000, timezone.utc).replace(microsecond=int(text) % 1_000_000)
        if kind == "timestamp_ntz":
            return datetime.fromisoformat(text)
        return date.fromisoformat(text) if kind == "date" else text

    def literal(self, x) -> Column:
        """A coerced value as a column of the facet's type; null where the type can't hold it, so that it matches nothing."""
        kind = self.item_type
        if kind == "timestamp":
            return instant_of(utc_literal(x))
        if kind == "timestamp_ntz":
            return F.lit(x.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)
        if kind == "date":
            return F.lit(x.isoformat()).cast(kind)
        if kind.startswith("decimal"):
            exact = F.lit(format(x, "f")).try_cast(kind)
            places = -x.as_tuple().exponent
            return exact if places <= int(kind.rstrip(")").partition(",")[2] or 0) else F.lit(None).cast(kind)
        return F.lit(x).cast(kind)

    def wanted(self, values) -> list[Column]:
        """The keys of selected values other than null."""
        return [self.folded(self.literal(self.coerced(x))) for x in values if x is not None]

    def labels(self, value: Column) -> tuple[Column, Column]:
        none = F.lit(None).cast("string")
        return tuple(none if x is None else (x(value) if callable(x) and not isinstance(x, Column) else x).cast("string") for x in (self.label, self.group))

    def columns(self) -> dict[str, Column]:
        """The columns that the engine knows of a row for this facet."""
        v, k = f"__v_{self.key}", f"__k_{self.key}"
        if self.kind in ("value", "boolean"):
            return {v: self.raw, k: self.folded(self.raw)}
        if self.kind == "multi":
            items = F.filter(F.coalesce(self.raw, F.array().cast(self.dtype)), lambda x: x.isNotNull())
            return {v: items, k: F.array_distinct(F.transform(items, self.folded))}
        if self.kind == "range":
            return {v: number(self.raw)}
        return {v: utc_of(self.raw, self.dtype, self.zone)} if self.kind == "date" else {}

    def local_period(self, utc: Column, unit: str | None = None) -> Column:
        return period_of(utc, self.zone, unit or self.unit)

    def bucket(self) -> Column:
        """Range: index of the bucket, lower edges inclusive, the last bucket closed. Date: start of the local period."""
        v = F.col(f"__v_{self.key}")
        if self.kind == "date":
            return self.local_period(v)
        at = F.lit(0)
        for e in (self.edges or ())[1:-1]:
            at = at + (v >= F.lit(e)).cast("int")
        return F.when(v.isNotNull(), at)

    def check(self, selection) -> None:
        if not isinstance(selection, SELECTION_KINDS[self.kind]):
            raise DashboardError(f"facet {self.key} takes a {SELECTION_KINDS[self.kind].__name__}", f"selections.{self.key}")

    def predicate_for(self, selection, now) -> Column:
        """Whether a row matches, never null."""
        self.check(selection)
        v = F.col(f"__v_{self.key}")
        if self.kind == "text":
            return F.coalesce(self.predicate(selection.text), F.lit(False))
        if self.valued:
            k, wanted = F.col(f"__k_{self.key}"), self.wanted(selection.values)
            hit = (F.arrays_overlap(k, F.array(*wanted)) if self.kind == "multi" else k.isin(wanted)) if wanted else F.lit(False)
            none = F.size(k) == 0 if self.kind == "multi" else k.isNull()
            return F.coalesce(hit, F.lit(False)) | (none if None in selection.values else F.lit(False))
        one = utc_literal if self.kind == "date" else F.lit
        hit = F.lit(False)
        for i in resolved(selection, now, self.zone):
            test = v.isNotNull()
            if i.lo is not None:
                test = test & (v > one(i.lo) if i.lo_open else v >= one(i.lo))
            if i.hi is not None:
                test = test & (v < one(i.hi) if i.hi_open else v <= one(i.hi))
            hit = hit | test
        return F.coalesce(hit, F.lit(False)) | (v.isNull() if selection.nulls else F.lit(False))

    def coerced(self, x):
        """A value in the form of the facet's type; bool and number are never taken for each other."""
        try:
            return self._coerced(x, self.item_type)
        except (ValueError, TypeError, ArithmeticError):
            raise DashboardError(f"{x!r} isn't a value of facet {self.key}", f"selections.{self.key}") from None

    def _coerced(self, x, kind: str):
        if self.members is not None:
            if isinstance(x, int) and not isinstance(x, bool):
                return self.members[x] if 0 <= x < len(self.members) else str(x)
            return next(m for m in (*self.members, None) if m is None or m.lower() == str(x).lower()) or _refuse()
        if kind == "boolean":
            if isinstance(x, str) and x.lower() in ("true", "false"):
                return x.lower() == "true"
            return x if isinstance(x, bool) else _refuse()
        if kind in NUMERIC or kind.startswith("decimal"):
            if isinstance(x, bool):
                _refuse()
            if kind in ("float", "double"):
                return float(x)
            try:
                d = x if isinstance(x, Decimal) else Decimal(str(x).strip())
            except InvalidOperation:
                _refuse()
            if not d.is_finite() or kind in INTEGERS and (d != d.to_integral_value() or not -(1 << INTEGERS[kind] - 1) <= d < 1 << INTEGERS[kind] - 1):
                _refuse()
            return int(d) if kind in INTEGERS else d.normalize()
        if kind == "date":
            return x if isinstance(x, date) and not isinstance(x, datetime) else date.fromisoformat(x)
        if kind in ("timestamp", "timestamp_ntz"):
            t = x if isinstance(x, datetime) else datetime.fromisoformat(x)
            if kind == "timestamp":
                return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
            return t.replace(tzinfo=None)
        if is_text(kind) and not isinstance(x, str):
            if not isinstance(x, (bool, int, float, Decimal)):
                _refuse()
            return str(int(x)) if isinstance(x, float) and x.is_integer() else str(x)
        return x


def _refuse():
    raise ValueError


def resolved(selection, now, zone) -> list[Interval]:
    presets = [Interval(*resolve(p, now, zone), False, True) for p in getattr(selection, "presets", ())]
    return [*selection.intervals, *presets]


AGGREGATIONS = ("count", "sum", "average", "min", "max", "distinct", "calculated")


@dataclass(frozen=True)
class Metric:
    """``fold``: the key by which values are one for ``distinct``; strings ignore case without it."""

    key: str
    aggregation: str
    column: object = None
    formula: Callable | None = None
    name: str | None = None
    fold: Callable[[Column], Column] | None = None
    column_type: str = "string"

    @property
    def raw(self) -> Column:
        return F.col(self.column) if isinstance(self.column, str) else self.column

    def aggregate(self, on: Column | None = None) -> Column:
        """Over the rows where ``on`` holds; null without a value, but a count of 0 is 0."""
        if self.aggregation == "count":
            return F.count(F.lit(1)) if on is None else F.count_if(on)
        if self.aggregation == "distinct":
            k = self.fold(self.raw) if self.fold else F.lower(self.raw) if is_text(self.column_type) else self.raw
            return F.nullif(F.count_distinct(k if on is None else F.when(on, k)), F.lit(0))
        x = number(self.raw) if on is None else F.when(on, number(self.raw))
        return aggregated(self.aggregation, x)

    def typed(self, dtype: str) -> "Metric":
        return replace(self, column_type=dtype)


def aggregated(kind: str, x: Column) -> Column:
    """Sum, average, min or max of a column of doubles without NaN."""
    if kind == "sum":
        return precise_sum(x)
    return precise_sum(x) / F.count(x) if kind == "average" else {"min": F.min, "max": F.max}[kind](x)


def finite(x):
    return x if x is not None and math.isfinite(x) else None
