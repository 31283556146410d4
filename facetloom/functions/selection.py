"""Selections: small immutable values on the driver, with set and interval algebra."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from datetime import datetime

from facetloom.errors import DashboardError
from facetloom.functions.periods import PRESETS


@dataclass(frozen=True)
class Interval:
    """From lo to hi; None is unbounded."""

    lo: object = None
    hi: object = None
    lo_open: bool = False
    hi_open: bool = False

    def __post_init__(self):
        for x in (self.lo, self.hi):
            if isinstance(x, float) and math.isnan(x):
                raise DashboardError("a bound can't be NaN")
        if self.lo is not None and self.hi is not None and self.lo > self.hi:
            raise DashboardError("an interval can't start after its end")

    def _start(self):
        return (self.lo is not None, self.lo if self.lo is not None else 0, self.lo_open)

    def _end_before(self, other) -> bool:
        """Whether this ends before ``other`` does."""
        if other.hi is None:
            return self.hi is not None
        return self.hi is not None and (self.hi, not self.hi_open) < (other.hi, not other.hi_open)

    def touches(self, later: "Interval") -> bool:
        if self.hi is None or later.lo is None:
            return True
        return later.lo < self.hi or later.lo == self.hi and not (self.hi_open and later.lo_open)

    def covers(self, part: "Interval") -> bool:
        return _key(self) <= _key(part) and not self._end_before(part)

    def minus(self, cut: "Interval") -> list["Interval"]:
        if (self.hi is not None and not self.touches(cut) and _key(self) <= _key(cut)) or (cut.hi is not None and not cut.touches(self) and _key(cut) <= _key(self)):
            return [self]
        out = []
        if _key(self) < _key(cut):
            out.append(Interval(self.lo, cut.lo, self.lo_open, not cut.lo_open))
        if cut._end_before(self):
            out.append(Interval(cut.hi, self.hi, not cut.hi_open, self.hi_open))
        return [i for i in out if not (i.lo is not None and i.lo == i.hi and (i.lo_open or i.hi_open))]


def _key(i: Interval):
    return (0, 0, False) if i.lo is None else (1, i.lo, i.lo_open)


def normalised(intervals) -> tuple[Interval, ...]:
    """Sorted, with overlapping and adjacent intervals joined."""
    out: list[Interval] = []
    for i in sorted(intervals, key=_key):
        if out and out[-1].touches(i):
            if out[-1]._end_before(i):
                out[-1] = replace(out[-1], hi=i.hi, hi_open=i.hi_open)
        else:
            out.append(i)
    return tuple(out)


@dataclass(frozen=True)
class ValueSelection:
    values: frozenset = field(default_factory=frozenset)

    def add(self, *more):
        return ValueSelection(self.values | set(more))

    def remove(self, *less):
        return ValueSelection(self.values - set(less))

    def toggle(self, *values):
        return self.remove(*values) if set(values) <= self.values else self.add(*values)

    def __bool__(self):
        return bool(self.values)


@dataclass(frozen=True)
class TextSelection:
    text: str = ""

    def __post_init__(self):
        object.__setattr__(self, "text", (self.text or "").strip())

    def __bool__(self):
        return bool(self.text)


@dataclass(frozen=True)
class RangeSelection:
    intervals: tuple[Interval, ...] = ()
    nulls: bool = False

    def __post_init__(self):
        object.__setattr__(self, "intervals", normalised(self.intervals))

    def add(self, *more: Interval):
        return replace(self, intervals=(*self.intervals, *more))

    def contains(self, part: Interval) -> bool:
        return any(i.covers(part) for i in self.intervals)

    def remove(self, cut: Interval):
        return replace(self, intervals=tuple(x for i in self.intervals for x in i.minus(cut)))

    def toggle(self, part: Interval):
        return self.remove(part) if self.contains(part) else self.add(part)

    def toggle_null(self):
        return replace(self, nulls=not self.nulls)

    def __bool__(self):
        return bool(self.intervals) or self.nulls


@dataclass(frozen=True)
class DateSelection:
    """Half-open intervals of instants, presets after them in their own order, and perhaps the null rows."""

    intervals: tuple[Interval, ...] = ()
    presets: tuple[str, ...] = ()
    nulls: bool = False

    def __post_init__(self):
        for p in self.presets:
            if p not in PRESETS:
                raise DashboardError(f"unknown preset {p}")
        object.__setattr__(self, "intervals", normalised(Interval(i.lo, i.hi, False, i.hi is not None) for i in self.intervals))
        object.__setattr__(self, "presets", tuple(sorted(set(self.presets), key=PRESETS.index)))

    def add(self, *more):
        return replace(self, intervals=(*self.intervals, *(m for m in more if isinstance(m, Interval))), presets=(*self.presets, *(m for m in more if isinstance(m, str))))

    def remove(self, part):
        if isinstance(part, str):
            return replace(self, presets=tuple(p for p in self.presets if p != part))
        part = Interval(part.lo, part.hi, False, part.hi is not None)
        return replace(self, intervals=tuple(x for i in self.intervals for x in i.minus(part)))

    def contains(self, part) -> bool:
        return part in self.presets if isinstance(part, str) else any(i.covers(Interval(part.lo, part.hi, False, part.hi is not None)) for i in self.intervals)

    def toggle(self, part):
        return self.remove(part) if self.contains(part) else self.add(part)

    def toggle_null(self):
        return replace(self, nulls=not self.nulls)

    def __bool__(self):
        return bool(self.intervals or self.presets) or self.nulls


class Selections:
    """An immutable map of facet key -> selection; empty selections are left out. Equal maps hash alike."""

    def __init__(self, items=()):
        self._items = tuple(sorted(((k, s) for k, s in dict(items).items() if s), key=lambda x: x[0]))

    def with_(self, key: str, *values):
        """Replace a facet's selection: by a selection object, or by plain values."""
        new = values[0] if len(values) == 1 and hasattr(values[0], "__dataclass_fields__") and not isinstance(values[0], Interval) else ValueSelection(frozenset(values))
        return Selections({**dict(self._items), key: new})

    def without(self, key: str):
        return Selections({k: s for k, s in self._items if k != key})

    def toggle(self, key: str, *values):
        old = self.get(key)
        if old is None:
            old = RangeSelection() if values and isinstance(values[0], Interval) and not isinstance(values[0].lo or values[0].hi, datetime) else DateSelection() if values and isinstance(values[0], Interval) else ValueSelection()
        new = old.toggle(*values)
        return Selections({**dict(self._items), key: new})

    def get(self, key: str):
        return dict(self._items).get(key)

    def items(self):
        return self._items

    def keys(self):
        return [k for k, _ in self._items]

    def __len__(self):
        return len(self._items)

    def __eq__(self, other):
        return isinstance(other, Selections) and self._items == other._items

    def __hash__(self):
        return hash(self._items)

    def __repr__(self):
        return f"Selections({dict(self._items)})"
