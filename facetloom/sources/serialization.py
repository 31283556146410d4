"""Selections, questions and answers as JSON, and selections as URL query strings."""

from __future__ import annotations

import json
import re
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from urllib.parse import parse_qsl, quote

from pyspark.sql import functions as F

from facetloom.errors import DashboardError
from facetloom.functions.periods import PRESETS
from facetloom.functions.selection import DateSelection, Interval, RangeSelection, Selections, TextSelection, ValueSelection
from facetloom.functions.where import parse
from facetloom.operators.query import Dimension, Order, Query, Value, selection_of


#: The length of the half-open interval that holds one instant only.
INSTANT = timedelta(microseconds=1)


def instant_text(t: datetime) -> str:
    t = t.astimezone(timezone.utc)
    if not (t.hour or t.minute or t.second or t.microsecond):
        return t.strftime("%Y-%m-%dT00:00Z")
    body = t.strftime("%Y-%m-%dT%H:%M")
    if t.second or t.microsecond:
        body += t.strftime(":%S") + (f".{t.microsecond:06d}".rstrip("0") if t.microsecond else "")
    return body + "Z"


def instant_of(text: str) -> datetime:
    text = re.sub(r" (\d\d:\d\d)$", r"+\1", text)  # a plus that a URL turned into a space
    t = datetime.fromisoformat(text)
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def number_text(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def value_text(f, v) -> str:
    """A value as text, by the facet's own formatter if it has one."""
    if f is not None and f.format is not None:
        return f.format(v)
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return number_text(v)
    if isinstance(v, datetime):
        return instant_text(v) if v.tzinfo else v.isoformat()
    return v.isoformat() if isinstance(v, date) else format(v, "f") if isinstance(v, Decimal) else str(v)


def value_json(f, v):
    """A value as JSON has it: text for what JSON has no form of, or for what the facet formats."""
    if v is None or f is not None and f.format is None and isinstance(v, (bool, int, float, str)):
        return v
    if f is None and isinstance(v, (bool, int, float, str)):
        return v
    return float(v) if isinstance(v, Decimal) and (f is None or f.format is None) and Decimal(repr(float(v))) == v else value_text(f, v)


def _read_value(f, x):
    return f.coerced(f.parse(x)) if f.parse is not None and isinstance(x, str) else f.coerced(x)


def _in_order(values) -> list:
    return sorted((v for v in values if v is not None), key=lambda v: (str(type(v)), v))


# -- JSON


def selection_to_json(s, f=None) -> dict:
    if isinstance(s, ValueSelection):
        return {"values": [value_json(f, v) for v in _in_order(s.values)] + [None] * (None in s.values)}
    if isinstance(s, TextSelection):
        return {"text": s.text}
    one = instant_text if isinstance(s, DateSelection) else (lambda x: x)
    parts = []
    for i in s.intervals:
        p = {}
        if i.lo is not None:
            p["from"] = one(i.lo)
        if i.hi is not None:
            p["to"] = one(i.hi)
        if i.lo_open and isinstance(s, RangeSelection):
            p["fromInclusive"] = False
        if i.hi_open and isinstance(s, RangeSelection):
            p["toInclusive"] = False
        parts.append(p)
    parts += [{"preset": p} for p in getattr(s, "presets", ())]
    if not parts:
        return {"onlyNull": True} if s.nulls else {}
    out = dict(parts[0]) if len(parts) == 1 and parts[0] else {"intervals": parts}
    return out | ({"includeNull": True} if s.nulls else {})


def to_json(selections: Selections, dash=None) -> str:
    """With ``dash``, values are written by the formatters of its facets."""
    return json.dumps({k: selection_to_json(s, dash and dash.facets.get(k)) for k, s in selections.items()}, ensure_ascii=False)


def _selection(dash, key: str, data: dict, strict: bool):
    f = dash.facet(key)
    if not isinstance(data, dict):
        raise DashboardError(f"{key} must be an object", f"selections.{key}")
    if f.kind == "text":
        return TextSelection(data.get("text", ""))
    if f.kind in ("value", "boolean", "multi"):
        values = []
        for v in data.get("values", []):
            try:
                values.append(None if v is None else _value(dash, f, v, strict))
            except DashboardError:
                if strict:
                    raise
        return ValueSelection(frozenset(values))
    if data.get("onlyNull"):
        return (RangeSelection if f.kind == "range" else DateSelection)(nulls=True)
    parts = data["intervals"] if "intervals" in data else [data] if {"from", "to", "preset"} & set(data) else []
    nulls = bool(data.get("includeNull"))
    try:
        if f.kind == "range":
            return RangeSelection(tuple(Interval(_float(p.get("from")), _float(p.get("to")), p.get("fromInclusive") is False, p.get("toInclusive") is False) for p in parts), nulls)
        spans = tuple(Interval(p.get("from") and instant_of(p["from"]), p.get("to") and instant_of(p["to"]), False, True) for p in parts if "preset" not in p)
        return DateSelection(spans, tuple(p["preset"] for p in parts if "preset" in p), nulls)
    except (ValueError, TypeError, AttributeError) as e:
        raise DashboardError(str(e), f"selections.{key}") from None


def _float(x):
    if x is None:
        return None
    if isinstance(x, bool):
        raise ValueError("a bound must be a number")
    return float(x)


def _value(dash, f, v, strict: bool):
    """Strictly read, a label may stand for its value; a value wins over a label, and a label of several is an error."""
    if not strict or not isinstance(v, str):
        return _read_value(f, v)
    try:
        value = _read_value(f, v)
    except DashboardError:
        value = None
    known = dash.dictionary(f.key).where(F.col("key").isNotNull())
    same = F.coalesce(F.col("key").isin(f.wanted([value])), F.lit(False)) if value is not None else F.lit(False)
    rows = known.where(same | F.coalesce(F.lower("label") == v.lower(), F.lit(False))).select("value", same.alias("same")).limit(3).collect()
    if any(r["same"] for r in rows) or not rows:
        return _read_value(f, v)
    if len(rows) > 1:
        raise DashboardError(f"several values are labelled {v}", f"selections.{f.key}")
    return f.typed(rows[0]["value"])


def _unique(pairs):
    seen = {}
    for k, v in pairs:
        if k in seen:
            raise DashboardError(f"{k} is there twice", k)
        seen[k] = v
    return seen


def from_json(dash, text: str, strict: bool = False) -> Selections:
    """Lenient reading drops what it can't read, the last of two duplicates wins; strict reading names the mistake."""
    data = json.loads(text, object_pairs_hook=_unique if strict else None) if isinstance(text, str) else text
    out = {}
    for key, part in data.items():
        try:
            out[key] = _selection(dash, key, part, strict)
        except DashboardError:
            if strict:
                raise
    return Selections(out)


# -- query strings


def _escaped(f, v) -> str:
    text = value_text(f, v)
    if text == "":
        return '""'
    return "\\null" if text == "null" else text.replace("\\", "\\\\").replace(",", "\\,")


def _interval_text(i: Interval, one) -> str:
    if i.lo is not None and i.lo == i.hi:
        return one(i.lo)
    body = f"{'' if i.lo is None else one(i.lo)}..{'' if i.hi is None else one(i.hi)}"
    return f"{'(' if i.lo_open else '['}{body}{')' if i.hi_open else ']'}" if i.lo_open or i.hi_open else body


def selection_to_query(s, f=None) -> str:
    if isinstance(s, TextSelection):
        return s.text
    if isinstance(s, ValueSelection):
        return ",".join([_escaped(f, v) for v in _in_order(s.values)] + ["null"] * (None in s.values))
    if isinstance(s, DateSelection):
        parts = [f"{'' if i.lo is None else instant_text(i.lo)}..{'' if i.hi is None else instant_text(i.hi)}" for i in s.intervals] + list(s.presets)
    else:
        parts = [_interval_text(i, number_text) for i in s.intervals]
    return ",".join(parts + ["null"] * s.nulls)


def to_query_string(selections: Selections, prefix: str = "", keep: str = "", dash=None) -> str:
    """``keep``: an existing query string; its other parameters stay. With ``dash``, its facets' formatters write values."""
    own = [f"{quote(prefix + k, safe='')}={quote(selection_to_query(s, dash and dash.facets.get(k)), safe='.,:')}" for k, s in selections.items()]
    others = [f"{quote(k, safe='')}={quote(v, safe='.,:')}" for k, v in parse_qsl(keep.lstrip("?"), keep_blank_values=True) if not (prefix and k.startswith(prefix))]
    return "&".join(others + own)


def _tokens(text: str) -> list[str]:
    return re.findall(r"(?:\\.|[^,\\])+", text)


def from_query_string(dash, text: str, prefix: str = "", strict: bool = False) -> Selections:
    out = {}
    for name, value in parse_qsl(text.rpartition("?")[2], keep_blank_values=True):
        if not name.startswith(prefix):
            continue
        key = name[len(prefix) :]
        try:
            if strict and key in out:
                raise DashboardError(f"{key} is there twice", f"selections.{key}")
            out[key] = _from_query(dash, key, value, strict)
        except (DashboardError, ValueError) as e:
            if strict:
                raise e if isinstance(e, DashboardError) else DashboardError(str(e), f"selections.{key}") from None
    return Selections(out)


def _from_query(dash, key: str, value: str, strict: bool):
    f = dash.facet(key)
    if f.kind == "text":
        return TextSelection(value)
    tokens = _tokens(value)
    if f.kind in ("value", "boolean", "multi"):
        values = []
        for t in tokens:
            if t == "null":
                values.append(None)
            else:
                plain = "" if t == '""' else re.sub(r"\\(.)", r"\1", t)
                try:
                    values.append(_value(dash, f, plain, strict))
                except DashboardError:
                    if strict:
                        raise
        return ValueSelection(frozenset(values))
    one = float if f.kind == "range" else instant_of
    spans, presets = [], []
    for t in tokens:
        if t == "null":
            continue
        if t in PRESETS and f.kind == "date":
            presets.append(t)
            continue
        lo_open, hi_open = t.startswith("("), t.endswith(")")
        body = t.strip("[]()")
        lo, dots, hi = body.partition("..")
        if not dots:  # a number alone is that value, an instant alone is that moment
            spans.append(Interval(one(lo), one(lo)) if f.kind == "range" else Interval(one(lo), one(lo) + INSTANT, False, True))
        else:
            spans.append(Interval(one(lo) if lo else None, one(hi) if hi else None, lo_open, hi_open or f.kind == "date" and bool(hi)))
    nulls = "null" in tokens
    return RangeSelection(tuple(spans), nulls) if f.kind == "range" else DateSelection(tuple(spans), tuple(presets), nulls)


# -- questions and answers

_SHORT = {"avg": "average", "sum": "sum", "average": "average", "min": "min", "max": "max", "distinct": "distinct", "count": "count"}
PARTS = ("selections", "where", "groupBy", "values", "columns", "orderBy", "take")


def query_from_json(dash, text: str, allowed: set[str] | None = None, parser=parse) -> Query:
    """Short forms: ``"OrderDate:Month"``, ``"avg:Amount"``, ``"-Revenue"``. ``allowed``: the names that may be asked for."""
    data = json.loads(text, object_pairs_hook=_unique) if isinstance(text, str) else text
    for part in data:
        if part not in PARTS:
            raise DashboardError(f"unknown part {part}", part)

    def permitted(name, path):
        if allowed is not None and name is not None and name not in allowed:
            raise DashboardError(f"there is no {name}", path)
        return name

    def dimension(d, path):
        if isinstance(d, str):
            name, _, period = d.partition(":")
            d = {"name": name, "period": period or None}
        return Dimension(permitted(d["name"], path), d.get("period") and d["period"].lower(), bool(d.get("property")), d.get("as"))

    def value(v, path):
        if isinstance(v, str):
            kind, colon, name = v.partition(":")
            if v.lower() == "count":
                v = {"aggregation": "count"}
            else:
                v = {"aggregation": kind, "name": name} if colon else {"name": v}
        kind = v.get("aggregation")
        if kind is not None and kind.lower() not in _SHORT:
            raise DashboardError(f"unknown aggregation {kind}", path)
        return Value(permitted(v.get("name"), path), kind and _SHORT[kind.lower()], v.get("as"))

    order = data.get("orderBy")
    if isinstance(order, str):
        order = Order(order.lstrip("-"), order.startswith("-"))
    elif isinstance(order, dict):
        order = Order(order["name"], bool(order.get("descending")))
    selections = from_json(dash, data.get("selections", {}), strict=True)
    for k in selections.keys():
        permitted(k, f"selections.{k}")
    types = {n: t for n, t in dash.df.dtypes if n in dash.base_columns and (allowed is None or n in allowed)}
    return Query(
        tuple(dimension(d, f"groupBy[{i}]") for i, d in enumerate(data.get("groupBy", []))),
        tuple(value(v, f"values[{i}]") for i, v in enumerate(data.get("values", []))),
        tuple(dimension(d, f"columns[{i}]") for i, d in enumerate(data.get("columns", []))),
        selections,
        parser(data["where"], types) if data.get("where") else None,
        order,
        data.get("take"),
    )


def result_to_json(dash, result) -> dict:
    """Header, rows, total and cut. Intervals stand in URL notation, periods as their first day, labelled values as
    {value, label}; labels are looked up for the values of the answer."""
    rows = result.collect()
    labels: dict[int, dict] = {}
    for i, c in enumerate(result.columns):
        f = dash.facets.get(c.source)
        if c.kind == "value" and c.role != "value" and f is not None and f.valued and f.label is not None:
            standing = {x for r in rows for x in (r[i] if isinstance(r[i], list) else [r[i]]) if x is not None}
            labels[i] = {_same(f, v): label for v, label in dash.labels(c.source, standing).values() if label is not None}

    def cell(i, c, v):
        if v is None:
            return None
        if isinstance(v, list):
            return [cell(i, c, x) for x in v]
        if c.kind == "interval":
            return _interval_text(selection_of(c, v), number_text)
        if c.kind == "period":
            return v["start"].isoformat()
        f = dash.facets.get(c.source) if c.role != "value" and c.kind == "value" else None
        label = labels[i].get(_same(f, v)) if i in labels else None
        if isinstance(v, datetime) and not v.tzinfo and dict(result.df.dtypes).get(c.key) == "timestamp":
            v = v.astimezone(timezone.utc)
        shown = value_json(f, v)
        return {"value": shown, "label": label} if label is not None else shown

    header = [{k: v for k, v in vars(c).items() if v is not None} for c in result.columns]
    found = [[cell(i, c, v) for i, (c, v) in enumerate(zip(result.columns, r))] for r in rows]
    return {"columns": header, "rows": found, "total": result.total, "cut": result.is_cut}


def _same(f, v):
    return v.lower() if isinstance(v, str) and (f is None or f.fold is None) else v
