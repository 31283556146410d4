"""What a dashboard can be asked, and three tools (describe, query, show) that answer with plain dicts."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from facetloom.errors import DashboardError
from facetloom.functions.periods import GRANULARITIES, PRESETS
from facetloom.functions.where import parse
from facetloom.operators.facets import NUMERIC
from facetloom.operators.query import ROWS_DEFAULT, ROWS_MOST
from facetloom.sources.serialization import from_json, query_from_json, result_to_json, value_json

LISTED = 25


def describe(dash, allowed: set[str] | None = None, descriptions: dict[str, str] | None = None) -> dict:
    """Facets (with their values if there are at most 25), metrics, properties, periods and limits."""
    descriptions = descriptions or {}
    known = {*dash.facets, *dash.base_columns, *(m.key for m in dash.metrics)}
    for name in [*descriptions, *(allowed or ())]:
        if name not in known:
            raise DashboardError(f"there is no {name}", name)
    may = lambda n: allowed is None or n in allowed
    facets = []
    listed = _listed(dash, [k for k, f in dash.facets.items() if f.valued and may(k)])
    for f in dash.facets.values():
        if not may(f.key):
            continue
        d = {"key": f.key, "name": f.name or f.key, "kind": f.kind, "description": descriptions.get(f.key)}
        if f.valued and len(rows := listed[f.key]) <= LISTED:
            d["values"] = [{k: v for k, v in (("value", value_json(f, f.typed(r["value"]))), ("label", r["label"]), ("count", r["total"])) if v is not None or k == "value"} for r in rows]
        if f.kind == "range":
            d["minimum"], d["maximum"] = dash.bounds(f.key)
        if f.kind == "date":
            d["granularity"], d["zone"] = dash.shaped(f.key).unit, f.zone
        facets.append({k: v for k, v in d.items() if v is not None})
    properties = []
    for name, dtype in dash.df.dtypes:
        if name in dash.base_columns and may(name) and not dtype.startswith(("struct", "map", "binary")):
            uses = ["groupBy", "columns", "distinct"] + (["sum", "average", "min", "max"] if dtype in NUMERIC or dtype.startswith("decimal") else [])
            properties.append({"name": name, "kind": dtype, "uses": uses} | ({"description": descriptions[name]} if name in descriptions else {}))
    metrics = [{"key": m.key, "aggregation": m.aggregation} | ({"description": descriptions[m.key]} if m.key in descriptions else {}) for m in dash.metrics if may(m.key)]
    return {"facets": facets, "metrics": metrics, "properties": properties, "periods": GRANULARITIES, "presets": PRESETS, "limits": {"dimensions": 2, "rows": ROWS_DEFAULT, "mostRows": ROWS_MOST}}


def _listed(dash, keys: list[str]) -> dict[str, list]:
    """The most common values of each facet, at most one more than are listed, in one pass."""
    out: dict[str, list] = {k: [] for k in keys}
    if keys:
        order = Window.partitionBy("facet").orderBy(F.desc("total"), F.col("key").isNull(), "first_rid")
        rows = dash.values_frame(keys).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= LISTED + 1).orderBy("facet", "rank").collect()
        names = {dash.core.numbers[k]: k for k in keys}
        for r in rows:
            out[names[r["facet"]]].append(r)
    return out


class DashboardTools:
    """``parser(text, types)`` reads conditions; without ``where`` none are allowed."""

    def __init__(self, dash, prefix: str = "dashboard", allowed: set[str] | None = None, descriptions=None, where: bool = True, on_show=None, parser=parse):
        self.parser = parser
        if not re.fullmatch(r"[A-Za-z0-9_-]{1,40}", prefix):
            raise DashboardError("a prefix is 1 to 40 letters, digits, _ or -")
        self.dash, self.prefix, self.allowed, self.descriptions, self.where, self.on_show = dash, prefix, allowed, descriptions, where, on_show

    def tools(self) -> dict:
        out = {f"{self.prefix}_describe": self.describe, f"{self.prefix}_query": self.query}
        return out | ({f"{self.prefix}_show": self.show} if self.on_show else {})

    def _safe(self, answer):
        try:
            return answer()
        except DashboardError as e:
            return {"error": str(e), "path": e.path}
        except ValueError as e:
            return {"error": str(e), "path": None}

    def describe(self) -> dict:
        return self._safe(lambda: describe(self.dash, self.allowed, self.descriptions))

    def query(self, text: str) -> dict:
        def answer():
            q = query_from_json(self.dash, text, self.allowed, self.parser)
            if q.where is not None and not self.where:
                raise DashboardError("conditions aren't allowed", "where")
            return result_to_json(self.dash, self.dash.query(q))

        return self._safe(answer)

    def show(self, text: str) -> dict:
        def answer():
            s = from_json(self.dash, text, strict=True)
            for k in s.keys():
                if self.allowed is not None and k not in self.allowed:
                    raise DashboardError(f"there is no {k}", f"selections.{k}")
            self.on_show(s)
            return {"matching": self.dash.calculate(s).matching_count}

        return self._safe(answer)
