"""Names in questions: facets before properties, metrics apart, with a hint for near misses."""

from __future__ import annotations

from facetloom.errors import DashboardError


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def near(name: str, known: list[str]) -> str | None:
    best = min(known, key=lambda k: edit_distance(name.upper(), k.upper()), default=None)
    return best if best is not None and edit_distance(name.upper(), best.upper()) < 3 else None


def resolve_name(dash, name: str, prop: bool, path: str, only: str | None = None) -> tuple[str, str]:
    metrics = [m.key for m in dash.metrics]
    if only == "metric":
        known = metrics
    else:
        known = [*([] if prop else dash.facets), *dash.base_columns, *metrics]
        if not prop and name in dash.facets:
            return "facet", name
        if name in dash.base_columns:
            return "property", name
    if name in metrics and not prop:
        return "metric", name
    hint = near(name or "", known)
    raise DashboardError(f"there is no {name}" + (f"; did you mean {hint}?" if hint else ""), path)
