"""Conditions as text: ``Amount>100,(Status=Open|Status^Pen)``. ``,`` is and, ``|`` is or; all ignore case.

Operators: = != < > <= >= =* (contains) ^ (starts with) $ (ends with). A null string counts as empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from facetloom.errors import DashboardError

_TOKEN = re.compile(r"\s*(?:([(),|])|([^(),|=!<>^$]+?)\s*(!=|<=|>=|=\*|=|<|>|\^|\$)((?:\\.|[^(),|\\])*))")


def parse(text: str, types: dict[str, str]) -> Column:
    """``types``: column name -> Spark type name."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DashboardError(f"can't read {text[at:]!r}", "where")
        tokens.append(m.group(1) or (m.group(2).strip(), m.group(3), re.sub(r"\\(.)", r"\1", m.group(4)).strip()))
        at = m.end()
    if not tokens:
        raise DashboardError("an empty condition", "where")
    place = 0

    def peek():
        return tokens[place] if place < len(tokens) else None

    def chain(of, sign, join):
        nonlocal place
        left = of()
        while peek() == sign:
            place += 1
            left = join(left, of())
        return left

    def factor():
        nonlocal place
        token = peek()
        if token is None or token in (")", ",", "|"):
            raise DashboardError("a comparison is missing", "where")
        place += 1
        if token == "(":
            inner = expression()
            if peek() != ")":
                raise DashboardError("a bracket isn't closed", "where")
            place += 1
            return inner
        return comparison(*token, types)

    def expression():
        return chain(lambda: chain(factor, ",", lambda a, b: a & b), "|", lambda a, b: a | b)

    found = expression()
    if place < len(tokens):
        raise DashboardError("something follows the condition", "where")
    return found


def comparison(name: str, sign: str, value: str, types: dict[str, str]) -> Column:
    if name not in types:
        raise DashboardError(f"there is no {name}", "where")
    if "*" in value:
        raise DashboardError("wildcards aren't read; use =*, ^ or $", "where")
    kind, c = types[name], F.col(name)
    order = {"=": c.__eq__, "!=": c.__ne__, "<": c.__lt__, ">": c.__gt__, "<=": c.__le__, ">=": c.__ge__}
    if kind == "string":
        left, v = F.lower(F.coalesce(c, F.lit(""))), F.lit(value.lower())
        tests = {"=": left == v, "!=": left != v, "<": left < v, ">": left > v, "<=": left <= v, ">=": left >= v, "=*": F.contains(left, v), "^": F.startswith(left, v), "$": F.endswith(left, v)}
        return tests[sign]
    if sign not in order:
        raise DashboardError(f"{sign} needs a text column", "where")
    try:
        if kind == "boolean":
            v = {"true": True, "false": False}[value.lower()]
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            v = F.lit(value).cast(kind)
        else:
            v = float(value)
    except (KeyError, ValueError):
        raise DashboardError(f"{value!r} isn't a {kind}", "where") from None
    hit = order[sign](v)
    return F.coalesce(hit, F.lit(sign == "!="))
