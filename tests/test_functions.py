import math
from datetime import date, datetime, timezone

import pytest

from facetloom.errors import DashboardError
from facetloom.functions.buckets import auto_edges, explicit_edges
from facetloom.functions.names import edit_distance
from facetloom.functions.periods import auto_granularity, next_period, period_start, resolve
from facetloom.functions.selection import DateSelection, Interval, RangeSelection, Selections, ValueSelection
from facetloom.functions.where import parse
from facetloom.plans.tools import DashboardTools
from facetloom.sources.serialization import from_json, from_query_string, to_json, to_query_string
from tests.orders import NOW, builder


def test_intervals_join_and_split():
    r = RangeSelection((Interval(1.0, 2.0, False, True), Interval(2.0, 3.0)))
    assert r.intervals == (Interval(1.0, 3.0),)
    assert len(RangeSelection((Interval(1.0, 2.0, False, True), Interval(2.0, 3.0, True))).intervals) == 2
    cut = r.remove(Interval(1.5, 2.0, False, True))
    assert cut.intervals == (Interval(1.0, 1.5, False, True), Interval(2.0, 3.0))
    assert r.toggle(Interval(1.0, 3.0)).intervals == ()
    with pytest.raises(DashboardError):
        Interval(2.0, 1.0)
    with pytest.raises(DashboardError):
        Interval(math.nan, 1.0)


def test_selection_maps():
    a = Selections().with_("b", 1, 2).with_("a", "x")
    assert a == Selections().with_("a", "x").with_("b", 2, 1) and hash(a) == hash(Selections().with_("a", "x").with_("b", 2, 1))
    assert a.toggle("a", "x").keys() == ["b"]
    assert a.with_("a", ValueSelection()).keys() == ["b"]
    assert DateSelection(presets=("lastYear", "today")).presets == ("today", "lastYear")


def test_periods():
    assert period_start(date(2026, 1, 1), "week") == date(2025, 12, 29)
    assert next_period(date(2026, 10, 1), "quarter") == date(2027, 1, 1)
    assert resolve("thisMonth", NOW, "Europe/Stockholm") == (datetime(2026, 2, 28, 23, tzinfo=timezone.utc), datetime(2026, 3, 31, 22, tzinfo=timezone.utc))
    assert resolve("lastWeek", NOW, "UTC") == (datetime(2026, 3, 2, tzinfo=timezone.utc), datetime(2026, 3, 9, tzinfo=timezone.utc))
    assert resolve("last7Days", NOW, "UTC")[0] == datetime(2026, 3, 9, tzinfo=timezone.utc)
    assert [auto_granularity(date(2026, 1, 1), date(2026, *d)) for d in ((1, 30), (3, 30), (12, 31))] == ["day", "week", "month"]
    assert auto_granularity(None, None) == "month"


def test_edges():
    assert auto_edges(3, 97, 3, 97, 5) == [0, 20, 40, 60, 80, 100]
    assert auto_edges(5, 5, 5, 5, 5) == [5, 5] and auto_edges(None, None, None, None, 5) == []
    assert explicit_edges([1, 2]) == [-math.inf, 1, 2, math.inf]
    with pytest.raises(DashboardError):
        explicit_edges([2, 1])


def test_edit_distance():
    assert edit_distance("COUNTRY", "CONTRY") == 1


@pytest.fixture(scope="module")
def dash(spark):
    return builder(spark).build()


@pytest.mark.parametrize(("text", "n"), [("Country=se", 3), ("Country!=SE", 5), ("Country=", 2), ("Status^pe", 2), ("Status$sed", 2), ("Status=*ose", 2), ("Amount>=500", 4), ("IsActive=true,(Amount<100|Amount>2000)", 2), ("Discount=", None), ("Due<2026-02-01", 1), ("Country=S*", None), ("Nope=1", None), ("(Country=SE", None)])
def test_where_texts(dash, text, n):
    types = {k: t for k, t in dash.df.dtypes if k in dash.base_columns}
    if n is None:
        with pytest.raises(DashboardError):
            parse(text, types)
    else:
        assert dash.df.where(parse(text, types)).count() == n


def test_round_trips(dash):
    s = (
        Selections()
        .with_("Country", "S,E", "null", "", None)
        .with_("IsActive", True)
        .with_("Amount", RangeSelection((Interval(100.0, 500.0, False, True), Interval(1000.0, None)), True))
        .with_("OrderDate", DateSelection((Interval(datetime(2026, 1, 1, tzinfo=timezone.utc), datetime(2026, 2, 1, 3, 30, tzinfo=timezone.utc)),), ("today",)))
    )
    assert from_json(dash, to_json(s)) == s
    assert from_query_string(dash, to_query_string(s, "d.", "page=2"), "d.") == s
    assert from_json(dash, '{"Nope": {"values": []}, "Amount": {"from": "x"}, "Status": {"values": ["Open"]}}') == Selections().with_("Status", "Open")
    assert from_json(dash, '{"Country": {"values": ["land se"]}}', strict=True) == Selections().with_("Country", "SE")
    with pytest.raises(DashboardError):
        from_json(dash, '{"Nope": {"values": [1]}}', strict=True)


def test_tools(dash):
    seen = []
    tools = DashboardTools(dash, on_show=seen.append).tools()
    facets = {f["key"]: f for f in tools["dashboard_describe"]()["facets"]}
    assert [v["count"] for v in facets["Country"]["values"]] == [3, 2, 2, 1]
    answer = tools["dashboard_query"]('{"groupBy": ["OrderDate:Quarter"], "values": ["sum:Amount", "count"], "where": "Status=Open", "orderBy": "-Count", "take": 1}')
    assert answer["rows"] == [["2026-01-01", 2850.0, 3]] and answer["total"] == 2 and answer["cut"]
    assert tools["dashboard_query"]('{"groupBy": ["Contry"]}')["path"] == "groupBy[0]"
    assert tools["dashboard_show"]('{"Country": {"values": ["SE"]}}') == {"matching": 3} and seen == [Selections().with_("Country", "SE")]
    assert DashboardTools(dash, allowed={"Status"}).query('{"groupBy": ["Country"]}')["path"] == "groupBy[0]"
