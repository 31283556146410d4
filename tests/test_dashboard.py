import pytest
from pyspark.sql import functions as F

from facetloom.errors import DashboardError
from facetloom.functions.selection import DateSelection, Interval, RangeSelection, Selections, TextSelection
from facetloom.operators.query import Dimension, Order, Query, Value
from tests.orders import builder


@pytest.fixture(scope="module")
def dash(spark):
    return builder(spark).build()


def shown(state, key):
    return {v.value: (v.total, v.filtered) for v in state.facets[key].values}


def test_no_selection(dash):
    s = dash.calculate()
    assert [(v.value, v.total, v.filtered) for v in s.facets["Country"].values] == [("SE", 3, 3), ("NO", 2, 2), (None, 2, 2), ("DK", 1, 1)]
    assert (s.total_count, s.metrics["Revenue"].value, s.metrics["AvgDiscount"].value) == (8, 5424.5, 63)
    assert s.metrics["Countries"].value == 3 and s.metrics["Countries"].share == 1


def test_own_facet_is_excluded(dash):
    s = dash.calculate(Selections().with_("Country", "SE").with_("Status", "Open"))
    assert shown(s, "Country") == {"SE": (3, 2), "NO": (2, 2), None: (2, 0), "DK": (1, 0)}
    assert shown(s, "Status") == {"Open": (4, 2), "Closed": (2, 1), "Pending": (2, 0)}
    assert s.matching_count == 2
    assert s.metrics["PerOrder"].value == 1300


def test_groups_and_labels(dash):
    s = dash.calculate(Selections().with_("Status", "Open"))
    assert s.facets["Country"].groups == [("North", 5, 4), ("South", 1, 0)]
    assert dash.label_of("Country", "se") == "Land SE"
    assert dash.toggle_group(Selections(), "Country", "north") == Selections().with_("Country", "SE", "NO")


def test_top_and_other(spark):
    d = builder(spark, top=2).build()
    country = d.calculate().facets["Country"]
    assert [v.value for v in country.values] == ["SE", "NO"] and country.other == (3, 3)
    pinned = d.calculate(Selections().with_("Country", "DK").with_("Status", "Open")).facets["Country"]
    assert [(v.value, v.total, v.filtered) for v in pinned.values] == [("SE", 3, 2), ("DK", 1, 0)]
    assert pinned.other == (4, 2)


def test_ranges_dates_and_multi(dash):
    s = dash.calculate()
    assert [(v.total) for v in s.facets["Amount"].values] == [2, 2, 2, 2]
    assert (s.facets["Amount"].minimum, s.facets["Amount"].maximum) == (0, 2500)
    assert [v.total for v in s.facets["OrderDate"].values] == [1, 2, 3, 2]
    assert shown(s, "Tags") == {"b2b": (3, 3), "gift": (3, 3), "urgent": (2, 2), None: (3, 3)}
    month = dash.calculate(Selections().with_("Country", "SE").with_("OrderDate", DateSelection(presets=("thisMonth",))))
    assert month.matching_count == 2
    assert [v.filtered for v in month.facets["OrderDate"].values] == [1, 0, 2, 0]
    assert [(p.value, p.total, p.filtered, p.selected) for p in month.facets["OrderDate"].presets] == [("thisMonth", 3, 2, True), ("lastMonth", 2, 0, False)]
    click = dash.calculate(Selections().with_("Amount", RangeSelection((s.facets["Amount"].values[1].interval,))))
    assert click.matching_count == 2 and click.facets["Amount"].values[1].selected
    assert dash.calculate(Selections().with_("Find", TextSelection(" PEND "))).matching_count == 2
    assert dash.calculate(Selections().with_("Tags", "URGENT", None)).matching_count == 5


def test_filtered_counts_sum_to_the_context(dash):
    for sel in (Selections().with_("Country", None), Selections().with_("IsActive", True).with_("Amount", RangeSelection((Interval(100.0, None),)))):
        s = dash.calculate(sel)
        for key in ("Country", "Status", "Amount", "OrderDate"):
            assert sum(v.filtered for v in s.facets[key].values) == s.facets[key].context_count


def test_scope_equals_a_filtered_build(spark, dash):
    scoped = dash.scope(Selections().with_("Status", "Open")).calculate(Selections().with_("Country", "SE"))
    again = builder(spark).where(F.col("Status") == "Open").build().calculate(Selections().with_("Country", "SE"))
    assert shown(scoped, "Country") == shown(again, "Country")
    assert scoped.metrics == again.metrics
    assert [v.total for v in scoped.facets["OrderDate"].values] == [1, 1, 1, 1]


def test_rows_are_ordered_and_sliced(spark):
    d = builder(spark).order_by(F.desc("Amount")).build()
    s = d.calculate(Selections().with_("Status", "Open"))
    assert [r.Id for r in s.items.collect()] == [6, 2, 1, 8]
    assert [r.Id for r in s.get_items(1, 2).collect()] == [2, 1] and s.get_items(9, 2).count() == 0


def test_group_queries(dash):
    rows = dash.query(Query(("Country", "Status"))).df.collect()
    assert [tuple(r) for r in rows] == [("DK", "Pending", 1), ("NO", "Open", 2), ("SE", "Closed", 1), ("SE", "Open", 2), (None, "Closed", 1), (None, "Pending", 1)]
    q = dash.query(Query(("Country",), ("Revenue",), order_by=Order("Revenue", True), take=2))
    assert [tuple(r) for r in q.df.collect()] == [("SE", 3599.5), ("DK", 1000.0)] and q.total == 4 and q.is_cut
    q = dash.query(Query(("Status",), tuple(Value("Amount" if a == "sum" else "Quantity", a) for a in ("sum", "average", "max", "min"))))
    assert [tuple(r) for r in q.df.collect()] == [("Closed", 1499.5, 3, 5, 1), ("Open", 2925, 2, 2, 2), ("Pending", 1000, 1.5, 3, 0)]
    assert [r[1] for r in dash.query(Query((Dimension("OrderDate", "quarter"),))).df.collect()] == [6, 2]
    assert [tuple(r) for r in dash.query(Query(("Tags",))).df.collect()] == [("b2b", 3), ("gift", 3), ("urgent", 2), (None, 3)]
    one = dash.query(Query(values=(Value(aggregation="count"), Value("Amount", "sum"), Value("Tags", "distinct")), where=F.col("Id") < 0)).df.collect()
    assert [tuple(r) for r in one] == [(0, None, None)]
    per = dash.query(Query(("Status",), (Value("Tags", "distinct"), "PerOrder"))).df.collect()
    assert [tuple(r) for r in per] == [("Closed", 2, 749.75), ("Open", 3, 731.25), ("Pending", None, 500.0)]


def test_row_queries(dash):
    ids = lambda d: [r.Id for r in dash.query(Query(columns=("Id", "Country"), order_by=Order("Discount", d))).df.collect()]
    assert ids(False) == [4, 8, 1, 3, 6, 2, 5, 7] and ids(True) == [6, 3, 1, 8, 4, 2, 5, 7]


@pytest.mark.parametrize(
    ("query", "path"),
    [
        (Query(("Country", "Status", "Tags")), "groupBy[2]"),
        (Query(("Contry",)), "groupBy[0]"),
        (Query(("Revenue",)), "groupBy[0]"),
        (Query(("Find",)), "groupBy[0]"),
        (Query((Dimension("Country", "month"),)), "groupBy[0]"),
        (Query(values=(Value("Country", "sum"),)), "values[0]"),
        (Query(values=(Value("Amount", "median"),)), "values[0]"),
        (Query(("Country",), order_by=Order("Nothing")), "orderBy"),
        (Query(take=-1), "take"),
        (Query(columns=("Id",), take=10_001), "take"),
        (Query(columns=("Find",)), "columns[0]"),
        (Query(selections=Selections().with_("country", "SE")), "selections.country"),
    ],
)
def test_mistakes_name_their_part(dash, query, path):
    with pytest.raises(DashboardError) as e:
        dash.query(query)
    assert e.value.path == path


def test_search(dash):
    assert [v.value for v in dash.search("Country", "land s")] == ["SE"]


def test_empty_table(spark):
    s = builder(spark).where(F.lit(False)).build().calculate()
    assert s.total_count == 0 and s.metrics["Orders"].value == 0 and s.metrics["Revenue"].value is None
