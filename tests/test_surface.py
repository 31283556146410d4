"""Values beyond what a state holds at once, clocks and zones, exact types, snapshots, cancellation, and mistakes that must not pass."""

import threading
from datetime import date, datetime, timezone
from decimal import Decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from facetloom.errors import DashboardError
from facetloom.functions.buckets import auto_edges, round_step
from facetloom.functions.selection import DateSelection, Interval, Selections
from facetloom.operators.cancellation import Cancellation, Cancelled
from facetloom.operators.dashboard import DashboardBuilder
from facetloom.operators.query import Dimension, Query, Value
from facetloom.sources.serialization import from_query_string, result_to_json
from tests.orders import builder


@pytest.fixture(scope="module")
def many(spark):
    t = spark.range(60_000).select("id", (F.col("id") % 30_000).alias("v"))
    return DashboardBuilder(t, "id").value("v", label=F.concat(F.lit("L"), F.col("v"))).count("n").build()


def test_all_values_of_a_large_facet(many):
    values = many.calculate(Selections().with_("v", 29_999)).facets["v"].values
    assert len(values) == 30_000
    listed = list(values)
    assert len({v.value for v in listed}) == 30_000 and {v.total for v in listed} == {2}
    assert [v.value for v in listed if v.selected] == [29_999] and listed[12_345].label == f"L{listed[12_345].value}"
    assert many.calculate().facets["v"].values[25_000].value == 25_000


def test_ranks_of_a_large_facet(many):
    ranks = many.facet_counts("v").select("value", "rank").collect()
    assert sorted(r["rank"] for r in ranks) == list(range(1, 30_001))
    assert all(int(r["value"]) == r["rank"] - 1 for r in ranks)
    many.close()


def test_labels_of_a_long_answer(many):
    answer = result_to_json(many, many.query(Query(("v",), (Value(aggregation="count", alias="n"),))))
    assert len(answer["rows"]) == 30_000 and all(c == {"value": c["value"], "label": f"L{c['value']}"} for c, _ in answer["rows"])


ZONES = ["UTC", "America/New_York", "Asia/Kolkata"]


@pytest.fixture(params=ZONES)
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_dates_do_not_follow_the_session(spark, zone):
    text = ["2026-01-31 23:30:00", "2026-02-01 00:30:00", "2026-03-08 02:30:00", "2026-11-01 01:30:00"]
    t = spark.createDataFrame(list(enumerate(text)), "id int, at string").select("id", F.col("at").cast("timestamp_ntz"))
    clock = [datetime(2026, 1, 31, 12, tzinfo=timezone.utc)]
    d = DashboardBuilder(t, "id").date("at", unit="day").date(F.col("at").cast("date"), "day", unit="month").now(lambda: clock[0]).build()
    today = Selections().with_("at", DateSelection(presets=("today",)))
    assert d.calculate(today).matching_count == 1
    clock[0] = datetime(2026, 2, 1, 12, tzinfo=timezone.utc)
    assert [r["id"] for r in d.calculate(today).items.collect()] == [1]
    assert [v.key for v in d.calculate().facets["at"].values] == [x[:10] for x in text]
    assert [v.key for v in d.calculate().facets["day"].values] == ["2026-01-01", "2026-02-01", "2026-03-01", "2026-11-01"]
    cell = d.query(Query((Dimension("at", "month"),))).df.first()[0]
    assert (str(cell["start"]), cell["from"].astimezone(timezone.utc), cell["to"].astimezone(timezone.utc)) == ("2026-01-01", datetime(2026, 1, 1, tzinfo=timezone.utc), datetime(2026, 2, 1, tzinfo=timezone.utc))
    assert [str(r[0]["start"]) for r in d.query(Query((Dimension("at", "month", plain=True),))).collect()] == ["2026-01-01", "2026-02-01", "2026-03-01", "2026-11-01"]
    local = DashboardBuilder(t, "id").date("at", unit="day", zone="Europe/Stockholm").build()
    s = Selections().with_("at", DateSelection((Interval(datetime(2026, 1, 31, 22, 30, tzinfo=timezone.utc), datetime(2026, 1, 31, 22, 31, tzinfo=timezone.utc)),)))
    assert local.calculate(s).matching_count == 1


def test_typed_values(spark, zone):
    moment = datetime(2026, 7, 1, 4, 5, 6, tzinfo=timezone.utc)
    t = spark.createDataFrame([(1, Decimal("9.99"), 1e7, date(2026, 7, 1), moment), (2, Decimal("9.00"), -0.0, None, None), (3, Decimal("10.00"), 0.0, date(2026, 7, 2), moment)], "id int, p decimal(6,2), d double, day date, at timestamp")
    d = DashboardBuilder(t, "id").value("p").value("d").value("day").value("at").build()
    n = lambda k, *v: d.calculate(Selections().with_(k, *v)).matching_count
    assert (n("p", 9.99), n("p", "9"), n("p", 9.999), n("p", Decimal("10.0"), 9)) == (1, 1, 0, 2)
    assert (n("d", 1e7), n("d", 0), n("day", "2026-07-01"), n("day", None), n("at", moment), n("at", "2026-07-01T04:05:06Z")) == (1, 2, 1, 1, 2, 2)
    state = d.calculate(Selections().with_("d", 1e7).with_("p", 9.99).with_("at", moment))
    for key, value in (("d", 1e7), ("p", Decimal("9.99")), ("at", moment)):
        assert [v.value for v in state.facets[key].values if v.selected] == [value]
    for key, wrong in (("p", "x"), ("d", True), ("day", "yesterday")):
        with pytest.raises(DashboardError):
            n(key, wrong)


def test_own_key_holds_for_pinning_and_flags(spark):
    t = spark.createDataFrame([(i, s) for i, s in enumerate(["a", "a", "A", "b", "b", "b"])], "id int, s string")
    d = DashboardBuilder(t, "id").value("s", fold=lambda c: c, top=1).build()
    f = d.calculate(Selections().with_("s", "A")).facets["s"]
    assert [(v.value, v.selected) for v in f.values] == [("A", True)] and f.other == (5, 5)


def test_enumerations(spark):
    t = spark.createDataFrame([(1, "Web"), (2, "Store"), (3, "Web"), (4, None)], "id int, kind string")
    d = DashboardBuilder(t, "id").value("kind", members=("Web", "Store", "Phone")).build()
    assert [r[0] for r in d.query(Query(("kind",))).collect()] == ["Web", "Store", None]
    assert d.calculate(Selections().with_("kind", "STORE")).matching_count == 1 and d.calculate(Selections().with_("kind", 0)).matching_count == 2
    with pytest.raises(DashboardError):
        d.calculate(Selections().with_("kind", "Fax")).matching_count


def test_snapshot_outlives_the_source(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/t")
    d = DashboardBuilder(spark.read.parquet(f"{tmp_path}/t")).value("id").count("n").build(snapshot=f"{tmp_path}/kept")
    spark.range(3).write.mode("overwrite").parquet(f"{tmp_path}/t")
    assert d.calculate().total_count == 10 and len(d.calculate().facets["id"].values) == 10


def test_an_instant_alone_is_that_moment(spark):
    d = builder(spark).build()
    s = from_query_string(d, "OrderDate=2026-01-15T09:00Z")  # ten o'clock in Stockholm
    assert d.calculate(s).matching_count == 1


def test_cancellation(spark):
    t = spark.range(0, 400_000_000, 1, 4).select("id", (F.sqrt(F.col("id").cast("double")) % 1000).cast("int").alias("v"))
    d, stop = DashboardBuilder(t, "id").value("v").build(), Cancellation()
    timer = threading.Timer(1.5, stop.cancel)
    timer.start()
    with pytest.raises(Cancelled):
        for _ in range(50):
            d.query(Query(("v",)), stop).collect()
    timer.join()
    with pytest.raises(Cancelled):
        d.query(Query(("v",)), stop)
    assert DashboardBuilder(spark.range(3), "id").value("id").build().query(Query(("id",)), Cancellation()).total == 3


def test_steps_are_round():
    assert [float(round_step(x)) for x in (1, 1.41, 1.42, 3.1, 3.2, 7.0, 7.1, 0.03, 1234)] == [1, 1, 2, 2, 5, 5, 10, 0.02, 1000]
    assert auto_edges(0, 1000, 2, 97, 10)[-1] == float("inf") and auto_edges(0.1, 0.9, 0.1, 0.9, 8) == [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def test_names_with_clashes_and_empty_tables(spark):
    t = spark.createDataFrame([], "id int, facet string, total int, rank int, value array<string>, filtered date")
    d = DashboardBuilder(t, "id").value("facet").value("total").multi("value").date("filtered").range("rank").build()
    s = d.calculate()
    assert s.total_count == 0 and all(len(s.facets[k].values) == 0 for k in d.facets)
    t = spark.createDataFrame([(1, "x", 2, 3, ["v"], date(2026, 1, 1))], t.schema)
    d = DashboardBuilder(t, "id").value("facet").value("total").multi("value").date("filtered").range("rank").build()
    assert {k: len(f.values) for k, f in d.calculate().facets.items()} == {"facet": 1, "total": 1, "value": 1, "filtered": 1, "rank": 1}


def test_ranks_without_the_cache(spark):
    """Every value is as common as the others, so that the first row decides; nothing may rest on what is cached."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = spark.range(60_000).select("id", (F.col("id") % 30_000).alias("v"))
        found = DashboardBuilder(t, "id").value("v").count("n").build().facet_counts("v")
        spark.catalog.clearCache()
        assert sorted((r["rank"], int(r["value"])) for r in found.collect()) == [(i + 1, i) for i in range(30_000)]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_ranks_of_a_table_written_anew(spark, tmp_path):
    def ranks():
        d = DashboardBuilder(spark.read.parquet(str(tmp_path / "t.parquet")), "id").value("v").count("n").build()
        return {r["value"]: r["rank"] for r in d.facet_counts("v").collect()}

    for values in (["a", "b", "b"], ["a", "a", "b"]):
        pq.write_table(pa.table({"id": [1, 2, 3], "v": values}), tmp_path / "t.parquet")
        assert ranks() == {values[1]: 1, ({"a", "b"} - {values[1]}).pop(): 2}


def test_values_with_the_same_first_row(spark):
    """Row numbers that repeat leave values equal in counts and first row: the key decides, in ranks as in states and searches."""
    t = spark.range(4_000).select(F.lit(1).alias("row"), F.format_string("k%04d", F.col("id") * 7 % 2_000).alias("v"))
    d = DashboardBuilder(t.repartition(5), "row").value("v").count("n").build()
    expected = [f"k{i:04d}" for i in range(2_000)]
    assert [r["value"] for r in sorted(d.facet_counts("v").collect(), key=lambda r: r["rank"])] == expected
    assert [v.value for v in d.calculate().facets["v"].values] == expected
    assert [v.value for v in d.search("v", "K", 5)] == expected[:5]
