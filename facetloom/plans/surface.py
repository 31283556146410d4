"""Registered queries for selections, scopes, serialisation, answers and tools, and the SQL that gives the same rows."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from facetloom.errors import DashboardError
from facetloom.functions.selection import DateSelection, Interval, RangeSelection, Selections, TextSelection
from facetloom.operators.dashboard import DashboardBuilder
from facetloom.operators.query import Dimension, Order, Query, Value, selection_of
from facetloom.plans.catalog import NOW, ORACLES, QUERIES, STATUS_F, counted, events, items, orders, parts, people, query, read
from facetloom.plans.tools import DashboardTools, describe
from facetloom.sources.serialization import from_json, from_query_string, query_from_json, result_to_json, to_json, to_query_string



def rows(spark, values, schema):
    return spark.createDataFrame(values, schema)


def count(spark, n):
    return rows(spark, [(n,)], "n long")


def prices(spark, sf):
    """Facets of decimals, doubles, dates, timestamps and wall-clock times."""
    t = read(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    t = t.withColumn("rate", F.col("l_discount").cast("decimal(4,2)")).withColumn("size", F.round("l_quantity") * 1e6).withColumn("day", F.col("l_shipdate").cast("date"))
    return DashboardBuilder(t, "line").value("rate").value("size").value("day").value("l_shipdate").value("l_linenumber").value("l_returnflag").build()


@query("SELECT l_returnflag, count(*) AS total, count(*) FILTER (WHERE round(l_discount, 2) IN (0.04, 0.07)) AS filtered FROM lineitem GROUP BY 1")
def decimal_selection(spark, sf):
    return counted(prices(spark, sf), "l_returnflag", Selections().with_("rate", 0.04, "0.07"))


@query("SELECT round(l_discount, 2)::VARCHAR AS rate, count(*) AS total, count(*) FILTER (WHERE l_linenumber = 2) AS filtered, round(l_discount, 2) = 0.05 AS selected FROM lineitem GROUP BY round(l_discount, 2)")
def decimal_selected_flags(spark, sf):
    state = prices(spark, sf).calculate(Selections().with_("rate", 0.05).with_("l_linenumber", "2")).facets["rate"]
    return rows(spark, [(str(float(v.value)), v.total, v.filtered, v.selected) for v in state.values], "rate string, total long, filtered long, selected boolean")


@query("SELECT round(l_quantity) * 1e6 AS size, count(*) AS total, round(l_quantity) * 1e6 IN (1e7, 2e6) AS selected FROM lineitem GROUP BY round(l_quantity)")
def double_selected_flags(spark, sf):
    state = prices(spark, sf).calculate(Selections().with_("size", 1e7, 2_000_000)).facets["size"]
    return rows(spark, [(v.value, v.total, v.selected) for v in state.values], "size double, total long, selected boolean")


@query("SELECT l_returnflag, count(*) AS total, count(*) FILTER (WHERE l_shipdate::DATE IN (SELECT min(l_shipdate)::DATE FROM lineitem) OR l_shipdate::DATE = DATE '1995-06-17') AS filtered FROM lineitem GROUP BY 1")
def date_value_selection(spark, sf):
    first = read(spark, sf, "lineitem").agg(F.min("l_shipdate").cast("date").alias("d")).first()["d"]
    return counted(prices(spark, sf), "l_returnflag", Selections().with_("day", first, "1995-06-17"))


@query("SELECT l_returnflag, count(*) AS total, count(*) FILTER (WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem)) AS filtered FROM lineitem GROUP BY 1")
def wall_clock_value_selection(spark, sf):
    last = read(spark, sf, "lineitem").agg(F.max("l_shipdate").alias("d")).first()["d"]
    return counted(prices(spark, sf), "l_returnflag", Selections().with_("l_shipdate", last.isoformat()))


@query("SELECT t AS text, ok FROM (VALUES ('rate:4', true), ('rate:x', false), ('l_linenumber:5.0', true), ('l_linenumber:5.7', false), ('l_linenumber:true', false), ('size:1e3', true), ('l_returnflag:1', true), ('day:2020-02-30', false), ('day:2020-02-29', true)) v(t, ok)")
def value_coercion(spark, sf):
    d, out = prices(spark, sf), []
    for text, key, value in (("rate:4", "rate", 4), ("rate:x", "rate", "x"), ("l_linenumber:5.0", "l_linenumber", 5.0), ("l_linenumber:5.7", "l_linenumber", 5.7), ("l_linenumber:true", "l_linenumber", True), ("size:1e3", "size", "1e3"), ("l_returnflag:1", "l_returnflag", 1), ("day:2020-02-30", "day", "2020-02-30"), ("day:2020-02-29", "day", "2020-02-29")):
        try:
            d.facet(key).coerced(value)
            out.append((text, True))
        except DashboardError:
            out.append((text, False))
    return rows(spark, out, "text string, ok boolean")


@query("SELECT o_orderstatus, count(*) AS total, count(*) AS filtered FROM orders WHERE o_totalprice > 150000 AND o_orderpriority <> '5-LOW' GROUP BY 1")
def fixed_filters(spark, sf):
    d = DashboardBuilder(read(spark, sf, "orders"), "o_orderkey").where(F.col("o_totalprice") > 150_000).where(F.col("o_orderpriority") != "5-LOW").value("o_orderstatus").build()
    return counted(d, "o_orderstatus")


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_totalprice < 100000) AS filtered FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 50000 GROUP BY 1")
def scope_of_scope(spark, sf):
    inner = orders(spark, sf).scope(STATUS_F).scope(F.col("o_totalprice") >= 50_000)
    return counted(inner, "o_orderpriority", Selections().with_("o_totalprice", RangeSelection((Interval(None, 100_000.0, False, True),))))


@query("SELECT 'price' AS facet, b::VARCHAR AS value, count(o_orderkey) FILTER (WHERE o_totalprice < 100000) AS total FROM (VALUES (0, -1e18, 5e4), (1, 5e4, 1e5), (2, 1e5, 2e5), (3, 2e5, 1e18)) v(b, lo, hi) LEFT JOIN orders ON o_totalprice >= lo AND o_totalprice < hi GROUP BY b UNION ALL SELECT 'date', strftime(date_trunc('month', o_orderdate), '%Y-%m-%d'), count(*) FILTER (WHERE o_totalprice < 100000) FROM orders GROUP BY 2")
def scope_keeps_buckets(spark, sf):
    states = orders(spark, sf).scope(F.col("o_totalprice") < 100_000).calculate().facets
    return rows(spark, [(name, v.key, v.total) for name, k in (("price", "o_totalprice"), ("date", "o_orderdate")) for v in states[k].values], "facet string, value string, total long")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT o_custkey) AS customers, 1.0::DOUBLE AS n_share FROM orders WHERE o_orderstatus = 'F'")
def scope_metrics(spark, sf):
    m = orders(spark, sf).scope(STATUS_F).calculate().metrics
    return rows(spark, [(m["orders"].value, round(m["revenue"].value, 2), m["customers"].value, m["orders"].share)], "n long, revenue double, customers long, n_share double")


@query("SELECT kind, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-31' AND ts < TIMESTAMP '2024-02-01') AS before, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16') AS after FROM (SELECT nullif(event_type, 'error') AS kind, ts FROM events) GROUP BY 1")
def presets_follow_the_clock(spark, sf):
    clock = [NOW]
    d = events(spark, sf, unit="day", clock=lambda: clock[0])
    today = Selections().with_("ts", DateSelection(presets=("today",)))
    before = {v.value: v.filtered for v in d.calculate(today).facets["kind"].values}
    clock[0] = datetime(2024, 1, 15, 8, tzinfo=timezone.utc)
    after = {v.value: v.filtered for v in d.calculate(today).facets["kind"].values}
    return rows(spark, [(k, n, after[k]) for k, n in before.items()], "kind string, before long, after long")


@query("SELECT (SELECT count(*) FROM orders) AS total, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000) AS matching, (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS status_context, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS price_context")
def state_counts(spark, sf):
    s = orders(spark, sf).calculate(STATUS_F.with_("expensive", True))
    return rows(spark, [(s.total_count, s.matching_count, s.facets["o_orderstatus"].context_count, s.facets["expensive"].context_count)], "total long, matching long, status_context long, price_context long")


@query("SELECT (SELECT count(*) FROM part) AS words_context, (SELECT count(*) FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)) AS words_filtered, count(*) AS cleared FROM part")
def empty_selection_clears(spark, sf):
    d = parts(spark, sf)
    brand = d.df.agg(F.min("p_brand")).first()[0]
    some = Selections().with_("p_brand", brand)
    return rows(spark, [(d.calculate().facets["words"].context_count, d.calculate(some).facets["words"].context_count, d.calculate(some.with_("p_brand")).matching_count)], "words_context long, words_filtered long, cleared long")


def _matched(name, sql, selection):
    def run(spark, sf):
        return count(spark, orders(spark, sf).calculate(selection).matching_count)

    run.__name__ = name
    query(f"SELECT count(*) AS n FROM orders WHERE {sql}")(run)


def _price(s: RangeSelection) -> Selections:
    return Selections().with_("o_totalprice", s)


def _dates(s: DateSelection) -> Selections:
    return Selections().with_("o_orderdate", s)


_part = Interval(50_000.0, 100_000.0, False, True)
_whole = RangeSelection((Interval(20_000.0, 300_000.0),))
_day = lambda y, m=1, d=1: datetime(y, m, d, tzinfo=timezone.utc)
_matched("algebra_values", "o_orderstatus IN ('O', 'P')", STATUS_F.toggle("o_orderstatus", "O", "P").toggle("o_orderstatus", "F"))
_matched("algebra_join_adjacent", "o_totalprice >= 50000 AND o_totalprice < 200000", _price(RangeSelection((_part, Interval(100_000.0, 200_000.0, False, True)))))
_matched("algebra_carve", "o_totalprice BETWEEN 20000 AND 300000 AND NOT (o_totalprice >= 50000 AND o_totalprice < 100000)", _price(_whole.remove(_part)))
_matched("algebra_toggle_covered", "o_totalprice BETWEEN 20000 AND 300000 AND NOT (o_totalprice >= 50000 AND o_totalprice < 100000)", _price(_whole.toggle(_part)))
_matched("algebra_toggle_added", "(o_totalprice >= 50000 AND o_totalprice < 100000) OR o_totalprice > 300000", _price(RangeSelection((_part,)).toggle(Interval(300_000.0, None, True))))
_matched("algebra_toggle_null", "o_totalprice < 50000 OR o_totalprice IS NULL", _price(RangeSelection((Interval(None, 50_000.0, False, True),)).toggle_null()))
_matched("algebra_date_parts", "o_orderdate >= '1995-01-01' AND o_orderdate < '1996-07-01' AND NOT (o_orderdate >= '1995-03-01' AND o_orderdate < '1995-04-01')", _dates(DateSelection((Interval(_day(1995), _day(1996)), Interval(_day(1996), _day(1996, 7)))).remove(Interval(_day(1995, 3), _day(1995, 4)))))


@query("SELECT lo, hi, lo_open, hi_open FROM (VALUES (1.0::DOUBLE, 3.0::DOUBLE, false, false), (4.0, 5.0, false, true), (5.0, 6.0, true, false)) v(lo, hi, lo_open, hi_open)")
def algebra_touch_rule(spark, sf):
    s = RangeSelection((Interval(5.0, 6.0, True), Interval(2.0, 3.0), Interval(4.0, 5.0, False, True), Interval(1.0, 2.0, False, True)))
    return rows(spark, [(i.lo, i.hi, i.lo_open, i.hi_open) for i in s.intervals], "lo double, hi double, lo_open boolean, hi_open boolean")


@query("SELECT t AS what, true AS refused FROM (VALUES ('nan'), ('reversed'), ('preset'), ('kind'), ('key')) v(t)")
def algebra_refusals(spark, sf):
    d = orders(spark, sf)
    tries = {"nan": lambda: Interval(float("nan"), 1.0), "reversed": lambda: Interval(2.0, 1.0), "preset": lambda: DateSelection(presets=("someday",)), "kind": lambda: d.calculate(Selections().with_("o_orderstatus", RangeSelection((Interval(1.0, 2.0),)))), "key": lambda: d.calculate(Selections().with_("nothing", 1))}
    out = []
    for name, attempt in tries.items():
        try:
            attempt()
            out.append((name, False))
        except DashboardError:
            out.append((name, True))
    return rows(spark, out, "what string, refused boolean")


@query("SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def toggle_group_selects_members(spark, sf):
    d = people(spark, sf)
    return count(spark, d.calculate(d.toggle_group(Selections(), "c_nationkey", "asia")).matching_count)


@query("SELECT b AS bucket, count(*) AS n, true AS selected FROM (SELECT CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 200000 THEN 2 ELSE 3 END AS b FROM orders) GROUP BY 1")
def bucket_clicks(spark, sf):
    d, out = orders(spark, sf), []
    for v in d.calculate().facets["o_totalprice"].values:
        s = d.calculate(Selections().with_("o_totalprice", RangeSelection((v.interval,))))
        out.append((v.value, s.matching_count, [x.selected for x in s.facets["o_totalprice"].values] == [x.key == v.key for x in s.facets["o_totalprice"].values]))
    return rows(spark, out, "bucket int, n long, selected boolean")


@query("SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, count(*) AS total, date_trunc('month', o_orderdate) >= '1995-01-01' AND date_trunc('month', o_orderdate) < '1996-01-01' AS selected FROM orders GROUP BY date_trunc('month', o_orderdate)")
def date_bucket_flags(spark, sf):
    s = orders(spark, sf).calculate(_dates(DateSelection((Interval(_day(1995), _day(1996, 1, 20)),)))).facets["o_orderdate"]
    return rows(spark, [(v.key, v.total, v.selected) for v in s.values], "period string, total long, selected boolean")


@query("SELECT min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def range_minimum_maximum(spark, sf):
    f = orders(spark, sf).scope(STATUS_F).calculate().facets["o_totalprice"]
    return rows(spark, [(f.minimum, f.maximum)], "least double, most double")


@query("SELECT s AS segment, count(*) AS total, count(*) AS filtered FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS s FROM customer) GROUP BY 1")
def own_comparer(spark, sf):
    c = read(spark, sf, "customer").withColumn("segment", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return counted(DashboardBuilder(c, "c_custkey").value("segment", fold=lambda x: x).build(), "segment")


@query("SELECT count(DISTINCT s) AS exact, count(DISTINCT lower(s)) AS folded FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS s FROM customer)")
def own_comparer_of_distinct(spark, sf):
    c = read(spark, sf, "customer").withColumn("segment", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    m = DashboardBuilder(c, "c_custkey").metric("distinct", "segment", "exact", fold=lambda x: x).metric("distinct", "segment", "folded").build().calculate().metrics
    return rows(spark, [(m["exact"].value, m["folded"].value)], "exact long, folded long")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS place FROM orders WHERE o_orderstatus = 'P' QUALIFY place <= 30")
def dashboard_order(spark, sf):
    d = DashboardBuilder(read(spark, sf, "orders"), "o_orderkey").value("o_orderstatus").order_by(F.desc("o_totalprice")).build()
    found = d.calculate(Selections().with_("o_orderstatus", "P")).get_items(0, 30).collect()
    return rows(spark, [(r["o_orderkey"], i) for i, r in enumerate(found, 1)], "o_orderkey long, place int")


@query("SELECT kind, n, row_number() OVER (ORDER BY kind NULLS LAST)::INT AS place FROM (SELECT nullif(event_type, 'error') AS kind, count(*) AS n FROM events GROUP BY 1)")
def query_null_group_last(spark, sf):
    found = events(spark, sf, unit="day").query(Query(("kind",))).collect()
    return rows(spark, [(r[0], r[1], i) for i, r in enumerate(found, 1)], "kind string, n long, place int")


@query("SELECT strftime(m, '%Y-%m-%d') AS start, strftime(m, '%Y-%m-%d') AS lo, strftime(m + INTERVAL 1 MONTH, '%Y-%m-%d') AS hi, 'month' AS unit, n FROM (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1)")
def query_period_cells(spark, sf):
    found = orders(spark, sf).query(Query(("o_orderdate",)))
    cells = [(r[0], selection_of(found.columns[0], r[0]), r[1]) for r in found.collect()]
    return rows(spark, [(str(c["start"]), str(p.lo.date()), str(p.hi.date()), c["granularity"], n) for c, p, n in cells], "start string, lo string, hi string, unit string, n long")


@query("SELECT b AS bucket, nullif(lo, -1) AS lo, nullif(hi, -1) AS hi, count(*) AS n, count(*) AS again FROM orders JOIN (VALUES (0, -1::DOUBLE, 5e4::DOUBLE), (1, 5e4, 1e5), (2, 1e5, 2e5), (3, 2e5, -1)) v(b, lo, hi) ON (lo < 0 OR o_totalprice >= lo) AND (hi < 0 OR o_totalprice < hi) GROUP BY b, lo, hi")
def query_interval_cells(spark, sf):
    d = orders(spark, sf)
    found, out = d.query(Query(("o_totalprice",))), []
    for r in found.collect():
        part = selection_of(found.columns[0], r[0])
        out.append((r[0]["index"], r[0]["from"], r[0]["to"], r[1], d.calculate(_price(RangeSelection((part,)))).matching_count))
    return rows(spark, out, "bucket int, lo double, hi double, n long, again long")


@query("SELECT p_type AS kind, count(*) AS \"Count\" FROM part GROUP BY 1")
def query_plain_property(spark, sf):
    return parts(spark, sf).query(Query((Dimension("p_type", alias="kind"),))).df


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) GROUP BY 1")
def query_collection_property(spark, sf):
    d = DashboardBuilder(read(spark, sf, "part").withColumn("tags", F.split("p_name", " ")), "p_partkey").value("p_brand").build()
    return d.query(Query((Dimension("tags", alias="word"),), (Value(aggregation="count", alias="n"),))).df


@query("SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS at, count(*) AS n FROM orders GROUP BY 1")
def query_undivided_dates(spark, sf):
    found = orders(spark, sf).query(Query((Dimension("o_orderdate", plain=True, alias="at"),), (Value(aggregation="count", alias="n"),)))
    return found.df.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "n")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 150000 AND o_orderpriority = '1-URGENT' GROUP BY 1")
def query_where_callable(spark, sf):
    q = Query(("o_orderstatus",), (Value(aggregation="count", alias="n"),), where=lambda t: (t["o_totalprice"] > 150_000) & (t["o_orderpriority"] == "1-URGENT"))
    return orders(spark, sf).query(q).df


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1")
def query_json_own_parser(spark, sf):
    d = orders(spark, sf)
    return d.query(query_from_json(d, '{"groupBy": ["o_orderstatus"], "values": [{"aggregation": "count", "as": "n"}], "where": "o_totalprice > 150000"}', parser=lambda text, types: F.expr(text))).df


@query("SELECT c_custkey, c_nationkey, n_name AS \"c_nationkey label\" FROM customer JOIN nation ON c_nationkey = n_nationkey ORDER BY c_custkey LIMIT 40")
def rows_with_labels(spark, sf):
    return people(spark, sf).query(Query(columns=("c_custkey", "c_nationkey"), take=40)).labelled()


@query("SELECT round(sum(l_extendedprice), 4) AS s FROM (SELECT l_extendedprice::DECIMAL(18, 4) AS l_extendedprice FROM lineitem)")
def precise_sums(spark, sf):
    big = read(spark, sf, "lineitem").select("l_extendedprice").union(spark.range(2).select(F.when(F.col("id") == 0, 1e11 + 0.3).otherwise(-1e11 - 0.3)))
    s = DashboardBuilder(big.withColumn("i", F.monotonically_increasing_id())).metric("sum", "l_extendedprice", "s").build().calculate().metrics["s"].value
    return rows(spark, [(str(round(s, 4)),)], "s string").select(F.col("s").cast("decimal(38,4)").alias("s"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09 12:30:00' GROUP BY 1")
def selections_from_json(spark, sf):
    d = events(spark, sf, unit="day")
    s = from_json(d, '{"kind": {"values": ["CLICK", "view"]}, "ts": {"from": "2024-01-05", "to": "2024-01-09T12:30Z"}, "unknown": {"values": [1]}}')
    assert from_json(d, to_json(s, d)) == s
    return d.matching(s).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE (event_type = 'click' OR event_type = 'error') AND (ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-09' OR ts >= TIMESTAMP '2024-01-31' AND ts < TIMESTAMP '2024-02-01') GROUP BY 1")
def selections_from_url(spark, sf):
    d = events(spark, sf, unit="day")
    s = from_query_string(d, "https://x.org/?page=2&d.kind=click,null&d.ts=2024-01-05T00:00Z..2024-01-09T00:00Z,today", "d.")
    assert from_query_string(d, to_query_string(s, "d.", dash=d), "d.") == s
    return d.matching(s).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n FROM orders WHERE (o_totalprice >= 50000 AND o_totalprice < 100000 OR o_totalprice > 300000) AND o_orderstatus = 'F'")
def selections_url_intervals(spark, sf):
    d = orders(spark, sf)
    s = from_query_string(d, "o_totalprice=%5B50000..100000),(300000..)&o_orderstatus=f", strict=True)
    return count(spark, d.calculate(s).matching_count)


@query("SELECT k AS what, v AS text FROM (VALUES ('json', '{\"o_orderstatus\": {\"values\": [\"F\"]}, \"o_totalprice\": {\"from\": 50000.0, \"to\": 100000.0, \"toInclusive\": false}}'), ('url', 'o_orderstatus=F&o_totalprice=%5B50000..100000%29'), ('text', '{\"find\": {\"text\": \"License\"}}')) v(k, v)")
def selections_as_text(spark, sf):
    s = STATUS_F.with_("o_totalprice", RangeSelection((_part,)))
    return rows(spark, [("json", to_json(s)), ("url", to_query_string(s)), ("text", to_json(Selections().with_("find", TextSelection(" License "))))], "what string, text string")


@query("SELECT k AS what, v AS path FROM (VALUES ('twice', 'o_orderstatus'), ('unknown', 'selections.nothing'), ('bound', 'selections.o_totalprice')) v(k, v)")
def selections_strict_reading(spark, sf):
    d, out = orders(spark, sf), []
    for what, text in (("twice", '{"o_orderstatus": {"values": ["F"]}, "o_orderstatus": {"values": ["O"]}}'), ("unknown", '{"nothing": {"values": [1]}}'), ("bound", '{"o_totalprice": {"from": "much"}}')):
        try:
            from_json(d, text, strict=True)
        except DashboardError as e:
            out.append((what, e.path))
    return rows(spark, out, "what string, path string")


@query("SELECT count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def selections_by_label(spark, sf):
    d = people(spark, sf)
    name = read(spark, sf, "nation").agg(F.min("n_name")).first()[0]
    return count(spark, d.calculate(from_json(d, json.dumps({"c_nationkey": {"values": [name.lower()]}}), strict=True)).matching_count)


@query("SELECT 'o_totalprice=pence%3A12345' AS url, 'pence:12345' AS json, 123.45::DOUBLE AS back")
def own_formatter(spark, sf):
    f = {"format": lambda v: f"pence:{round(v * 100)}", "parse": lambda t: int(t.removeprefix("pence:")) / 100}
    d = DashboardBuilder(read(spark, sf, "orders"), "o_orderkey").value("o_totalprice", **f).build()
    s = Selections().with_("o_totalprice", 123.45)
    url, text = to_query_string(s, dash=d), to_json(s, d)
    assert from_query_string(d, url) == s == from_json(d, text)
    return rows(spark, [(url.replace("pence:", "pence%3A"), json.loads(text)["o_totalprice"]["values"][0], next(iter(from_json(d, text).get("o_totalprice").values)))], "url string, json string, back double")


@query("SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS quarter, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def answer_json(spark, sf):
    d = orders(spark, sf)
    q = query_from_json(d, '{"groupBy": ["o_orderdate:Quarter"], "values": [{"aggregation": "count", "as": "n"}, {"aggregation": "avg", "name": "o_totalprice", "as": "mean"}], "selections": {"o_orderstatus": {"values": ["f"]}}, "where": "o_totalprice>100000", "orderBy": "-n", "take": 5}')
    answer = json.loads(json.dumps(result_to_json(d, d.query(q))))
    return rows(spark, [(a, n, round(m, 4)) for a, n, m in answer["rows"]], "quarter string, n long, mean double")


@query("SELECT CASE b WHEN 0 THEN '[..50000)' WHEN 1 THEN '[50000..100000)' WHEN 2 THEN '[100000..200000)' ELSE '200000..' END AS price, count(*) AS n FROM (SELECT CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 200000 THEN 2 ELSE 3 END AS b FROM orders) GROUP BY 1")
def answer_json_intervals(spark, sf):
    d = orders(spark, sf)
    return rows(spark, [tuple(r) for r in result_to_json(d, d.query(Query(("o_totalprice",))))["rows"]], "price string, n long")


@query("SELECT c_nationkey::BIGINT AS value, n_name AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def answer_json_labels(spark, sf):
    d = people(spark, sf)
    return rows(spark, [(c["value"], c["label"], n) for c, n in result_to_json(d, d.query(Query(("c_nationkey",))))["rows"]], "value long, label string, n long")


@query("SELECT k AS key, r AS role, t AS kind, g AS granularity, a AS aggregation FROM (VALUES ('Quarter(o_orderdate)', 'dimension', 'period', 'quarter', NULL), ('Count', 'value', 'number', NULL, 'count'), ('Sum(o_totalprice)', 'value', 'number', NULL, 'sum'), ('revenue', 'value', 'number', NULL, 'sum')) v(k, r, t, g, a)")
def query_column_metadata(spark, sf):
    q = Query((Dimension("o_orderdate", "quarter"),), (Value(aggregation="count"), Value("o_totalprice", "sum"), "revenue"))
    return rows(spark, [(c.key, c.role, c.kind, c.granularity, c.aggregation) for c in orders(spark, sf).query(q).columns], "key string, role string, kind string, granularity string, aggregation string")


@query("SELECT p AS path, h AS hint FROM (VALUES ('groupBy[0]', true), ('values[0]', false), ('orderBy', false), ('take', false), ('selections.O_orderstatus', true)) v(p, h)")
def query_mistakes(spark, sf):
    d, out = orders(spark, sf), []
    for q in (Query(("o_orderstats",)), Query(values=(Value("o_orderstatus", "sum"),)), Query(("o_orderstatus",), order_by=Order("x")), Query(take=-1), Query(selections=Selections().with_("O_orderstatus", "F"))):
        try:
            d.query(q)
        except DashboardError as e:
            out.append((e.path, "did you mean" in str(e)))
    return rows(spark, out, "path string, hint boolean")


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1")
def describe_values(spark, sf):
    facets = {f["key"]: f for f in describe(orders(spark, sf))["facets"]}
    assert facets["o_orderdate"]["granularity"] == "month" and "values" in facets["expensive"]
    return rows(spark, [(v["value"], v["count"]) for v in facets["o_orderstatus"]["values"]], "value string, n long")


@query("SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def tool_query(spark, sf):
    tools = DashboardTools(orders(spark, sf)).tools()
    answer = tools["dashboard_query"]('{"groupBy": ["o_orderpriority"], "values": ["count"], "selections": {"o_orderstatus": {"values": ["F"]}}}')
    return rows(spark, [tuple(r) for r in answer["rows"]], "priority string, n long")


@query("SELECT count(*) AS matching, 1::BIGINT AS shown, 'selections.nothing' AS path FROM orders WHERE o_orderstatus = 'F'")
def tool_show(spark, sf):
    seen: list = []
    tools = DashboardTools(orders(spark, sf), on_show=seen.append).tools()
    shown, wrong = tools["dashboard_show"]('{"o_orderstatus": {"values": ["F"]}}'), tools["dashboard_show"]('{"nothing": {"values": ["F"]}}')
    return rows(spark, [(shown["matching"], len(seen), wrong["path"])], "matching long, shown long, path string")


@query("SELECT preset, count(*) AS total FROM events, (VALUES ('thisMonth', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01')) v(preset, a, b) WHERE ts >= a AND ts < b GROUP BY 1")
def presets_without_empty_ones(spark, sf):
    t = read(spark, sf, "events")
    d = DashboardBuilder(t, "event_id").date("ts", unit="day", presets=("thisMonth", "lastYear"), skip_empty_presets=True).now(lambda: NOW).build()
    return rows(spark, [(p.value, p.total) for p in d.calculate().facets["ts"].presets], "preset string, total long")


@query("SELECT p_name AS value, count(*) AS total FROM part GROUP BY 1")
def facet_of_many_values(spark, sf):
    return rows(spark, [(v.value, v.total) for v in parts(spark, sf).calculate().facets["p_name"].values], "value string, total long")


__all__ = ["ORACLES", "QUERIES"]
