"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from facetloom.functions.instants import instant_of
from facetloom.functions.selection import DateSelection, Interval, RangeSelection, Selections, TextSelection
from facetloom.functions.where import parse
from facetloom.operators.dashboard import DashboardBuilder
from facetloom.operators.query import Dimension, Order, Query, Value

NOW = datetime(2024, 1, 31, 12, tzinfo=timezone.utc)
QUERIES, ORACLES = {}, {}
CUTS = (50_000, 100_000, 200_000)
BUCKET = "CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 200000 THEN 2 ELSE 3 END"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark, sf, **options):
    return (
        DashboardBuilder(read(spark, sf, "orders"), "o_orderkey")
        .value("o_orderstatus", **options)
        .value("o_orderpriority")
        .boolean(F.col("o_totalprice") > 100_000, "expensive")
        .range("o_totalprice", cuts=CUTS)
        .date("o_orderdate", unit="month")
        .count("orders")
        .metric("sum", "o_totalprice", "revenue")
        .metric("distinct", "o_custkey", "customers")
        .calculated("per_order", lambda v, s: v("revenue") / v("orders"))
        .now(lambda: NOW)
        .build()
    )


def items(spark, sf, **options):
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = read(spark, sf, "lineitem").withColumn("line", key)
    return (
        DashboardBuilder(rows, "line")
        .value("l_suppkey", **options)
        .value("l_returnflag")
        .value("l_linestatus")
        .range("l_quantity", cuts=(10, 20, 30))
        .date("l_shipdate", unit="quarter")
        .count("rows")
        .metric("sum", "l_extendedprice", "revenue")
        .metric("average", "l_discount", "discount")
        .metric("min", "l_quantity", "least")
        .metric("max", "l_quantity", "most")
        .metric("distinct", "l_suppkey", "suppliers")
        .now(lambda: NOW)
        .build()
    )


def events(spark, sf, zone="UTC", unit=None, clock=lambda: NOW):
    rows = read(spark, sf, "events").withColumn("kind", F.nullif(F.col("event_type"), F.lit("error")))
    presets = ("today", "yesterday", "last7Days", "thisWeek", "thisMonth", "yearToDate")
    return DashboardBuilder(rows, "event_id").value("kind").date(instant_of(F.col("ts")), "ts", zone=zone, unit=unit, presets=presets).count("n").now(clock).build()


def parts(spark, sf):
    return DashboardBuilder(read(spark, sf, "part"), "p_partkey").multi(F.split("p_name", " "), "words").value("p_brand").value("p_name").count("n").build()


def people(spark, sf):
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    flat = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    segment = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    return DashboardBuilder(flat.withColumn("segment", segment), "c_custkey").value("segment").value("c_nationkey", label=F.col("n_name"), group=F.col("r_name")).count("n").build()


STATUS_F = Selections().with_("o_orderstatus", "F")
RANGE = Selections().with_("o_totalprice", RangeSelection((Interval(50_000.0, 100_000.0, False, True), Interval(150_000.0, None))))


def counted(dash, key, sel=Selections(), name=None, rank=False):
    return dash.facet_counts(key, sel, ranked_too=rank).select(F.col("value").alias(name or key), "total", "filtered", *["rank"] * rank)


@query("SELECT o_orderstatus, count(*) AS total, count(*) AS filtered, row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey))::INT AS rank FROM orders GROUP BY 1")
def value_facet_totals(spark, sf):
    return counted(orders(spark, sf), "o_orderstatus", rank=True)


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS filtered, row_number() OVER (ORDER BY count(*) FILTER (WHERE o_orderstatus = 'F') DESC, count(*) DESC, min(o_orderkey))::INT AS rank FROM orders GROUP BY 1")
def value_facet_own_exclusion(spark, sf):
    return counted(orders(spark, sf), "o_orderpriority", STATUS_F, rank=True)


@query("SELECT o_orderstatus, count(*) AS total, count(*) AS filtered, row_number() OVER (ORDER BY count(*) DESC, min(o_orderkey))::INT AS rank FROM orders GROUP BY 1")
def value_facet_own_selection(spark, sf):
    return counted(orders(spark, sf), "o_orderstatus", STATUS_F, rank=True)


@query("SELECT l_returnflag, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'O' AND l_quantity < 10) AS filtered FROM lineitem GROUP BY 1")
def value_facet_zero_counts(spark, sf):
    sel = Selections().with_("l_linestatus", "O").with_("l_quantity", RangeSelection((Interval(None, 10.0, False, True),)))
    return counted(items(spark, sf), "l_returnflag", sel)


@query("SELECT nullif(event_type, 'error') AS kind, count(*) AS total, count(*) AS filtered, row_number() OVER (ORDER BY count(*) DESC, nullif(event_type, 'error') IS NULL, min(event_id))::INT AS rank FROM events GROUP BY 1")
def value_facet_nulls(spark, sf):
    return counted(events(spark, sf, unit="day"), "kind", rank=True)


@query("SELECT arg_min(s, c_custkey) AS segment, count(*) AS total, count(*) AS filtered FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS s FROM customer) GROUP BY lower(s)")
def value_facet_casefold(spark, sf):
    return counted(people(spark, sf), "segment")


@query("SELECT CAST(o_totalprice > 100000 AS VARCHAR) AS expensive, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS filtered FROM orders GROUP BY 1")
def boolean_facet_counts(spark, sf):
    return counted(orders(spark, sf), "expensive", STATUS_F)


@query("""WITH c AS (SELECT l_suppkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS filtered, min(l_orderkey * 8 + l_linenumber) AS f FROM lineitem GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY (l_suppkey = 3) DESC, filtered DESC, total DESC, f) AS n FROM c)
SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, total, filtered FROM r WHERE n <= 10
UNION ALL SELECT 'Other', (SELECT count(*) FROM lineitem) - sum(total)::BIGINT, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') - sum(filtered)::BIGINT FROM r WHERE n <= 10""")
def facet_top_n_other(spark, sf):
    state = items(spark, sf, top=10).calculate(Selections().with_("l_suppkey", 3).with_("l_returnflag", "R")).facets["l_suppkey"]
    rows = [(str(v.value), v.total, v.filtered) for v in state.values] + [("Other", *state.other)]
    return spark.createDataFrame(rows, "l_suppkey string, total long, filtered long")


@query("SELECT CAST(l_suppkey AS VARCHAR) AS l_suppkey, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'R') AS filtered, row_number() OVER (ORDER BY count(*) DESC, count(*) FILTER (WHERE l_returnflag = 'R') DESC, min(l_orderkey * 8 + l_linenumber))::INT AS rank FROM lineitem GROUP BY 1")
def facet_rank_by_total(spark, sf):
    return counted(items(spark, sf, rank="total"), "l_suppkey", Selections().with_("l_returnflag", "R"), rank=True)


@query("SELECT p_name AS value, count(*) AS total FROM part WHERE contains(lower(p_name), 'a') GROUP BY lower(p_name), p_name ORDER BY count(*) DESC, min(p_partkey) LIMIT 15")
def facet_search(spark, sf):
    return spark.createDataFrame([(v.value, v.total) for v in parts(spark, sf).search("p_name", "A", 15)], "value string, total long")


@query("SELECT CAST(c_nationkey AS VARCHAR) AS nation, any_value(n_name) AS label, count(*) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def facet_labels(spark, sf):
    return people(spark, sf).facet_counts("c_nationkey", ranked_too=False).select(F.col("value").alias("nation"), "label", "total")


@query("SELECT r_name AS grp, count(*) AS total, count(*) AS filtered FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def facet_groups(spark, sf):
    return spark.createDataFrame(people(spark, sf).calculate().facets["c_nationkey"].groups, "grp string, total long, filtered long")


@query("SELECT w AS words, count(*) AS total, count(*) AS filtered FROM (SELECT unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part) GROUP BY 1")
def multi_value_counts(spark, sf):
    d = parts(spark, sf)
    return d.facet_counts("words", ranked_too=False).select(F.lower("value").alias("words"), "total", "filtered")


@query("SELECT p_brand, count(*) AS total, count(*) FILTER (WHERE list_has_any(string_split(lower(p_name), ' '), (SELECT string_split(lower(p_name), ' ') FROM part ORDER BY p_partkey LIMIT 1))) AS filtered FROM part GROUP BY 1")
def multi_value_any_filter(spark, sf):
    d = parts(spark, sf)
    first = d.df.orderBy("p_partkey").first()["p_name"].split(" ")
    return counted(d, "p_brand", Selections().with_("words", *first))


@query(f"SELECT CAST({BUCKET} AS VARCHAR) AS bucket, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS filtered FROM orders GROUP BY 1")
def range_explicit_buckets(spark, sf):
    return counted(orders(spark, sf), "o_totalprice", STATUS_F, "bucket")


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE (o_totalprice >= 50000 AND o_totalprice < 100000) OR o_totalprice >= 150000) AS filtered FROM orders GROUP BY 1")
def range_interval_selection(spark, sf):
    return counted(orders(spark, sf), "o_orderpriority", RANGE)


@query("SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value IS NULL OR value <= 10) AS filtered FROM (SELECT event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events) GROUP BY 1")
def range_null_selection(spark, sf):
    rows = read(spark, sf, "events").withColumn("v", F.when(F.col("event_type") != "error", F.col("value")))
    d = DashboardBuilder(rows, "event_id").value("event_type").range("v", cuts=(10,)).build()
    return counted(d, "event_type", Selections().with_("v", RangeSelection((Interval(None, 10.0),), True)))


@query("""WITH v AS (SELECT l_extendedprice AS x, row_number() OVER () - 1 AS i FROM lineitem WHERE l_extendedprice IS NOT NULL),
n AS (SELECT greatest(1, (count(*) + 99999) // 100000) AS stride, min(x) AS least, max(x) AS most FROM v),
s AS (SELECT list_sort(list(x)) AS l FROM v, n WHERE i % stride = 0),
b AS (SELECT l[floor(0.02 * (len(l) - 1))::BIGINT + 1] AS lo, l[ceil(0.98 * (len(l) - 1))::BIGINT + 1] AS hi FROM s),
w AS (SELECT lo, hi, 10.0 ** floor(log10((hi - lo) / 10)) AS p, (hi - lo) / 10 AS raw FROM b),
t AS (SELECT lo, hi, p * CASE WHEN raw / p >= sqrt(50) THEN 10 WHEN raw / p >= sqrt(10) THEN 5 WHEN raw / p >= sqrt(2) THEN 2 ELSE 1 END AS step FROM w),
k AS (SELECT step, floor(lo / step)::BIGINT AS a, ceil(hi / step)::BIGINT AS z FROM t),
e AS (SELECT unnest(range(a - 1, z + 1)) AS i, step, a, z FROM k),
r AS (SELECT CASE WHEN i >= a THEN i * step END AS lo, CASE WHEN i < z THEN (i + 1) * step END AS hi, i = z - 1 AND (SELECT most FROM n) <= z * step AS closed FROM e, n WHERE (i >= a OR least < a * step) AND (i < z OR most > z * step))
SELECT lo, hi, count(x) AS total FROM r LEFT JOIN v ON (lo IS NULL OR x >= lo) AND (hi IS NULL OR x < hi OR closed AND x <= hi) GROUP BY lo, hi""")
def range_auto_buckets(spark, sf):
    d = DashboardBuilder(read(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 8 + F.col("l_linenumber")), "line").range("l_extendedprice").build()
    rows = [(v.interval.lo, v.interval.hi, v.total) for v in d.calculate().facets["l_extendedprice"].values]
    return spark.createDataFrame(rows, "lo double, hi double, total long")


def _dates(unit):
    def run(spark, sf):
        rows = read(spark, sf, "orders")
        d = DashboardBuilder(rows, "o_orderkey").value("o_orderstatus").date("o_orderdate", unit=unit).build()
        return counted(d, "o_orderdate", STATUS_F, "period")

    run.__name__ = f"date_{unit}_buckets"
    return query(f"SELECT strftime(date_trunc('{unit}', o_orderdate), '%Y-%m-%d') AS period, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS filtered FROM orders GROUP BY 1")(run)


for _unit in ("day", "week", "month", "quarter", "year"):
    _dates(_unit)


@query("SELECT strftime(date_trunc('day', timezone('Europe/Stockholm', timezone('UTC', ts))), '%Y-%m-%d') AS period, count(*) AS total, count(*) AS filtered FROM events GROUP BY 1")
def date_zone_buckets(spark, sf):
    return counted(events(spark, sf, "Europe/Stockholm", "day"), "ts", name="period")


@query("SELECT 'day' AS unit, count(DISTINCT date_trunc('day', ts)) AS periods FROM events")
def date_auto_granularity(spark, sf):
    s = events(spark, sf).calculate().facets["ts"]
    return spark.createDataFrame([(s.unit, len([v for v in s.values if v.key is not None]))], "unit string, periods long")


@query("""SELECT p AS preset, count(*) FILTER (WHERE ts >= a AND ts < b) AS total, count(*) FILTER (WHERE ts >= a AND ts < b AND event_type = 'click') AS filtered FROM events,
(VALUES ('today', TIMESTAMP '2024-01-31', TIMESTAMP '2024-02-01'), ('yesterday', TIMESTAMP '2024-01-30', TIMESTAMP '2024-01-31'), ('last7Days', TIMESTAMP '2024-01-25', TIMESTAMP '2024-02-01'),
('thisWeek', TIMESTAMP '2024-01-29', TIMESTAMP '2024-02-05'), ('thisMonth', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01'), ('yearToDate', TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01')) v(p, a, b) GROUP BY 1""")
def date_presets(spark, sf):
    s = events(spark, sf, unit="day").calculate(Selections().with_("kind", "click")).facets["ts"]
    return spark.createDataFrame([(p.value, p.total, p.filtered) for p in s.presets], "preset string, total long, filtered long")


@query("SELECT event_type AS kind, count(*) AS total, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' OR ts >= TIMESTAMP '2024-01-31' AND ts < TIMESTAMP '2024-02-01') AS filtered FROM (SELECT nullif(event_type, 'error') AS event_type, ts FROM events) GROUP BY 1")
def date_selection(spark, sf):
    at = lambda d: datetime(2024, 1, d, tzinfo=timezone.utc)
    sel = Selections().with_("ts", DateSelection((Interval(at(10), at(20)),), ("today",)))
    return counted(events(spark, sf, unit="day"), "kind", sel)


@query("SELECT lang, count(*) AS total, count(*) FILTER (WHERE contains(lower(text), 'license')) AS filtered FROM documents GROUP BY 1")
def text_facet(spark, sf):
    d = DashboardBuilder(read(spark, sf, "documents"), "doc_id").value("lang").text("find", lambda t: F.contains(F.lower("text"), F.lower(F.lit(t)))).build()
    return counted(d, "lang", Selections().with_("find", TextSelection(" License ")))


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS revenue, round(avg(l_discount), 6) AS discount, min(l_quantity) AS least, max(l_quantity) AS most, count(DISTINCT l_suppkey) AS suppliers, round(count(*) / (SELECT count(*) FROM lineitem), 6) AS n_share, round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem), 6) AS revenue_share FROM lineitem WHERE l_returnflag = 'R'")
def metrics_matching(spark, sf):
    m = items(spark, sf).calculate(Selections().with_("l_returnflag", "R")).metrics
    row = (m["rows"].value, round(m["revenue"].value, 2), round(m["discount"].value, 6), m["least"].value, m["most"].value, m["suppliers"].value, round(m["rows"].share, 6), round(m["revenue"].share, 6))
    return spark.createDataFrame([row], "n long, revenue double, discount double, least double, most double, suppliers long, n_share double, revenue_share double")


@query("SELECT count(*) AS orders, round(sum(o_totalprice) / count(*), 4) AS per_order FROM orders WHERE o_orderstatus = 'F'")
def metric_calculated(spark, sf):
    m = orders(spark, sf).calculate(STATUS_F).metrics
    return spark.createDataFrame([(m["orders"].value, round(m["per_order"].value, 4))], "orders long, per_order double")


@query("SELECT l_returnflag, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'O') AS filtered FROM lineitem WHERE l_quantity >= 20 GROUP BY 1")
def scope_predicate(spark, sf):
    return counted(items(spark, sf).scope(F.col("l_quantity") >= 20), "l_returnflag", Selections().with_("l_linestatus", "O"))


@query("SELECT o_orderpriority, count(*) AS total, count(*) FILTER (WHERE o_totalprice > 100000) AS filtered FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def scope_selections(spark, sf):
    return counted(orders(spark, sf).scope(STATUS_F), "o_orderpriority", Selections().with_("expensive", True))


@query("SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def query_group1(spark, sf):
    return orders(spark, sf).query(Query(("o_orderpriority",), ("orders", "revenue"), selections=STATUS_F)).df.withColumn("revenue", F.round("revenue", 2))


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS q, max(l_extendedprice) AS top FROM lineitem GROUP BY 1, 2")
def query_group2(spark, sf):
    q = Query(("l_returnflag", "l_linestatus"), (Value("l_quantity", "average", "q"), Value("l_extendedprice", "max", "top")))
    return items(spark, sf).query(q).df.withColumn("q", F.round("q", 6))


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders")
def query_no_dims(spark, sf):
    return orders(spark, sf).query(Query(values=(Value(aggregation="count", alias="n"), Value("o_totalprice", "sum", "s")))).df.withColumn("s", F.round("s", 2))


@query("SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0")
def query_no_rows(spark, sf):
    return orders(spark, sf).query(Query(values=(Value(aggregation="count", alias="n"), Value("o_totalprice", "sum", "s")), where=F.col("o_orderkey") < 0)).df


@query("SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, count(*) AS n FROM orders GROUP BY 1")
def query_period_override(spark, sf):
    return orders(spark, sf).query(Query((Dimension("o_orderdate", "quarter", alias="q"),), (Value(aggregation="count", alias="n"),))).df.select(F.col("q.start").alias("q"), "n")


@query("SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS w, count(*) AS n FROM orders GROUP BY 1")
def query_property_period(spark, sf):
    return orders(spark, sf).query(Query((Dimension("o_orderdate", "week", True, "w"),), (Value(aggregation="count", alias="n"),))).df.select(F.col("w.start").alias("w"), "n")


@query("SELECT lower(w) AS words, count(*) AS n FROM (SELECT unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part) GROUP BY 1")
def query_multi_value_dim(spark, sf):
    return parts(spark, sf).query(Query(("words",), (Value(aggregation="count", alias="n"),))).df.withColumn("words", F.lower("words"))


@query("SELECT p_brand, count(DISTINCT w) AS d FROM (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS w FROM part) GROUP BY 1")
def query_distinct_per_group(spark, sf):
    return parts(spark, sf).query(Query(("p_brand",), (Value("words", "distinct", "d"),))).df


@query("SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 4) AS per_order FROM orders GROUP BY 1")
def query_calculated_per_group(spark, sf):
    return orders(spark, sf).query(Query(("o_orderstatus",), ("per_order",))).df.withColumn("per_order", F.round("per_order", 4))


@query(f"SELECT {BUCKET} AS bucket, count(*) AS n FROM orders GROUP BY 1")
def query_range_dim(spark, sf):
    return orders(spark, sf).query(Query((Dimension("o_totalprice", alias="bucket"),), (Value(aggregation="count", alias="n"),))).df.select(F.col("bucket.index").alias("bucket"), "n")


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice) DESC NULLS LAST, l_suppkey LIMIT 10")
def query_order_take(spark, sf):
    return items(spark, sf).query(Query(("l_suppkey",), ("revenue",), order_by=Order("revenue", True), take=10)).df.withColumn("revenue", F.round("revenue", 2))


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 AND (lower(l_linestatus) = 'o' OR lower(l_returnflag) LIKE 'r%') GROUP BY 1")
def query_where(spark, sf):
    d = items(spark, sf)
    where = parse("l_quantity>25,(l_linestatus=O|l_returnflag^R)", dict(d.df.dtypes))
    return d.query(Query(("l_returnflag",), (Value(aggregation="count", alias="n"),), where=where)).df


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def rows_top_n(spark, sf):
    return orders(spark, sf).query(Query(columns=("o_orderkey", "o_totalprice"), order_by=Order("o_totalprice", True), take=50)).df


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100")
def rows_default_order(spark, sf):
    return orders(spark, sf).query(Query(columns=("o_orderkey", "o_orderstatus"))).df


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def items_slice(spark, sf):
    return orders(spark, sf).rows(STATUS_F).offset(40).limit(20).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 20 AND l_quantity < 30")
def matching_rows(spark, sf):
    sel = Selections().with_("l_returnflag", "R").with_("l_quantity", RangeSelection((Interval(20.0, 30.0, False, True),)))
    return items(spark, sf).matching(sel).select("l_orderkey", "l_linenumber")
