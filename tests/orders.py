"""The eight orders of the golden cases, with nulls in every nullable column, and their dashboard."""

from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from facetloom.operators.dashboard import DashboardBuilder

NOW = datetime(2026, 3, 15, 10, 0, tzinfo=timezone.utc)
SCHEMA = "Id int, Country string, Status string, IsActive boolean, Verified boolean, Amount double, Discount double, Quantity int, OrderDate timestamp_ntz, Due date, Tags array<string>"
ROWS = [
    (1, "SE", "Open", True, True, 100.0, 10.0, 2, datetime(2026, 1, 15, 10), date(2026, 1, 20), ["urgent", "gift"]),
    (2, "NO", "Open", True, None, 250.0, None, None, datetime(2026, 2, 3, 9, 30), date(2026, 2, 10), ["gift"]),
    (3, None, "Closed", False, False, 500.0, 50.0, 1, datetime(2026, 2, 20, 16), date(2026, 2, 28), None),
    (4, "SE", "Closed", True, True, 999.5, 0.0, 5, datetime(2026, 3, 1, 23, 30), date(2026, 3, 5), ["Urgent", "urgent", "b2b"]),
    (5, "DK", "Pending", False, None, 1000.0, None, 3, datetime(2026, 3, 10, 12), date(2026, 3, 15), []),
    (6, "se", "Open", True, False, 2500.0, 250.0, None, datetime(2026, 3, 31, 22, 30), date(2026, 4, 5), ["b2b"]),
    (7, None, "Pending", False, True, 0.0, None, 0, datetime(2026, 4, 2, 8), date(2026, 4, 9), [None]),
    (8, "NO", "Open", True, True, 75.0, 5.0, 2, datetime(2026, 4, 15, 14), date(2026, 4, 20), ["gift", "b2b"]),
]


def orders(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def builder(spark, **country):
    region = F.when(F.lower("Country").isin("se", "no"), "North").when(F.col("Country") == "DK", "South")
    return (
        DashboardBuilder(orders(spark), "Id")
        .value("Country", group=region, label=F.concat(F.lit("Land "), "Country"), **country)
        .value("Status")
        .boolean("IsActive")
        .multi("Tags")
        .range("Amount", cuts=[100, 500, 1000])
        .date("OrderDate", unit="month", zone="Europe/Stockholm", presets=("thisMonth", "lastMonth"))
        .text("Find", lambda t: F.contains(F.lower("Status"), F.lower(F.lit(t))))
        .count("Orders")
        .metric("sum", "Amount", "Revenue")
        .metric("average", "Discount", "AvgDiscount")
        .metric("distinct", "Country", "Countries")
        .calculated("PerOrder", lambda v, s: v("Revenue") / v("Orders"), uses=("Revenue", "Orders"))
        .now(lambda: NOW)
    )
