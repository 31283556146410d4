"""A dashboard that follows a stream of files."""

from facetloom.functions.selection import Selections
from facetloom.operators.dashboard import DashboardBuilder
from facetloom.streaming.refresh import Refreshed


def test_new_rows_mean_a_new_dashboard(spark, tmp_path):
    source = f"{tmp_path}/in"
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, s string").write.parquet(source)
    kept = Refreshed(spark, f"{tmp_path}/kept", lambda rows: DashboardBuilder(rows, "id").value("s").count("n"))
    stream = spark.readStream.schema("id long, s string").parquet(source)

    def run():
        q = kept.start(stream, f"{tmp_path}/checkpoint", availableNow=True)
        q.awaitTermination(120)
        assert q.exception() is None

    run()
    kept.select(Selections().with_("s", "a"))
    assert (kept.state().matching_count, kept.state().total_count) == (1, 2)
    spark.createDataFrame([(3, "A"), (4, "c")], "id long, s string").write.mode("append").parquet(source)
    run()
    assert (kept.state().matching_count, kept.state().total_count) == (2, 4)
    run()
    assert kept.state().total_count == 4
