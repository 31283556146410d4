"""What several operators of this subpackage share: input reading, scratch tables, numbering, zlib text hashing."""

from __future__ import annotations

import ctypes
import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Folders of the ``stored`` tables that no ``Scratch`` has taken over.
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark's own reader (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared one in ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/facetloom-{uuid.uuid4().hex}"


def stored(df: DataFrame, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the lineage ends there, and a lost
    executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    _MADE.append(path)
    df.write.parquet(path, partitionBy=list(partition_by) or None)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give back what a Python worker has freed: workers live on between tasks and share the executor's memory."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """``run`` over batches, and ``release`` when its task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _folder_of(df: DataFrame) -> set[str]:
    """The folders of ``stored`` tables that ``df`` reads, however deep."""
    return {f"facetloom-{f.partition('facetloom-')[2].partition('/')[0]}" for f in df.inputFiles() if "facetloom-" in f}


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that no later step reads."""
    for df in tables:
        for name in _folder_of(df):
            for path in [p for p in _MADE if p.endswith(name)]:
                _delete(df.sparkSession, path)
                _MADE.remove(path)


class Scratch:
    """Deletes, at its end, the tables that were ``stored`` inside it, but for those that what was kept still reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept |= _folder_of(df)
        return df

    def __enter__(self):
        self.first = len(_MADE)
        return self

    def __exit__(self, *failure):
        for path in _MADE[self.first :]:
            if failure[0] is None and not path.endswith(tuple(self.kept or "\0")):
                _delete(self.spark, path)
                _MADE.remove(path)


def hot_keys(many: DataFrame, key: str, rows_per_task: int = 2_000, most_keys: int = 1_000) -> DataFrame | None:
    """(key, __parts): the keys with more than ``rows_per_task`` rows of ``many``, and than a ``most_keys``-th of all such
    rows, and to how many tasks they are to be dealt. There are at most ``most_keys``, so that the list can be broadcast."""
    counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_per_task)
    total = counts.agg(F.sum("__n")).first()[0]
    if not total:
        return None
    limit = max(rows_per_task, total // most_keys)
    return F.broadcast(counts.where(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")))


def spread_join(many: DataFrame, one: DataFrame, key: str, hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """Join (inner or left) of ``many`` with ``one`` (few rows per ``key``), where the keys of ``hot`` hold most rows of ``many``.

    Rows of hot keys are dealt to several tasks by a hash of the columns ``by``, and the rows of ``one`` are repeated for each.
    """
    if hot is None:
        return many.join(one, key, how)
    parts = F.coalesce("__parts", F.lit(1))
    salted = many.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("__parts")
    repeated = one.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return salted.join(repeated, [key, "__salt"], how).drop("__salt")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, although a lambda inside ``body`` refers to it many times."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the faster way."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_of(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def numbered(df: DataFrame, key: str, order: list[str], name: str, rows_per_task: int = 20_000) -> DataFrame:
    """``df`` with a gapless number from 0 per ``key``, without all rows of a key in one task.

    Rows are dealt to ``hash(order) mod n`` buckets; each bucket is numbered on its own and begins where
    the buckets before it (counted, then summed per key) end. n follows the number of rows.
    """
    n = max(1, df.count() // rows_per_task)
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    counts = dealt.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("__key"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order)) - 1
    return (
        dealt.withColumn("__in", inside)
        .join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bucket") == F.col("__b")))
        .withColumn(name, (F.col("__start") + F.col("__in")).cast("long"))
        .drop("__bucket", "__in", "__key", "__b", "__start")
    )
