"""From raw documents to packed training sequences: five stages, each a function of (spark, docs, sf_dir).

A stage works on all rows its predecessor kept; all but the last return the columns of ``documents``. ``run``
applies them in order and stores what each returns, so a lost executor repeats no finished stage; what a stage needed
on the way, and the table it read, are deleted then. Further columns of ``docs`` pass through the stages but the last.

Every stage takes an empty table and gives an empty one, and treats a null text as an empty one; what it does with
other nulls, repeated rows and ties its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from facetloom.llm.common import Scratch, forget, stored, table
from facetloom.llm.mixing import SourceMixer
from facetloom.llm.ngram_join import NgramJoin
from facetloom.llm.packing import Packer
from facetloom.llm.pii import Sanitiser
from facetloom.llm.quality_rules import RuleCascade

#: Near copies share at least NEAR_PERCENT of the NEAR_WIDTH-word shingles of both; the thin op3 query has bounds of its own.
NEAR_WIDTH, NEAR_PERCENT = 5, 80
#: Tokens to draw, as a share of what is left; with two epochs at most, the targets hold as far as sources last.
MIX_SHARE, MIX_EPOCHS = 1.0, 2


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, judged by their text alone: null and empty texts are too short. Repeated rows fare alike."""
    return RuleCascade().fit(docs).keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group stays: the one with the smallest id, null ids last, then the smallest hash of its text.

    Rows are told apart by id and text: rows that repeat both are one document, and one of them stays; an id that stands
    with several texts is several documents. Texts without words are linked with nothing and all stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    keyed = docs.withColumn("__key", key)
    classes = stored(NgramJoin(width=NEAR_WIDTH, percent=NEAR_PERCENT).classes(keyed.select("__key", "text"), id_column="__key", count=False).where("n_shingles > 0").select("__key", "component_id"))
    gone = classes.where("component_id <> __key").select("__key").distinct()
    kept = keyed.join(gone, "__key", "left_anti")
    again = classes.groupBy("__key").count().where("count > 1").select("__key")
    several = kept.join(again, "__key", "left_semi").dropDuplicates(["__key"])
    return kept.join(again, "__key", "left_anti").unionByName(several).select(*[F.col(f"`{c}`") for c in docs.columns])


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their personal data; n_chars follows, but for null texts, which stay null. Repeated rows stay and fare alike."""
    clean = Sanitiser(everywhere=True).fit(docs).sanitised(docs)
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.withColumn("n_chars", length)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for: left out, once, or in a second epoch again.

    A null language or source is one of its own; rows with one id and source are chosen together."""
    return SourceMixer(share=MIX_SHARE, max_epochs=MIX_EPOCHS).choose(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; each row's own, whatever its id."""
    import public_tokenizers

    return Packer(public_tokenizers.path("byte_bpe_50k.json")).pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with Scratch(spark) as made:
            before, docs = docs, made.keep(stored(stage(spark, docs, sf_dir)))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
