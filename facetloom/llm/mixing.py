"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

The token budget is handed down a tree of domain, language and source. A node divides what it got among its
children by their weights; a child can't take more than its tokens times ``max_epochs``, and what it can't take
goes to its siblings by their weights. Since a node is never given more than all its leaves hold, a shortage is
made up among siblings first and reaches the ancestors' siblings only as far as they can't. A leaf takes whole epochs, then a prefix of one more,
in the order of ``md5(seed:epoch:doc_id)``, as far as its tokens last.

The prefix is found digit by digit: of each leaf, sums over the next two hex digits of the key tell the bucket where the
budget ends, and only that bucket's rows are looked at again. After ``ROUNDS`` of it a bucket holds a 256 ** ROUNDS-th of
its leaf, and a running sum over its rows gives the last key. A leaf's cut is one key, so rows are chosen map-side without
moving a text, and no window holds more than 256 sums or that last bucket, however large a leaf is.

Defined results: null metadata counts as an empty string; null texts have no tokens and are chosen with the rows
before them in the order; rows with equal keys (repeated rows) are taken together; an empty table gives an empty
result; a weight of 0 (or less) gives a node nothing, unless all its siblings weigh nothing, when they share alike. Other
columns pass through ``choose``; its own columns are named ``mix_...`` where the table has one of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetloom.llm.common import Scratch, forget, stored, table, text_of
from facetloom.llm.quality_rules import n_words, words

LEVELS = ["domain", "language", "origin"]
DOMAINS = {"web": "012", "books": "345", "code": "67", "reference": "89"}  # by the last digit of the source's name
WEIGHTS = {"domain": {"web": 0.4, "books": 0.3, "code": 0.2, "reference": 0.1}, "language": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "origin": {}}
OTHER_WEIGHT = 0.05
SHARE, MAX_EPOCHS, SEED = 0.6, 2, "mix-1"
BROADCAST_LEAVES = 5_000
ROUNDS = 3


def default_levels() -> dict[str, Column]:
    source = F.coalesce(F.col("source"), F.lit(""))
    domain = F.lit("other")
    for name, digits in DOMAINS.items():
        domain = F.when(F.substring(source, -1, 1).isin(list(digits)), name).otherwise(domain)
    return {"domain": domain, "language": F.coalesce(F.col("lang"), F.lit("")), "origin": source}


class SourceMixer:
    def __init__(self, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED, levels: dict[str, Column] | None = None):
        self.weights, self.share, self.max_epochs, self.seed, self.levels = weights, share, max_epochs, seed, levels

    def _leveled(self, docs: DataFrame) -> DataFrame:
        levels = self.levels or default_levels()
        return docs.select("*", *[levels[n].alias(f"__{n}") for n in LEVELS])

    def _weight(self, level: str) -> Column:
        w = F.lit(float(OTHER_WEIGHT))
        for value, weight in self.weights.get(level, {}).items():
            w = F.when(F.col(level) == value, float(max(weight, 0))).otherwise(w)
        return w

    def budgets(self, leaves: DataFrame) -> DataFrame:
        """``leaves`` (levels, tokens) with the tokens each may give: ``budget`` (whole, at most tokens * max_epochs)."""
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
        given = leaves.sparkSession.createDataFrame([(float(int(self.share * total)),)], "given double")
        parents: list[str] = []
        for depth, level in enumerate(LEVELS):
            keys = LEVELS[: depth + 1]
            nodes = leaves.groupBy(*keys).agg((F.sum("tokens") * self.max_epochs).cast("double").alias("cap")).withColumn("w", self._weight(level))
            # nodes without weight get nothing: they can take nothing
            weighs = F.max("w").over(Window.partitionBy(*parents)) > 0
            nodes = nodes.withColumn("weighs", weighs).withColumn("cap", F.when(F.col("weighs") & (F.col("w") == 0), 0.0).otherwise(F.col("cap"))).withColumn("w", F.when(F.col("w") == 0, 1.0).otherwise(F.col("w")))
            nodes = nodes.join(given, parents) if parents else nodes.join(F.broadcast(given))
            order = Window.partitionBy(*parents).orderBy(F.col("cap") / F.col("w"), level)
            full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
            open_weight = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
            nodes = nodes.withColumn("rate", (F.col("given") - full) / open_weight)
            # the first child that needn't be filled up sets the rate for all after it
            rate = F.min(F.when(F.col("rate") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("o"), F.col(level).alias("l"), F.col("rate").alias("rate")))).over(Window.partitionBy(*parents))["rate"]
            given = nodes.withColumn("given", F.coalesce(F.least(F.col("cap"), rate * F.col("w")), F.col("cap"))).select(*keys, "given")
            parents = keys
        return leaves.join(given, LEVELS).withColumn("budget", F.floor(F.col("given") + 1e-6).cast("long")).drop("given")

    def _key(self, epoch: Column, id_column: str) -> Column:
        i = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
        return F.concat(F.md5(F.concat_ws(":", F.lit(self.seed), epoch.cast("string"), i).cast("binary")), F.lit(":"), i)

    def cuts(self, rows: DataFrame, id_column: str) -> DataFrame:
        """``rows``: levels, id and n_tokens. Per leaf: whole epochs, and the last key of one epoch more (null: none)."""
        leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
        plan = stored(self.budgets(leaves).withColumn("whole", F.when(F.col("tokens") == 0, 0).otherwise(F.floor(F.col("budget") / F.col("tokens")))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")))
        # (levels, begins, rest): the part of the keys where a leaf's budget ends, and what is left of it there
        edge = plan.select(*LEVELS, F.lit("").alias("begins"), "rest")
        keyed = rows.join(self._small(plan.select(*LEVELS, "whole")), LEVELS).select(*LEVELS, "n_tokens", self._key(F.col("whole"), id_column).alias("key"))
        order = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        for done in range(ROUNDS):
            inside = keyed.join(self._small(edge), LEVELS).where(F.col("key").startswith(F.col("begins")))
            sums = inside.groupBy(*LEVELS, "rest", F.substring("key", 1, 2 * done + 2).alias("bucket")).agg(F.sum("n_tokens").alias("n"))
            running = sums.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") > F.col("rest"))
            first = running.groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"))).alias("e"))
            before, edge = edge, stored(first.select(*LEVELS, F.col("e.bucket").alias("begins"), F.col("e.rest").alias("rest")))
            if done:
                forget(before)
        inside = keyed.join(self._small(edge), LEVELS).where(F.col("key").startswith(F.col("begins")))
        upto = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key"))
        last = inside.withColumn("upto", upto).where(F.col("upto") <= F.col("rest")).groupBy(*LEVELS).agg(F.max("key").alias("last"))
        found = plan.select(*LEVELS, F.col("whole").cast("int").alias("whole")).join(edge.select(*LEVELS, "begins"), LEVELS, "left").join(last, LEVELS, "left")
        # without an edge every row fits; without a row in the edge's bucket all buckets before it fit
        return found.select(*LEVELS, "whole", F.coalesce("last", "begins", F.lit("~")).alias("last"))

    def _small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_LEAVES else df

    def choose(self, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
        """The chosen rows of ``docs``, once per epoch, with the levels (domain, language, origin) and epoch (from 0)."""
        narrow = stored(self._leveled(docs).select(F.col(id_column).alias("id"), *[F.col(f"__{n}").alias(n) for n in LEVELS], n_words(words(text_of(text))).alias("n_tokens")))
        with Scratch(docs.sparkSession) as made:
            cuts = made.keep(stored(self.cuts(narrow, "id")))
        forget(narrow)
        taken = {c.lower() for c in docs.columns}
        own = {n: f"mix_{n}" if n in taken else n for n in [*LEVELS, "epoch"]}
        found = cuts.select(*[F.col(n).alias(f"__of_{n}") for n in LEVELS], F.col("whole").alias("__whole"), F.col("last").alias("__last"))
        joined = self._leveled(docs).join(self._small(found), [F.col(f"__{n}") == F.col(f"__of_{n}") for n in LEVELS])
        whole = F.col("__whole")
        partial = F.when(self._key(whole, id_column) <= F.col("__last"), whole + 1).otherwise(whole)
        chosen = joined.withColumn("__times", partial).where("__times > 0").withColumn("__epoch", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)))
        return chosen.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"__{n}").alias(own[n]) for n in LEVELS], F.col("__epoch").alias(own["epoch"]))


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    narrow = docs.select("doc_id", "lang", "source", "text")
    chosen = SourceMixer().choose(narrow)
    return chosen.select("doc_id", *LEVELS, "epoch", n_words(words(text_of("text"))).alias("n_tokens"))


def _sql() -> str:
    domain = "CASE " + " ".join(f"WHEN right(coalesce(source,''),1) IN ({','.join(repr(c) for c in d)}) THEN '{n}'" for n, d in DOMAINS.items()) + " ELSE 'other' END"
    weight = lambda level: "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}::DOUBLE" for v, w in WEIGHTS[level].items()) + f" ELSE {OTHER_WEIGHT}::DOUBLE END" if WEIGHTS[level] else f"{OTHER_WEIGHT}::DOUBLE"
    parts = [
        rf"d AS (SELECT doc_id, {domain} AS domain, coalesce(lang,'') AS language, coalesce(source,'') AS origin, len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents)",
        "leaf AS (SELECT domain, language, origin, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL)",
        f"g0 AS (SELECT floor({SHARE}::DOUBLE * sum(tokens)::DOUBLE)::DOUBLE AS given FROM leaf)",
    ]
    for depth, level in enumerate(LEVELS):
        keys, up = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        part = f"PARTITION BY {up}" if up else ""
        join = f"JOIN g{depth} USING ({up})" if up else "CROSS JOIN g0"
        parts += [
            f"n{depth} AS (SELECT c.*, given FROM (SELECT {keys}, (sum(tokens) * {MAX_EPOCHS})::DOUBLE AS cap, {weight(level)} AS w FROM leaf GROUP BY {keys}) c {join})",
            f"r{depth} AS (SELECT *, (given - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER ({part} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM n{depth})",
            f"m{depth} AS (SELECT *, min(CASE WHEN rate * w <= cap THEN {{'o': cap / w, 'l': {level}, 'rate': rate}} END) OVER ({part}) AS b FROM r{depth})",
            f"g{depth + 1} AS (SELECT {keys}, coalesce(least(cap, b.rate * w), cap) AS given FROM m{depth})",
        ]
    parts += [
        "p AS (SELECT leaf.*, floor(given + 1e-6)::BIGINT AS budget FROM leaf JOIN g3 USING (domain, language, origin))",
        "q AS (SELECT *, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS whole FROM p)",
        "k AS (SELECT d.*, whole, budget - whole * tokens AS rest, md5(concat_ws(':', '%s', whole::VARCHAR, coalesce(doc_id::VARCHAR,''))) || ':' || coalesce(doc_id::VARCHAR,'') AS key FROM d JOIN q USING (domain, language, origin))" % SEED,
        "s AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, origin ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM k)",
        "t AS (SELECT *, (whole + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::INT AS times FROM s)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, domain, language, origin, unnest(range(0, times))::INT AS epoch, n_tokens FROM t WHERE times > 0"


QUERIES = {"op4_source_mixing": op4_source_mixing}
ORACLES = {"op4_source_mixing": _sql()}
