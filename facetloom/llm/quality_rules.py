"""Quality rules as a short-circuit cascade (DataFrame functions only).

``fit`` runs every rule on a sample of about ``SAMPLE_ROWS`` rows of the whole table. The sampled rows, each repeated until
there are ``TIMED_ROWS``, go through a rule in one task; the time of the same task without a rule is subtracted, and the
better of two runs counts. This cost in seconds a row and the share of rows that the rule rejects order the rules by
rejection per cost. ``rejects`` is then one conditional expression: a row meets the next rule only if those before let it
pass. The order decides cost alone; the verdict of a row is the same in any order.

Defined results: a null text counts as empty, has no words and is rejected by the word-count rule; a rule that
gives null does not reject; repeated rows each get a row; other columns pass through; an empty table gives an
empty result (and the rules in declared order). Very long texts are judged whole. Columns of a table that are named
like a count (``n_words`` ...) are hidden by ``counts`` and untouched by ``keep``.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import let, table, text_of

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS, TIMED_ROWS = 512, 2_048
COUNTS = ["n_words", "word_chars", "n_symbols", "n_exclamations", "n_dup_lines", "n_repeat_words"]


def words(text: Column) -> Column:
    """The words of a text, with an empty string at an end where white space stands there."""
    return F.split(text, SPACE)


def _n(ws: Column) -> Column:
    return F.greatest(F.size(ws) - (F.get(ws, F.lit(0)) == "").cast("int") - (F.element_at(ws, -1) == "").cast("int"), F.lit(0)).cast("long")


def n_words(ws: Column) -> Column:
    return let(ws, _n)


def word_chars(ws: Column) -> Column:
    return F.length(F.array_join(ws, "")).cast("long")


def marks(text: Column) -> Column:
    """The symbols and exclamation marks of a text."""
    return F.regexp_replace(text, f"[^{SYMBOLS}!]+", "")


def n_symbols(marks: Column) -> Column:
    return F.length(F.replace(marks, F.lit("!"), F.lit(""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))


def n_repeat_words(ws: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that stand twice or more in the text.

    Windows are compared by 64-bit hashes of their words; within a text of n words two different windows are
    taken for one with a probability below n * n / 2 ** 65. Only texts where hashes repeat sort them.
    """

    def union(p: Column) -> Column:  # p: starts of repeated windows, ascending
        steps = F.transform(p, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(p, k + 1) - x, F.lit(width))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(s: Column) -> Column:  # s: (hash, start), sorted
        def repeated(j: Column) -> Column:
            h = F.get(s, j)["h"]
            return F.coalesce(h == F.get(s, j - 1)["h"], F.lit(False)) | F.coalesce(h == F.get(s, j + 1)["h"], F.lit(False))

        return F.array_sort(F.filter(F.transform(s, lambda x, j: F.when(repeated(j), x["i"])), lambda i: i.isNotNull()))

    def of_hashes(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(let(pairs, twice), union))

    def windows(hw: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(hw) - width), lambda i: F.xxhash64(*[F.get(hw, i + k) for k in range(width)]))

    hashed = let(ws, lambda a: F.transform(F.slice(a, F.when(F.get(a, F.lit(0)) == "", 2).otherwise(1), _n(a).cast("int")), lambda w: F.xxhash64(w)))
    return let(hashed, lambda hw: F.when(F.size(hw) <= width, F.lit(0).cast("long")).otherwise(let(windows(hw), of_hashes)))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules read, as columns of their own (``COUNTS``)."""
    t = text_of(text)
    split = docs.withColumn("__words", words(t)).withColumn("__marks", marks(t))
    return split.select(
        *[c for c in docs.columns if c.lower() not in COUNTS],
        n_words(F.col("__words")).alias("n_words"),
        word_chars(F.col("__words")).alias("word_chars"),
        n_symbols(F.col("__marks")).alias("n_symbols"),
        (F.length("__marks") - n_symbols(F.col("__marks"))).alias("n_exclamations"),
        n_dup_lines(t).alias("n_dup_lines"),
        n_repeat_words(F.col("__words")).alias("n_repeat_words"),
    )


def rules(text: Column, ws: Column | None = None, **known: Column) -> dict[str, Column]:
    """Rule name -> condition that rejects; all judge the whole text. ``ws``: its words; ``known``: counts that stand in columns already."""
    ws = words(text) if ws is None else ws
    c = {"n_words": n_words(ws), "word_chars": word_chars(ws), "n_symbols": n_symbols(marks(text)), "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(ws)} | known
    exclamations = known.get("n_exclamations", F.length(F.regexp_replace(text, "[^!]+", "")))
    return {
        "too_few_words": c["n_words"] < 10,
        "symbols": c["n_symbols"] * 20 > c["word_chars"],
        "upper_case": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) * 2 > c["word_chars"],
        "exclamations": exclamations * 20 > c["word_chars"],
        "duplicate_lines": c["n_dup_lines"] * 10 > F.size(F.split(text, "\n")) * 3,
        "long_words": c["word_chars"] > 30 * c["n_words"],
        "repeated_windows": c["n_repeat_words"] * 100 > c["n_words"] * 20,
    }


class RuleCascade:
    """Rules in the order of rejection per cost. Without ``given``, those of this module, over one split of each text."""

    def __init__(self, given: dict[str, Column] | None = None, sample_rows: int = SAMPLE_ROWS):
        self.own, self.sample_rows = not given, sample_rows
        self.rules = dict(given or rules(text_of("text"), F.col("__words")))
        self.order, self.measured = list(self.rules), {}

    def fit(self, docs: DataFrame, prepare=lambda sample: sample) -> "RuleCascade":
        """``prepare`` adds the columns that the rules read to the sampled rows."""
        share = min(1.0, self.sample_rows / max(docs.count(), 1))
        # the sampled rows alone are shuffled to one task; the table is read by all
        sample = prepare(docs.sample(fraction=share, seed=11).repartition(1))
        sample = (sample.withColumn("__words", words(text_of("text"))) if self.own else sample).persist()
        try:
            n = sample.count()
            if not n:
                return self
            times = max(1, -(-TIMED_ROWS // n))
            repeated = sample.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(times))))

            def seconds(rule: Column) -> tuple[float, int]:
                took = []
                for _ in range(2):
                    began = time.monotonic()
                    rejected = repeated.agg(F.count_if(F.coalesce(rule, F.lit(False)))).first()[0]
                    took.append(time.monotonic() - began)
                return min(took), rejected // times

            seconds(F.col("__again") < 0)  # code is compiled and loaded
            idle = seconds(F.col("__again") < 0)[0]
            for name, rule in self.rules.items():
                took, rejected = seconds(rule)
                self.measured[name] = {"seconds": max(took - idle, 1e-4) / (n * times), "rows": n, "rejected": rejected}
        finally:
            sample.unpersist()
        worth = {k: (m["rejected"] + 0.5) / (n + 1) / m["seconds"] for k, m in self.measured.items()}
        self.order = sorted(self.rules, key=lambda k: -worth[k])
        return self

    def _cascade(self, by_name: dict[str, Column]) -> Column:
        cascade = F.lit(False)
        for name in reversed(self.order):
            cascade = F.when(F.coalesce(by_name[name], F.lit(False)), True).otherwise(cascade)
        return cascade

    def rejects(self) -> Column:
        if self.own:
            return let(words(text_of("text")), lambda ws: self._cascade(rules(text_of("text"), ws)))
        return self._cascade(self.rules)

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows that no rule rejects, with the columns of ``docs``."""
        return docs.where(~self.rejects())


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    cascade = RuleCascade(rules(text_of("text"), **{c: F.col(c) for c in [*base, "n_exclamations"]})).fit(docs, counts)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = counts(docs).withColumn("base_failed", failed)
    return judged.select("doc_id", *base, "base_failed", (~(F.col("base_failed") | cascade.rejects())).alias("kept"))


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 4), ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM rep) GROUP BY r),
ln AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, len(string_split(t, chr(10))) AS n_lines FROM d),
b AS (SELECT w.r, doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, n_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS uppers, length(regexp_replace(t, '[^!]+', '', 'g')) AS marks
  FROM w JOIN ln USING (r) LEFT JOIN cov USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 20 > word_chars OR uppers * 2 > word_chars OR marks * 20 > word_chars OR n_dup_lines * 10 > n_lines * 3 OR word_chars > 30 * n_words) AS kept
FROM f"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {"op6_quality_rules": _SQL}
