"""Licence scans: an exact set-similarity join of text blocks with licence templates (DataFrame functions only).

Blocks are windows of consecutive words, wherever lines end: for a template of at most w = 2 ** k words (at least ``LEAST``),
those of 2 w words that begin at every multiple of w, so that a passage of w words lies in one of them. A template
matches a block that holds at least ``threshold`` of the template's distinct words (containment). The join is a
broadcast join of an inverted index (word -> templates) with the words of blocks. Its candidates pass three exact filters:

* prefix: with words ordered by their frequency in the whole corpus, rarest first, a matching block shares one of the
  first ``|t| - need + 1`` words of the template, ``need = ceil(threshold * |t|)``; the index holds these words alone;
* length: a matching block has at least ``need`` words of the vocabulary of all templates;
* position: from a shared word at place i of the template and j of the block's words, both in corpus order, of which none
  before is shared, no more than ``min(|t| - i, |b| - j)`` words can be shared, which must reach ``need``.

The templates are a parameter of at most ``MAX_TEMPLATE_WORDS`` words, so the index and the vocabulary may be broadcast.
A text without a prefix word of any template is not cut into blocks; blocks without one are dropped. Beside the join,
fixed phrases are looked up in the whole text.

Defined results: a null or empty text has no words, no places and score 0; repeated rows each get a row;
extra columns are ignored; an empty table gives an empty result; without templates there are phrases alone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import let, lower_ascii, table, text_of
from facetloom.llm.license_texts import TEXTS as TEMPLATES

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
THRESHOLD, LEAST = 0.8, 8
MAX_TEMPLATE_WORDS = 200_000
INDEX = "size int, word string, place int, n int, need int, template int, label string, words array<string>"


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(65, 91)})


def _strings(words) -> Column:
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def _norm(text: Column) -> Column:
    """A text's words joined by single spaces."""
    return F.trim(F.regexp_replace(lower_ascii(text_of(text)), SEPARATORS, " "))


class LicenseScanner:
    """``fit`` orders the template words by corpus frequency; ``matches`` lists the joined blocks, ``scan`` sums up per row."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD):
        self.phrases, self.threshold, self.templates, self.sizes = dict(phrases), threshold, [], []
        for label, text in templates:
            words = re.findall(WORDS, _lower(text))
            self.templates.append((label, list(dict.fromkeys(words))))
            self.sizes.append(max(LEAST, 1 << max(0, len(words) - 1).bit_length()))
        if sum(len(ws) for _, ws in self.templates) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words in total")
        self.rank = {w: i for i, w in enumerate(sorted({w for _, ws in self.templates for w in ws}))}

    def need(self, words) -> int:
        return max(1, math.ceil(self.threshold * len(words) - 1e-9))

    def fit(self, docs: DataFrame, text: str = "text") -> "LicenseScanner":
        """Count in how many rows of the corpus each template word stands (each task sends a word once)."""
        found = F.array_intersect(F.split(_norm(F.col(text)), " "), _strings(sorted(self.rank)))
        counts = {r[0]: r[1] for r in docs.select(F.explode(found).alias("w")).groupBy("w").count().collect()}  # the templates' words
        self.rank = {w: i for i, w in enumerate(sorted(self.rank, key=lambda w: (counts.get(w, 0), w)))}
        return self

    def index(self) -> list[tuple]:
        """Rows of ``INDEX``: the prefix words of each template, with their place in corpus order."""
        out = []
        for i, ((label, words), size) in enumerate(zip(self.templates, self.sizes)):
            ordered, need = sorted(words, key=self.rank.get), self.need(words)
            out += [(size, w, place, len(words), need, i, label, ordered) for place, w in enumerate(ordered[: len(words) - need + 1])]
        return out

    def blocks(self, docs: DataFrame, keys: list[str], norm: str) -> DataFrame:
        """``keys``, start, size, held: the blocks with a prefix word, and their vocabulary words in corpus order."""
        index, ordered = self.index(), _strings(sorted(self.rank, key=self.rank.get))
        sizes = sorted(set(self.sizes))
        fewest = {size: min(self.need(ws) for (_, ws), s in zip(self.templates, self.sizes) if s == size) for size in sizes}
        prefixes = {size: _strings(sorted({r[1] for r in index if r[0] == size})) for size in sizes}

        def windows(words: Column, size: int) -> Column:
            last = F.greatest(F.ceil(F.size(words) / F.lit(size)) - 2, F.lit(0)).cast("int")
            cut = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * size).alias("start"), F.lit(size).alias("size"), F.slice(words, k * size + 1, 2 * size).alias("words")))
            return F.when(F.arrays_overlap(words, prefixes[size]), F.filter(cut, lambda b: F.arrays_overlap(b["words"], prefixes[size]))).otherwise(F.filter(cut, lambda b: F.lit(False)))

        gate = F.col(norm).isNotNull() & F.arrays_overlap(F.split(norm, " "), _strings(sorted({r[1] for r in index})))
        cut = let(F.split(norm, " "), lambda words: F.flatten(F.array(*[windows(words, size) for size in sizes])))
        each = docs.where(gate).select(*keys, F.explode(cut).alias("b"))
        held = F.array_intersect(ordered, F.col("b.words"))
        least = F.coalesce(*[F.when(F.col("size") == s, F.lit(n)) for s, n in fewest.items()])
        return each.select(*keys, "b.start", "b.size", held.alias("held")).where(F.size("held") >= least)

    def matches(self, docs: DataFrame, keys: list[str], norm: str) -> DataFrame:
        """``keys``, start, size, template, label, shared, containment of every block and template over the threshold."""
        index = F.broadcast(docs.sparkSession.createDataFrame(self.index(), INDEX))  # at most MAX_TEMPLATE_WORDS rows
        words = self.blocks(docs, keys, norm).select(*keys, "start", "size", "held", F.posexplode("held").alias("at", "word"))
        joined = words.join(index, ["size", "word"])
        possible = F.least(F.col("n") - F.col("place"), F.size("held") - F.col("at")) >= F.col("need")
        first = ~F.arrays_overlap(F.slice("words", F.lit(1), F.col("place")), F.col("held"))  # each block meets a template at its rarest shared word
        shared = joined.where((F.size("held") >= F.col("need")) & possible).where(first).withColumn("shared", F.size(F.array_intersect("words", "held")))
        return shared.where(F.col("shared") >= F.col("need")).select(*keys, "start", "size", "template", "label", "shared", (F.col("shared") / F.col("n")).alias("containment"))

    def scan(self, docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
        """Per row: word count, places of the phrases, labels of phrases and of matching blocks, best containment.

        Matches are found per id and text and joined back to the rows' figures, which are small; texts are not shuffled.
        """
        row = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("h"), F.octet_length(text_of(text)).alias("bytes"), _norm(F.col(text)).alias("norm")).withColumn("words", F.split("norm", " "))
        padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))

        def places(phrase: str) -> Column:
            size = len(phrase.split())
            return F.when(padded.contains(f" {phrase} "), let(F.col("words"), lambda ws: F.filter(
                F.transform(F.filter(F.sequence(F.lit(1), F.size(ws)), lambda p: F.element_at(ws, p.cast("int")) == phrase.split()[0]),
                            lambda p: F.when(F.slice(ws, p.cast("int"), size) == _strings(phrase.split()), p.cast("long") - 1)),
                lambda p: p.isNotNull()))).otherwise(F.array().cast("array<bigint>"))

        every = F.flatten(F.array(*[places(p) for p in self.phrases])) if self.phrases else F.array().cast("array<bigint>")
        standing = F.array(*[F.when(padded.contains(f" {p} "), F.lit(label)) for p, label in self.phrases.items()]) if self.phrases else F.array().cast("array<string>")
        base = F.array_sort(F.array_distinct(F.filter(standing, lambda x: x.isNotNull())))
        figures = row.select("id", "h", "bytes", F.when(F.col("norm") == "", 0).otherwise(F.size("words")).cast("long").alias("n_words"), every.alias("places"), base.alias("base"))
        none = F.array().cast("array<string>")
        if self.templates:
            key = ["id", "h", "bytes"]
            found = self.matches(row, key, "norm").groupBy(*key).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
            found = found.select(F.col("id").alias("id2"), F.col("h").alias("h2"), F.col("bytes").alias("b2"), "more", "best")
            same = F.col("id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2")) & (F.col("bytes") == F.col("b2"))
            figures = figures.join(found, same, "left")
        else:
            figures = figures.withColumn("more", none).withColumn("best", F.lit(0.0))
        return figures.select(
            F.col("id").alias(id_column),
            "n_words",
            F.size("places").cast("long").alias("n_base"),
            F.array_min("places").alias("first_word"),
            F.array_max("places").alias("last_word"),
            F.array_join("base", ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
            F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        )


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return LicenseScanner().fit(docs).scan(docs)


def _sql() -> str:
    scanner = LicenseScanner()
    quoted = lambda ws: "[" + ",".join(f"'{w}'" for w in ws) + "]"
    templates = ",".join(f"({i},'{label}',{quoted(ws)},{scanner.need(ws)},{size})" for i, ((label, ws), size) in enumerate(zip(scanner.templates, scanner.sizes)))
    phrases = ",".join(f"('{label}',{quoted(p.split())})" for p, label in PHRASES.items())
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w FROM documents),
    tp(i, label, ws, need, size) AS (VALUES {templates}), ph(label, ws) AS (VALUES {phrases}),
    tw AS (SELECT i, label, len(ws) AS n, need, size, unnest(ws) AS word FROM tp),
    k AS (SELECT r, unnest(w) AS word, unnest(range(0, len(w))) AS pos FROM d),
    p AS (SELECT r, label, pos FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i, i - 1 AS pos FROM d), ph WHERE w[i] = ws[1] AND list_slice(w, i, i + len(ws) - 1) = ws),
    hit AS (SELECT r, i, label, n, need, word, pos // size AS b FROM k JOIN tw USING (word)),
    m AS (SELECT r, label, n, need, count(DISTINCT word) AS shared FROM (SELECT * FROM hit UNION ALL SELECT * REPLACE (b - 1 AS b) FROM hit WHERE b > 0) GROUP BY r, i, label, n, need, b),
    x AS (SELECT r, label, max(shared / n::DOUBLE) AS c FROM m WHERE shared >= need GROUP BY r, label),
    pa AS (SELECT r, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list_sort(list(DISTINCT label)) AS ls FROM p GROUP BY r),
    la AS (SELECT r, list_sort(list(DISTINCT label)) AS ls, max(c) AS c FROM (SELECT r, label, c FROM x UNION ALL SELECT r, label, 1.0 FROM p) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(pa.n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
      coalesce(array_to_string(pa.ls, ','), '') AS base_labels, coalesce(array_to_string(la.ls, ','), '') AS labels, coalesce(la.c, 0.0)::DOUBLE AS score
    FROM d LEFT JOIN pa USING (r) LEFT JOIN la USING (r)"""


QUERIES = {"op1_license_scan": op1_license_scan}
ORACLES = {"op1_license_scan": _sql()}
