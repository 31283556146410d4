"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal them.

Protected entities are e-mail addresses, IP addresses, card numbers and phone numbers. Corpus co-occurrence
estimates how strongly a term reveals one, in two ways:

* beside: P(entity | term), the share of the term's occurrences that stand within ``WINDOW`` words of an entity of any
  kind on its line, and the information gain log2(P(entity | term) / P(entity)). Terms over both thresholds disclose.
* in documents (with ``everywhere``): with c a kind of entity, t a whole word outside entities, and probabilities the
  shares of all texts that hold them, PMI(c; t) = log2(P(c | t) / P(c)) is the information that t gives about c, and
  IC(c) = -log2 P(c) what there is to know. A term that gives at least ``SHARE`` of it, and ``GAIN_BITS``, discloses.
  So that copies of a text prove nothing, it must stand with ``MIN_SUPPORT`` different entities of the kind.

Disclosing terms are spans of kind ``term`` wherever they stand, with ``everywhere``, else beside an entity; ``sanitised``
generalises entities and such terms to their kind, and removes terms that reveal an entity almost surely.

All counts are exact and cover every text; a term with ``MIN_SUPPORT`` words beside entities, or texts with a kind, is a
candidate, whatever the size of the corpus. Where more than ``MAX_TERMS`` terms disclose, they are not broadcast but joined to
the texts' words.

Defined results: a null text counts as empty and has no spans (``sanitised`` keeps it null); repeated rows each
get a row; an empty table gives an empty result; other columns are ignored or pass through ``sanitised``; columns named
``__terms`` or ``__row`` are not allowed.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import stored, table, text_of, tidy

KINDS = ["email", "ip", "card", "phone"]
WINDOW, MIN_SUPPORT, MAX_TERMS, SALTS = 3, 20, 50_000, 16
LIKELY, SURE, GAIN_BITS, SHARE = 0.5, 0.9, 3.0, 0.5

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_WHOLE = re.compile(r"(?<!\w)[^\W\d_]{2,}(?!\w)")
_RUN = re.compile(r"\w+")
FEW_TERMS = 64
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str):
    end = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at:
            yield start, m.end()
            end = m.end()


def _ips(text: str):
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _cards(text: str):
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def entities(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; leftmost and non-overlapping within a kind."""
    found = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [("ip", *s) for s in _ips(text)]
        found += [("card", *s) for s in _cards(text)]
        if "+" in text:
            found += [("phone", *s) for s in _phones(text)]
    return found


def _outside(words, spans) -> list:
    """Those of ``words`` (matches) that overlap no span, in their order."""
    ends: list[int] = []
    starts: list[int] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [m for m in words if not (k := bisect_left(starts, m.end())) or ends[k - 1] <= m.start()]


def context(text: str, spans, window: int = WINDOW) -> list[tuple[str, int, int]]:
    """The words within ``window`` words of an entity on its line, outside all entities, each once."""
    lines: dict[int, tuple] = {}
    out = {}
    for _, a, b in spans:
        left = text.rfind("\n", 0, a) + 1
        if left not in lines:  # each line is cut into words once
            right = text.find("\n", b)
            words = list(_WORD.finditer(text, left, len(text) if right < 0 else right))
            lines[left] = words, [m.start() for m in words], [m.end() for m in words]
        words, starts, ends = lines[left]
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        out.update((m.start(), m) for m in words[max(0, before - window) : before] + words[after : after + window])
    return [(m.group().lower(), m.start(), m.end()) for m in _outside([out[k] for k in sorted(out)], spans)]


def cut(text: str) -> tuple[list[str], list[str]]:
    """The words that are runs of letters alone, and those that are parts of other runs, in lower case.

    The text is lower-cased at once where that is the same for each word."""
    lower = text.lower()
    if len(lower) != len(text) or "\u03a3" in text:
        whole = [m.group().lower() for m in re.finditer(r"(?<!\w)[^\W\d_]+(?!\w)", text)]
        parts = [p.lower() for w in _RUN.findall(text) if not w.isalpha() for p in _WORD.findall(w)]
        return whole, parts
    whole, parts = [], []
    for w in _RUN.findall(lower):
        if w.isalpha():
            whole.append(w)
        else:
            parts += _WORD.findall(w)
    return whole, parts


def may_hold(text: str, terms) -> bool:
    """False only if none of the terms stands in the text."""
    lower = text.lower()
    if len(lower) != len(text) or "\u03a3" in text:
        return True
    return any(t in lower for t in terms) if len(terms) <= FEW_TERMS else not terms.keys().isdisjoint(_WORD.findall(lower))


def whole_words(text: str, spans) -> set[str]:
    """The different words of letters alone that stand outside all spans."""
    return {m.group().lower() for m in _outside(_WHOLE.finditer(text), spans)}


def _count(docs: DataFrame, text: str, of) -> DataFrame:
    """Sums of ``of(text)``, a mapping of terms, over all rows; each task sends a term once per 200,000 terms."""

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if t:
                    of(t, seen)
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_pydict({"term": list(seen), "n": list(seen.values())})

    return docs.select(text_of(text)).mapInArrow(tidy(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Sanitiser:
    def __init__(self, window: int = WINDOW, min_support: int = MIN_SUPPORT, max_terms: int = MAX_TERMS, likely: float = LIKELY, sure: float = SURE, gain_bits: float = GAIN_BITS, share: float = SHARE, everywhere: bool = False):
        self.window, self.min_support, self.max_terms = window, min_support, max_terms
        self.likely, self.sure, self.gain_bits, self.share, self.everywhere = likely, sure, gain_bits, share, everywhere
        self.terms: dict[str, float] = {}
        self.table: DataFrame | None = None  # (term, p) instead of ``terms``, where those are more than max_terms

    def fit(self, docs: DataFrame, text: str = "text") -> "Sanitiser":
        """Count terms beside entities, in texts with entities, and everywhere; keep the disclosing ones."""
        window, in_texts = self.window, self.everywhere

        # keys: "term" beside an entity; "kind\\nterm" a text with both; "kind\\n" a text with the kind; "\\n" a text
        def with_entities(t, seen):
            seen["\n"] += 1
            spans = entities(t)
            if spans:
                seen.update(w for w, _, _ in context(t, spans, window))
                if in_texts:
                    words = whole_words(t, spans)
                    for kind in {k for k, _, _ in spans}:
                        seen[kind + "\n"] += 1
                        seen.update(f"{kind}\n{w}" for w in words)

        near = _count(docs, text, with_entities).persist()
        overall = None
        try:
            beside = near.where(~F.contains("term", F.lit("\n")))
            contexts = beside.agg(F.sum("n")).first()[0] or 0
            parts = F.split("term", "\n")
            whole = {r[0]: r[1] for r in near.where(F.col("term").endswith("\n")).collect()}  # a row a kind, and one for all
            candidates = beside.where(F.col("n") >= self.min_support).select("term", F.col("n").alias("near"))
            pairs = near.where(F.contains("term", F.lit("\n")) & ~F.col("term").endswith("\n") & (F.col("n") >= self.min_support)).select(parts[0].alias("kind"), parts[1].alias("term"), F.col("n").alias("both"))
            some = [r[0] for r in candidates.select("term").union(pairs.select("term")).distinct().limit(self.max_terms + 1).collect()]
            if not some:
                return self
            # a set of candidates that is small spares the others' counts the shuffle; else all terms are counted
            shared = docs.sparkSession.sparkContext.broadcast(frozenset(some) if len(some) <= self.max_terms else None)

            # keys: "term" every occurrence, "\\nterm" a text with it, "\\n" every word
            def everywhere(t, seen):
                whole, words = cut(t)
                seen["\n"] += len(words) + len(whole)
                asked = shared.value
                seen.update(words if asked is None else filter(asked.__contains__, words))
                seen.update(whole if asked is None else filter(asked.__contains__, whole))
                if in_texts:
                    seen.update("\n" + w for w in (set(whole) if asked is None else asked.intersection(whole)) if len(w) > 1)

            overall = _count(docs, text, everywhere).persist()
            base = contexts / overall.where(F.col("term") == "\n").first()[1]
            p = F.col("near") / F.greatest("n", "near")
            disclosing = candidates.join(overall, "term").select("term", p.alias("p")).where((F.col("p") >= self.likely) & (F.col("p") >= base * 2.0**self.gain_bits))
            if in_texts and len(whole) > 1:
                disclosing = disclosing.union(self._in_texts(docs, text, pairs, overall, whole)).groupBy("term").agg(F.max("p").alias("p"))
            found = disclosing.limit(self.max_terms + 1).collect()
            if len(found) <= self.max_terms:
                self.terms = {r[0]: r[1] for r in found}
            else:
                self.table = stored(disclosing)
        finally:
            near.unpersist()
            if overall is not None:
                overall.unpersist()
        return self

    def _in_texts(self, docs: DataFrame, text: str, pairs: DataFrame, overall: DataFrame, whole: dict[str, int]) -> DataFrame:
        """(term, p) of the terms that disclose a kind by the texts they stand in."""
        spark = docs.sparkSession
        total = whole.get("\n", 1)
        shares = spark.createDataFrame([(k[:-1], n / total) for k, n in whole.items() if k != "\n"], "kind string, base double")
        texts = overall.where(F.col("term").startswith("\n") & (F.col("term") != "\n")).select(F.substring("term", 2, 1 << 30).alias("term"), "n")
        p, gain = F.col("both") / F.greatest("n", "both"), F.log2(F.col("p") / F.col("base"))
        told = pairs.join(texts, "term").join(F.broadcast(shares), "kind").withColumn("p", p)
        told = told.where((gain >= self.gain_bits) & (gain >= -F.log2("base") * self.share)).select("kind", "term", "p")
        some = [(r[0], r[1]) for r in told.select("kind", "term").limit(self.max_terms + 1).collect()]
        if not some:
            return told.select("term", "p")
        shared = spark.sparkContext.broadcast(frozenset(some) if len(some) <= self.max_terms else None)

        def run(batches):
            asked = shared.value
            for batch in batches:
                rows = set()
                for t in batch.column(0).to_pylist():
                    spans = entities(t) if t else []
                    if spans:
                        words, least = whole_words(t, spans), {}
                        for kind, a, b in spans:  # a text counts by one of its entities of a kind
                            h = zlib.crc32(t[a:b].encode()) << 31 | zlib.adler32(t[a:b].encode()) >> 1
                            least[kind] = min(least.get(kind, h), h)
                        rows.update((kind, w, h) for kind, h in least.items() for w in words if asked is None or (kind, w) in asked)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["kind", "term", "h"])

        each = docs.select(text_of(text)).mapInArrow(tidy(run), "kind string, term string, h long").distinct()
        several = each.groupBy("kind", "term").agg(F.count(F.lit(1)).alias("entities")).where(F.col("entities") >= self.min_support)
        return told.join(several, ["kind", "term"]).groupBy("term").agg(F.max("p").alias("p"))

    def spans(self, text: str, terms: dict[str, float] | None = None) -> list[tuple[str, int, int]]:
        terms = self.terms if terms is None else terms
        found = entities(text)
        if terms and self.everywhere and may_hold(text, terms):
            named = [m for m in _WORD.finditer(text) if m.group().lower() in terms]
            found += [("term", m.start(), m.end()) for m in _outside(named, found)]
        elif found and terms:
            found += [("term", a, b) for w, a, b in context(text, found, self.window) if w in terms]
        return found

    def clean(self, text: str, terms: dict[str, float] | None = None) -> str:
        """Entities become [KIND]; disclosing terms [TERM], or nothing when they reveal an entity almost surely."""
        terms = self.terms if terms is None else terms
        spans, out, at = self.spans(text, terms), [], 0
        if not spans:
            return text
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if b <= at:
                continue
            out.append(text[at : max(a, at)])
            if a >= at:
                out.append("" if kind == "term" and terms[text[a:b].lower()] >= self.sure else f"[{kind.upper()}]")
            at = b
        return "".join(out) + text[at:]

    def __getstate__(self):
        return self.__dict__ | {"table": None}

    def _looked_up(self, docs: DataFrame, text: str) -> DataFrame:
        """``docs`` with ``__terms``, the disclosing terms among a text's words; null where ``terms`` holds them all."""
        kind = "array<struct<term:string,p:double>>"
        if self.table is None:
            return docs.withColumn("__terms", F.lit(None).cast(kind))
        rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()))

        def run(batches):
            for batch in batches:
                for row, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = sorted(set(map(str.lower, _WORD.findall(t))))
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(words), pa.int64()), pa.array(words, pa.string())], ["__row", "term"])

        words = rows.select("__row", text_of(text)).mapInArrow(tidy(run), "__row long, term string").withColumn("salt", F.pmod("__row", F.lit(SALTS)))
        salted = self.table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        held = words.join(salted, ["term", "salt"]).groupBy("__row").agg(F.collect_list(F.struct("term", "p")).cast(kind).alias("__terms"))
        return rows.join(held, "__row", "left").select(*docs.columns, F.coalesce("__terms", F.array().cast(kind)).alias("__terms"))

    def find(self, docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
        """``id_column`` and spans: array of (kind, start, end) in code points."""
        shared = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for batch in batches:
                rows = [[{"kind": k, "start": a, "end": b} for k, a, b in shared.value.spans(t, _terms(held))] if t else [] for t, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "spans"])

        kind = docs.schema[id_column].dataType.simpleString()
        plain = self._looked_up(docs.select(F.col(id_column).alias("id"), text_of(text).alias("t")), "t")
        return plain.mapInArrow(tidy(run), f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_column)

    def sanitised(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with the column ``text`` sanitised."""
        shared, place = docs.sparkSession.sparkContext.broadcast(self), docs.columns.index(text)

        def run(batches):
            for batch in batches:
                cleaned = [t and shared.value.clean(t, _terms(held)) for t, held in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
                kept = batch.select(range(batch.num_columns - 1))
                yield kept.set_column(place, kept.schema.field(place), pa.array(cleaned, kept.schema.field(place).type))

        return self._looked_up(docs, text).mapInArrow(tidy(run), docs.schema)


def _terms(held) -> dict[str, float] | None:
    return None if held is None else {r["term"]: r["p"] for r in held}


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = Sanitiser(everywhere=True).fit(docs).find(docs)
    listed = lambda kinds: F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(kinds)), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.aggregate("spans", F.lit(0).cast("long"), _adds(kind)).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(listed(KINDS).cast("binary"), 256).alias("base_sha256"),
        listed([*KINDS, "term"]).alias("spans"),
    )


def _adds(kind: str):
    return lambda n, s: n + (s["kind"] == kind).cast("long")


QUERIES = {"op8_pii": op8_pii}
ORACLES = {}
