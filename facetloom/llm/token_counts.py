"""Token counts by a map-side two-tier lookup.

The first tier is a compact table of the most frequent pre-tokens and their token counts, broadcast with at
most ``TABLE_WORDS`` entries. What it misses goes to a worker's own cache (bounded, kept between tasks), and
what that misses is encoded by the library. No pre-token is ever shuffled row by row: the table comes from
partial aggregation of a bounded sample of rows (``SAMPLE_ROWS``). The sample decides speed alone, since
every miss is encoded exactly.

Cutting a text at spaces is exact for a sentencepiece model in whose vocabulary no piece holds a space mark
after another character and whose normaliser makes each single space a mark (the first is checked for all pieces, the
second on ``PROBES``, when it is loaded; else whole texts are encoded): merges then never cross such a place. Runs of spaces and
literal space marks are encoded with the whole text.

Defined results: a null or empty text has 0 tokens and 0 bytes; repeated rows each get a row; other columns
are ignored; an empty table gives an empty result; the longest texts are counted whole.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetloom.llm.common import table, text_of, tidy

MARK = "▁"
PROBES = ["a b", "the end of it", "x, y. z!", "1 2 3", "The quick brown fox jumps over the lazy dog"]
SAMPLE_ROWS = 4_000
TABLE_WORDS = 30_000
CACHE_WORDS = 400_000
LIMIT = 4096


def load(path: str):
    """The library's own encoder at ``path`` (.model: sentencepiece, .json: tokenizers) as text list -> counts,
    and whether words may be counted one by one."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return (lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]), False
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    apart = not any(re.search(f"[^{MARK}]{MARK}", model.id_to_piece(i)) for i in range(model.get_piece_size()))
    # the normaliser must turn each single space into a mark, and set one before the first word, as before any other
    apart = apart and all("".join(model.encode(t, out_type=str)) == MARK + t.replace(" ", MARK) for t in PROBES)
    apart = apart and all(len(model.encode(t)) == sum(len(model.encode(w)) for w in t.split(" ")) for t in PROBES)
    return (lambda texts: [len(model.encode(t)) for t in texts]), apart


class _Counter(dict):
    """word -> number of tokens; encodes on a miss and starts afresh when full. None: not a word of its own."""

    def __init__(self, encode, table):
        super().__init__(table)
        self.encode, self.table = encode, table

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
            self.update(self.table)
        n = self[word] = None if not word or MARK in word else self.encode([word])[0]
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        try:
            return sum(map(self.__getitem__, text.split(" ")))
        except TypeError:  # a run of spaces, a space at an end, or a literal mark
            return self.encode([text])[0]


_WORKER: dict = {}


def _worker(path: str, key, shared) -> _Counter:
    if _WORKER.get("key") != key:
        encode, apart = load(path)
        _WORKER.update(key=key, counter=_Counter(encode, shared.value) if apart else None, encode=encode)
    return _WORKER


class TokenCounter:
    """Counts the tokens of whole texts as the library for the vocabulary file at ``path`` gives them."""

    def __init__(self, path: str, sample_rows: int = SAMPLE_ROWS, table_words: int = TABLE_WORDS):
        self.path, self.sample_rows, self.table_words, self.table = path, sample_rows, table_words, {}

    def fit(self, docs: DataFrame, text: str = "text") -> "TokenCounter":
        encode, apart = load(self.path)
        rows = docs.count()
        if apart and rows:
            sample = docs.select(text_of(text).alias("t")).sample(fraction=min(1.0, self.sample_rows / rows), seed=7)
            words = sample.select(F.explode(F.split("t", " ")).alias("w")).where((F.col("w") != "") & ~F.col("w").contains(MARK))
            top = [r[0] for r in words.groupBy("w").count().where("count > 1").orderBy(F.desc("count"), "w").limit(self.table_words).collect()]
            self.table = dict(zip(top, encode(top), strict=True)) if top else {}
        return self

    def count(self, docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
        """``id_column``, n_bytes, n_tokens of every row."""
        path, shared = self.path, docs.sparkSession.sparkContext.broadcast(self.table)
        key = (path, uuid.uuid4().hex)
        plain = docs.select(F.col(id_column).alias("id"), text_of(text).alias("t"))

        def run(batches):
            worker = _worker(path, key, shared)
            for batch in batches:
                texts = batch.column(1)
                counts = []
                for at in range(0, len(texts), 256):
                    part = texts.slice(at, 256).to_pylist()
                    counts += [worker["counter"].count(t) for t in part] if worker["counter"] is not None else worker["encode"](part)
                sizes = pa.compute.binary_length(texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0), sizes.cast(pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

        kind = docs.schema[id_column].dataType.simpleString()
        return plain.mapInArrow(tidy(run), f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_column)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counts = TokenCounter(public_tokenizers.path("piece_bpe_32k.model")).fit(docs).count(docs)
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLES = {}
