"""Disclosing terms of the sanitiser: however many there are, and wherever they stand."""

import corpus_pipeline
from facetloom.llm import pii
from facetloom.llm.pii import Sanitiser, context, entities

SCHEMA = "doc_id long, text string"


def test_terms_do_not_depend_on_how_many_fit_a_broadcast(spark):
    rows = [(i, f"plain words number {i} stand here. Reach codename me{i}@x.org today") for i in range(60)] + [(99, None), (98, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = Sanitiser(gain_bits=1.0).fit(df)
    parted = Sanitiser(gain_bits=1.0, max_terms=2).fit(df)
    assert len(whole.terms) > 2 and {r.term: r.p for r in parted.table.collect()} == whole.terms
    of = lambda d: {r.doc_id: r[1] for r in d.collect()}
    assert of(parted.find(df)) == of(whole.find(df)) and of(parted.sanitised(df)) == of(whole.sanitised(df))


def test_disclosing_terms_are_found_without_an_entity(spark, tmp_path):
    filler = " ".join(["lorem"] * 40)
    rows = [(i, f"{filler} codename me{i}@x.org {filler}", "en", "s", 0) for i in range(60)]
    rows += [(60 + i, f"{filler} the codename stands alone", "en", "s", 0) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spans = {r.doc_id: r.spans for r in pii.op8_pii(spark, str(tmp_path)).collect()}
    at = rows[60][1].index("codename")
    assert spans[60] == f"term:{at}:{at + 8}" and spans[0].count("term:") == 1
    texts = {r.doc_id: r.text for r in corpus_pipeline.personal_data(spark, df, str(tmp_path)).collect()}
    assert "codename" not in texts[60] + texts[0]


def test_context_reaches_three_words_however_far(spark):
    far = "x" * 150
    text = f"one {far} {far}y z@x.org {far}a {far}b last out\nnext line"
    assert [w for w, _, _ in context(text, entities(text))] == ["one", far, far + "y", far + "a", far + "b", "last"]
