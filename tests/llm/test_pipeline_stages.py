"""Each stage on nulls, empty and very long texts, repeated rows, clashing columns and empty tables; and all of them in order."""

import itertools
import re
from collections import Counter

import pytest

import corpus_pipeline
from facetloom.llm import common
from facetloom.llm.pii import entities
from tests.llm.test_operators import documents, truth

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, language string, domain string, origin string, epoch int, whole int, last string, n_words int, term string, n long, id long, part int, shard int"
EXTRA = ("x", "y", "z", 7, 8, "w", 9, "t", 1, 2, 3, 4)


def given():
    own = [(i, f"{t} mail a{i}@x.org" if i % 7 == 0 else t, *rest) for i, t, *rest in documents()[:113]]
    own += [(500, own[3][1], "en", "src1", 5), (500, own[4][1] + " and more", "en", "src1", 5), (500, own[4][1] + " and more", "en", "src1", 5)]
    own += [(None, "one null id " * 3 + own[9][1], "en", "src1", 5), (None, "one null id " * 3 + own[9][1], None, "src1", None)]
    own += [(None, None, None, None, None), (1001, "", "en", "src1", 0), (1001, "", "en", "src1", 0), (1004, "word " * 30_000, "en", "src0", 150_000)]
    return own


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *EXTRA) for r in given()], SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_clashing_columns(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, "")
    assert name == "packing" or out.columns == docs.columns
    assert out.count() > 0 and stage(spark, docs.where("false"), "").count() == 0


def test_near_duplicates_tell_rows_apart_by_id_and_text(spark, docs):
    rows = [r[:5] for r in given()]
    keys = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    roots = truth([(i, k[2]) for i, k in enumerate(keys)], 5, 80)
    want = Counter()
    for i, k in enumerate(keys):
        if not re.search(r"\S", k[2]):
            want[k] = sum((r[0] is None, r[0] or 0, r[1] or "") == k for r in rows)  # without words: all stay
    classes = {}
    for i, (n, root) in roots.items():
        if n:
            classes.setdefault(root, []).append(keys[i])
    got = Counter((r.doc_id is None, r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    for members in classes.values():
        assert sum(got[m] for m in members) == 1  # one row of each class,
        kept = next(m for m in members if got[m])
        assert kept[:2] == min(m[:2] for m in members)  # of the smallest id
    assert {k: n for k, n in got.items() if not re.search(r"\S", k[2])} == want


def test_quality_and_personal_data_leave_clean_rows_alone(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "").collect()}
    assert {0, 1, 2, 60} <= kept and not {1001, 1004} & kept
    before = Counter((r[0], r[1]) for r in given())
    after = corpus_pipeline.personal_data(spark, docs, "").collect()
    assert len(after) == sum(before.values()) and not any(entities(r.text) for r in after if r.text)
    clean = Counter((r.doc_id, r.text) for r in after if (r.doc_id, r.text) in before)
    assert clean == Counter({k: n for k, n in before.items() if not entities(k[1] or "")})
    assert all(r.n_chars == len(r.text) for r in after if r.text is not None)


def test_run_keeps_only_what_its_result_reads(spark, tmp_path):
    spark.createDataFrame([r[:5] for r in given()], ", ".join(SCHEMA.split(", ")[:5])).write.parquet(f"{tmp_path}/documents.parquet")
    already = len(common._MADE)
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert len(common._MADE) - already <= 2
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 1024
    # stage by stage, each on what the one before returned, gives the same documents
    docs = common.table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs = common.stored(docs)
    piece = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(piece, docs.collect())) == Counter(map(piece, rows))
