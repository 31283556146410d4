"""The registered queries: their columns and what the contract says of them, against plain Python; and the corner cases of each operator."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from facetloom.llm import registry
from facetloom.llm.license_scan import LicenseScanner
from facetloom.llm.mixing import SourceMixer
from facetloom.llm.packing import Packer
from facetloom.llm.pii import KINDS, Sanitiser, context, entities
from facetloom.llm.quality_rules import RuleCascade, counts, rules
from facetloom.llm.toxicity import NoisyOr, ToxicityModel, lowered
from tests.llm.test_operators import documents

COLUMNS = {
    "op1_license_scan": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op2_kd_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op3_ngram_jaccard": "doc_id bigint, n_shingles bigint, component_id bigint, n_links bigint",
    "op5_toxicity": "doc_id bigint, held_out boolean, score double, predicted int, n_offending int, offending_starts array<bigint>",
    "op6_quality_rules": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op7_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_pii": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op10_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
}


def private():
    rng = random.Random(8)
    out = []
    for i in range(60):
        out.append((2000 + i, f"word{i % 7} text here. mail u{i}.x+y@host-{i}.example.org or {rng.randrange(300)}.{rng.randrange(300)}.1.{i}.9 and +49 (30) {rng.randrange(10**7):07d} 4111-1111 1111 1111 7 secretly", "en", "s", 0))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("contract"))
    rows = documents() + private()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0), int(i % 9 == 0)) for i in range(110)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def found(spark, folder):
    return {n: registry.QUERIES[n](spark, folder).collect() for n in COLUMNS if n != "op2_kd_sharding"}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, folder, name):
    assert registry.QUERIES[name](spark, folder).dtypes == [tuple(c.split(" ", 1)) for c in COLUMNS[name].split(", ")]


def test_every_document_once(found):
    ids = Counter(r[0] for r in documents() + private())
    for name, rows in found.items():
        assert Counter(r.doc_id for r in rows if name != "op7_best_fit_packing" or r.piece == 0) == ids


def brute_entities(text):
    """The contract's patterns as they stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]


def brute_terms(texts):
    """The disclosing terms of both kinds of co-occurrence, by plain counts."""
    beside, everywhere, have, both, standing, values = Counter(), Counter(), Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        spans = brute_entities(t)
        everywhere.update(w.lower() for w in re.findall(r"[^\W\d_]+", t))
        beside.update(w for w, _, _ in context(t, spans))
        inside = lambda m: any(a < m.end() and m.start() < b for _, a, b in spans)
        standing.update({w.lower() for w in re.findall(r"(?<!\w)[^\W\d_]{2,}(?!\w)", t)})
        kinds = {k for k, _, _ in spans}
        have.update(kinds)
        words = {m.group().lower() for m in re.finditer(r"(?<!\w)[^\W\d_]{2,}(?!\w)", t) if not inside(m)}
        for k in kinds:
            one = min((zlib.crc32(t[a:b].encode()) << 31 | zlib.adler32(t[a:b].encode()) >> 1) for kk, a, b in spans if kk == k)
            for w in words:
                both[k, w] += 1
                values[k, w].add(one)
    base, out = sum(beside.values()) / max(sum(everywhere.values()), 1), set()
    out |= {w for w, n in beside.items() if n >= 20 and n / everywhere[w] >= max(0.5, 8 * base)}
    for (k, w), n in both.items():
        share = have[k] / len(texts)
        gain = math.log2(n / standing[w] / share)
        if n >= 20 and len(values[k, w]) >= 20 and gain >= 3 and gain >= -math.log2(share) * 0.5:
            out.add(w)
    return out


def planted(seed, filler):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(120)]
    out = []
    for i in range(900):
        t = [rng.choice(words) for _ in range(rng.randint(3, filler))]
        if i % 30 == 0:  # the term stands in texts with an address, far from it, and in a few others
            t = ["Patient", *t, *[rng.choice(words) for _ in range(8)], f"p{i}@x.org"]
        elif i % 300 == 1:
            t.insert(0, "patient")
        elif i % 3 == 2:
            t += ["copied", *[rng.choice(words) for _ in range(8)], "same@copy.org"] if i % 9 == 2 and i < 300 else []
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("filler", [12, 60])
def test_terms_that_tell_a_kind_by_the_texts_they_stand_in(spark, filler):
    texts = planted(3, filler)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4)
    for most in (50_000, 1):
        s = Sanitiser(everywhere=True, max_terms=most).fit(df)
        terms = set(s.terms) or {r.term for r in s.table.collect()}
        assert terms == brute_terms(texts) and "patient" in terms and "copied" not in terms


def test_pii_spans(found):
    texts = {r[0]: r[1] or "" for r in documents() + private()}
    terms = brute_terms([r[1] for r in documents() + private() if r[1]])
    for r in found["op8_pii"]:
        t = texts[r.doc_id]
        base = brute_entities(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in KINDS)
        more = [("term", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t) if m.group().lower() in terms and not any(a < m.end() and m.start() < b for _, a, b in base)]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base + more)


def test_patterns_on_random_strings():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("ab@@..--+ 0123456789%_()é\n") for _ in range(rng.randint(1, 40)))
        assert entities(t) == brute_entities(t), t


def test_licences_across_lines_and_only_ascii_lower_case(spark):
    notice = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and\nassociated documentation files"
    texts = [notice, "x " * 500 + notice + " y" * 500, "Redistribution and use in source and binary forms, with or without\nmodification, are permitted", "permission is granted free of copy", "RELEASED UNDER THE MİT LICENSE", "word " * 40 + "all rights\nreserved", None, ""]
    df = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in enumerate(texts)], "doc_id int, text string, start int, size int, held string")
    got = {r.doc_id: (r.labels, r.n_base) for r in LicenseScanner().fit(df).scan(df).collect()}
    assert got == {0: ("mit", 0), 1: ("mit", 0), 2: ("bsd", 0), 3: ("", 0), 4: ("mit", 0), 5: ("proprietary", 0), 6: ("", 0), 7: ("", 0)}


def test_many_templates(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    templates = [(f"t{i}", " ".join(rng.sample(words, rng.randint(3, 30)))) for i in range(1000)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(20)) + "\n" + templates[i * 7][1].replace(" ", "\n", 1) + " " + rng.choice(words)) for i in range(100)]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    scanner = LicenseScanner(templates, {}).fit(df)
    began = time.monotonic()
    out = scanner.scan(df)
    out._jdf.queryExecution().executedPlan()
    assert time.monotonic() - began < 20
    labels = {r.doc_id: set(r.labels.split(",")) for r in out.collect()}
    assert all(f"t{i * 7}" in labels[i] for i in range(100)) and sum(map(len, labels.values())) < 300


def test_weights_of_zero(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 100), ("books", "en", "b", 100), ("books", "de", "c", 100)], "domain string, language string, origin string, tokens long")
    shares = lambda weights: {r.origin: r.budget for r in SourceMixer(weights=weights, share=0.5, max_epochs=2).budgets(leaves).collect()}
    assert shares({"domain": {"web": 0, "books": 1.0}, "language": {"de": 0, "en": 1.0}, "origin": {}}) == {"a": 0, "b": 150, "c": 0}
    assert shares({"domain": {"web": 0, "books": 0}, "language": {"en": 1.0, "de": 1.0}, "origin": {}}) == {"a": 75, "b": 37, "c": 37}


def test_mixing_beside_columns_of_the_same_name(spark):
    df = spark.createDataFrame([(i, f"some words {i}", "en", f"s{i % 3}", "L", "D", "O", 9, 8, "x") for i in range(90)], "doc_id int, text string, lang string, source string, language string, domain string, origin string, epoch int, whole int, last string")
    out = SourceMixer(share=1.0).choose(df)
    assert out.columns == [*df.columns, "mix_domain", "mix_language", "mix_origin", "mix_epoch"] and {r.language for r in out.collect()} == {"L"}


def test_lower_case_keeps_places(spark):
    assert lowered("İ you are VILE") == "İ you are vile" and lowered("ABC É") == "abc é"
    model = NoisyOr({"vile": 12.0}, -6.0)
    assert abs(model.score("you are VILE")[0] - model.score("İ you are VILE")[0]) < 1e-9
    docs = spark.createDataFrame([(i, ("you are vile " if i % 2 else "all is well ") * 20) for i in range(200)] + [(1000, "vile " * 100_000), (1001, "")], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1000, 1)], "doc_id int, toxic int")
    assert {r.doc_id: r.score >= 0.7 for r in ToxicityModel(max_bytes=30_000).fit(docs, labels).score(docs).collect() if r.doc_id < 200} == {i: i % 2 == 1 for i in range(200)}


def test_toxicity_figures(found):
    for r in found["op5_toxicity"]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)


def test_cascade_orders_by_rejection_per_cost(spark):
    df = spark.createDataFrame([(i, "some plain words " * 60, 5) for i in range(600)], "doc_id int, text string, n_words int")
    slow = F.length(F.regexp_replace(F.concat(F.col("text"), F.col("text")), "(a|b|c|some|plain)+[^x]", "")) < 0
    cascade = RuleCascade({"slow": slow, "cheap": F.col("doc_id") % 2 == 0, "never": F.col("doc_id") < 0}).fit(df)
    assert cascade.order[0] == "cheap" and cascade.measured["slow"]["seconds"] > cascade.measured["cheap"]["seconds"]
    assert cascade.keep(df).count() == 300
    assert counts(df).columns == ["doc_id", "text", "n_words", "word_chars", "n_symbols", "n_exclamations", "n_dup_lines", "n_repeat_words"]
    assert set(RuleCascade().fit(df).order) == set(rules(F.col("text")))


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" + " " * 400_000 + "b", "\n" * 400_000, "word " * 200_000])
def test_packing_very_long_texts(spark, text):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, text, 2, 3)], "doc_id int, text string, part int, number int")
    rows = sorted(Packer(path).pack(df).collect(), key=lambda r: r.piece)
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [2]
    assert sum(r.length for r in rows) == len(ids) and all(r.length == 1024 for r in rows[1:])
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in rows)
