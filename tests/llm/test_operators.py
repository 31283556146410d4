"""Each operator against brute force, with nulls, empty and very long texts, repeated rows, extra columns and empty tables."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from facetloom.llm.components import components
from facetloom.llm.license_scan import LicenseScanner
from facetloom.llm.mixing import SourceMixer
from facetloom.llm.mtree import MTreeIndex
from facetloom.llm.ngram_join import NgramJoin
from facetloom.llm.packing import Packer, places, plan, subset_sum
from facetloom.llm.pii import Sanitiser, entities
from facetloom.llm.quality_rules import RuleCascade, counts, rules
from facetloom.llm.sharding import KdSharder
from facetloom.llm.token_counts import TokenCounter
from facetloom.llm.toxicity import NoisyOr, ToxicityModel

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, t string, part string, shard int"
SPECIAL = [
    (1000, None, None, None, None),
    (1001, "", "en", "src1", 0),
    (1002, "   \n\t ", "en", "src1", 6),
    (1003, "two words", "de", None, 9),
    (1004, "word " * 30_000, "en", "src0", 150_000),
    (1004, "word " * 30_000, "en", "src0", 150_000),
    (1005, "Released under the\nMIT License. <|endoftext|> ▁x  y é \U0001f600", "fr", "src7", 40),
]


def documents():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(5, 400)))
        rows.append((i, text, rng.choice(["en", "de"]), f"src{i % 4}", len(text)))
    base = " ".join(rng.choice(words) for _ in range(300)).split()
    for i in range(60, 110):  # near copies of one text, more than a block of an uncommon n-gram may hold
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy), "en", "src0", 0))
    rows += [(110, rows[60][1].upper(), "en", "src1", 0), (111, rows[0][1], "en", "src2", 0)]
    return rows + SPECIAL


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z", 5) for r in documents()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_license_scan(docs, empty):
    rows = {r["doc_id"]: r for r in LicenseScanner().fit(docs).scan(docs).collect()}
    r = rows[1005]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (1, 1, 1, "mit", "mit", 1.0)
    assert (rows[1000].n_words, rows[1000].score, rows[1002].n_words, rows[1004].n_words) == (0, 0.0, 0, 30_000)
    assert LicenseScanner().fit(empty).scan(empty).count() == 0


def test_license_blocks_equal_containment(spark):
    scanner = LicenseScanner()
    lines = ["Licensed under CC BY-NC 4.0.", "all rights", "This work is licensed under GNU General Public License version 3", "the license of the work", "rights reserved, ALL"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id int, text string")
    got = {r.doc_id: r.labels for r in scanner.fit(df).scan(df).collect()}
    for i, line in enumerate(lines):
        words = set(re.findall("[0-9a-z]+", line.lower()))
        want = sorted({label for label, ws in scanner.templates if len(words & set(ws)) >= 0.8 * len(ws)} | ({"cc-by-nc"} if i == 0 else set()))
        assert got[i] == ",".join(want)


def test_sharding(docs, empty):
    rows = KdSharder(4).assign(docs.where("doc_id < 1000")).collect()
    sizes = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert len(rows) == 112 and max(sizes) - min(sizes) <= 3 * max(r["size"] for r in rows)
    whole = KdSharder(4).assign(docs).collect()
    assert len(whole) == 119 and {r["shard"] for r in whole} <= {0, 1, 2, 3}
    assert KdSharder(4).assign(empty).count() == 0


def truth(rows, n=3, percent=90):
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("percent", [90, 80])
def test_ngram_join(docs, empty, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in NgramJoin(percent=percent).classes(docs).collect()}
    assert got == truth(documents(), percent=percent)
    if percent == 90:
        assert NgramJoin().classes(empty).count() == 0


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a int, b int")
    roots = {r.node: r.root for r in components(links).collect()}
    assert {roots[i] for i in range(41)} == {0} and roots[100] == roots[101] == 100


def test_mixing(docs, empty):
    rows = SourceMixer(share=1.0, max_epochs=2).choose(docs).collect()
    tokens = lambda r: len((r["text"] or "").split())
    assert sum(map(tokens, rows)) <= sum(len((r[1] or "").split()) for r in documents())
    epochs = defaultdict(set)
    for r in rows:
        epochs[r["doc_id"]].add(r["epoch"])
    assert all(e in ({0}, {0, 1}) for e in epochs.values())
    again = SourceMixer(share=1.0, max_epochs=2).choose(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["epoch"]) for r in rows) == sorted((r["doc_id"], r["epoch"]) for r in again)
    assert SourceMixer().choose(empty).count() == 0


def test_mixing_budgets_pass_shortages_to_siblings_first(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 10), ("web", "en", "b", 1000), ("books", "en", "c", 1000)], "domain string, language string, origin string, tokens long")
    mixer = SourceMixer(weights={"domain": {"web": 0.5, "books": 0.5}, "language": {}, "origin": {}}, share=400 / 2010, max_epochs=1)
    got = {r.origin: r.budget for r in mixer.budgets(leaves).collect()}
    assert got == {"a": 10, "b": 190, "c": 200}


def test_toxicity(spark, empty):
    rng = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(words) for _ in range(6)) for _ in range(8)]
        if i % 4 == 0:
            sentences[3] += " you " + rng.choice(["vile", "vilest", "rotten"])
        texts.append(". ".join(sentences))
        labels.append(int(i % 4 == 0))
    model = NoisyOr().fit(texts[:300], labels[:300])
    scores = [model.score(t) for t in texts[300:]]
    assert sum((s >= 0.7) == bool(y) for (s, _), y in zip(scores, labels[300:])) >= 98
    found = [re.search("vile|vilest|rotten", texts[300 + i][a:b]) for i, (_, bad) in enumerate(scores) for a, b, _ in bad]
    assert found and sum(x is not None for x in found) >= 0.95 * len(found)
    nothing = ToxicityModel().fit(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.score(empty).count() == 0
    special = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000)], "doc_id long, text string")
    assert [round(r.score, 3) for r in nothing.score(special).collect()] == [0, 0, 0]


def repeats(words, width=5):
    seen = defaultdict(list)
    for i in range(len(words) - width + 1):
        seen[tuple(words[i : i + width])].append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(width)})


def test_quality_counts_and_cascade(spark, docs, empty):
    extra = spark.createDataFrame([(1, "a b c d e f a b c d e f\nx\n\nx\n#|! a b c d e"), (2, " lead and trail \n")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text"), extra):
        for r in counts(df).collect():
            t = r["text"] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)))
            assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats(w))
    cascade = RuleCascade().fit(docs)
    kept = {r.doc_id for r in cascade.keep(docs).collect()}
    cascade.order.reverse()
    assert kept == {r.doc_id for r in cascade.keep(docs).collect()}
    assert {0, 60} <= kept and not {1000, 1001, 1002, 1003, 1004} & kept
    assert set(cascade.order) == set(rules(F.col("text"))) and RuleCascade().fit(empty).keep(empty).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = Packer(path).pack(docs).toPandas()
    for (i, text, *_) in documents():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        pieces = rows[rows.doc_id == i].drop_duplicates("piece").sort_values("piece")
        assert pieces.start.tolist()[0] == 0 and pieces.length.sum() == len(ids)
        assert (pieces.length[1:] == 1024).all()
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.length.sum() <= 1024 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    fewest = max(rows.length.sum() / 1024, (rows.length > 512).sum())  # no two of the long ones fit together
    assert rows.sequence_id.nunique() <= 1.03 * fewest + 1
    assert Packer(path).pack(empty).count() == 0


def test_packing_plan_places_every_piece_once():
    rng = random.Random(5)
    histogram = {n: rng.randint(1, 40) for n in rng.sample(range(1, 1025), 300)}
    for groups in (8, 64, 512):
        runs = plan(histogram, groups=groups)
        used = defaultdict(int)
        for count, lengths in runs:
            assert sum(lengths) <= 1024
            for n in lengths:
                used[n] += count
        assert used == histogram
        assert {n: sum(p[1] for p in at) for n, at in places(runs).items()} == histogram
    assert sorted(subset_sum([7, 5, 3], {7: 1, 5: 2, 3: 1}, 13)) == [3, 5, 5]


def test_pii(docs, empty, spark):
    text = "mail a.b@x.org, not @x or a@b; 10.0.0.1.2.3.4.5 999.1.1.1 card 4111 1111-1111 1111 call +1 (499) 555-6503 é b@c.d.e"
    found = entities(text)
    assert [(k, text[a:b]) for k, a, b in found] == [("email", "a.b@x.org"), ("email", "b@c.d.e"), ("ip", "10.0.0.1"), ("ip", "2.3.4.5"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (499) 555-6503")]
    rows = [(i, f"plain words number {i} stand here. Reach codename me{i}@x.org today") for i in range(60)] + [(99, None), (98, ""), (97, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sanitiser = Sanitiser(gain_bits=1.0).fit(df)
    assert "codename" in sanitiser.terms and "plain" not in sanitiser.terms
    assert sanitiser.clean(rows[3][1]) == "plain words number 3 stand .   [EMAIL] " and sanitiser.clean("codename alone") == "codename alone"
    assert {r.doc_id: r.text for r in sanitiser.sanitised(df).collect()}[99] is None
    assert Sanitiser().fit(empty).find(empty).count() == 0 and Sanitiser().fit(docs).sanitised(docs).columns == docs.columns


def test_mtree(spark):
    rng = np.random.default_rng(2)
    x = [(i, rng.normal(size=8).round(2).tolist(), 0) for i in range(600)] + [(i, x0, 1) for i in range(600, 700) for x0 in ([0.5] * 8,)]
    x += [(900, None, 0), (901, [1.0, float("nan")] + [0.0] * 6, 0), (902, [None] * 8, 0), (950, [1.0, 2.0], 0), (None, [0.1] * 8, 0)]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>, page int").repartition(4)
    got = defaultdict(list)
    for r in MTreeIndex(page=128, leaf=16).fit(df, F.col("vec_id") % 50 == 0).top(5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = {i: np.floor(256 * np.array(e)).astype(int) for i, e, _ in x if i is not None and e and None not in e and np.isfinite(e).all()}
    for q in (i for i in v if i % 50 == 0):
        want = sorted(((-int(v[q] @ v[o]), o) for o in v if o != q and len(v[o]) == len(v[q])))[:5]
        assert got.get(q, []) == [(o, -s) for s, o in want]
    none = df.where("vec_id < 0")
    assert MTreeIndex().fit(none, F.col("vec_id") % 50 == 0).top(5).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts(docs, empty, name):
    path = public_tokenizers.path(name)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in TokenCounter(path).fit(docs).count(docs).collect()}
    if name.endswith("model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lambda t: len(model.encode(t))
    else:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for i, text, *_ in documents():
        assert got[i] == (len((text or "").encode()), size(text or ""))
    assert TokenCounter(path).fit(empty).count(empty).count() == 0
