"""Operators against brute force, the tokenizers library, round trips and held-out labels, on small odd inputs."""

import hashlib
import itertools
import math
import os
import random
import re
import sys
import zlib
from collections import Counter
from re import _parser as sre

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from oracle import check

from shutterloom.llm import bpe, decontaminate, embedding_join, jaccard_join, language_id, license_scan, quality, registry, token_counts, token_store, url_filter
from shutterloom.llm.common import LOWER_TABLE, Tables

ODD = [None, "", " ", "\n\n  x", "<|endoftext|>", "a  <|endoftext|> b <|startoftext|>", "don't  'x ''   　😀  😀 a…'s …'s", "é à  è'll", "H̱ ΑΣ İ K", "ab\x1cd\x85e 12 3,4", "x" * 3000, "word " * 5000, "ERÄ!! BEPFUNG!!"]
_rng = random.Random(1)
ODD += ["".join(_rng.choice("abKH̱#(b '\t\n\r  éà…😀 　 1٣,.-sltdrevm<|>́Σñ字ß") for _ in range(_rng.randint(1, 60))) for _ in range(400)]


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, a null id, extra columns with the names of results."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "null id")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit("clash"), "ids": F.lit(1), "label": F.lit("l"), "key": F.lit(2)})


def texts():
    return {i: t or "" for i, t in enumerate(ODD)} | {None: "null id"}


def test_token_counts(odd):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts().items()}
    got = token_counts.token_counts(odd, limit=100).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len(texts()[r.doc_id].encode()), want[r.doc_id] > 100), texts()[r.doc_id]


def test_token_counts_of_other_tokenizers(spark, odd):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    for r in odd.select("doc_id", token_counts.token_count(F.col("text"), "piece_bpe_32k.model").alias("n")).collect():
        assert r.n == len(model.encode(texts()[r.doc_id]))


def test_bpe_round_trip(odd):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in bpe.round_trip(odd).collect():
        ids = t.encode(texts()[r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == t.decode(ids, skip_special_tokens=False), texts()[r.doc_id]
    done = odd.select("doc_id", bpe.encode(F.col("text")).alias("i")).select("doc_id", bpe.ids_sha256(F.col("i")).alias("d"), bpe.decode(F.col("i")).alias("t")).collect()
    for r in done:
        ids = t.encode(texts()[r.doc_id], add_special_tokens=False).ids
        assert r.d == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_long_texts_are_cut_at_forced_boundaries(monkeypatch):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(bpe, "PART_BYTES", 16)
    own = bpe.Codec(P.path("byte_bpe_50k.json"))
    for x in ODD[1:]:
        want = np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        assert own.encode(x.encode()) == want and own.encode_stream([x.encode()])[0] == want


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (1, 7, 70_000, 200_000):
        ids = (rng.zipf(1.3, n) % 50257).astype("<u4")
        s = token_store.Shard(token_store.build(ids, np.array([n]), [5]))
        assert (s.tokens() == ids).all()
        for i in range(0, n, max(1, n // 40)):
            token = int(ids[i])
            assert s.access(i) == token and s.count(token, 0, i) == int((ids[:i] == token).sum())
            where = np.flatnonzero(ids == token)
            assert s.find(token, len(where) - 1) == where[-1] and s.find(token, len(where)) is None
        assert s.count(60000) == 0


def test_token_store(spark, odd, monkeypatch):
    path = f"{Tables(spark).keep(spark.range(1), 'x').inputFiles()[0].rsplit('/', 1)[0]}-store"
    rows = odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    token_store.write(rows, path)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start = 0
    for r in token_store.digests(spark, path).orderBy("doc_id").collect():
        ids = np.array([*t.encode(texts()[r.doc_id], add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


LICENCES = ["MIT License", "x mit-license: the MIT License mit license", "Apache License, Version 2.0. GNU General Public License, version 3", "Élan Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: GPL-3.0-or-later All rights reserved. Copyright 2020", "the mitlicense mit licensed İ mit license", "mit license apache license version 2 " * 100]


def test_license_scan(spark, odd):
    cases = {10_000 + i: t for i, t in enumerate(LICENCES)}
    df = odd.select("doc_id", "text", "label").unionByName(spark.createDataFrame(list(cases.items()), "doc_id long, text string").withColumn("label", F.lit("x")))
    known = texts() | cases
    for r in license_scan.scan(df).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", known[r.doc_id].encode().translate(LOWER_TABLE).decode())
        places, base = [], set()
        for phrase, label in license_scan.BASE:
            p = phrase.split()
            hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += hits
            base |= {label} if hits else set()
        norm = " " + " ".join(words) + " "
        found = [(m.start(), m.end(), level, k, label) for k, (label, level, word, rx) in enumerate(license_scan.rules()) if word in norm for m in re.finditer(f"(?<= )(?:{rx})(?= )", norm, re.ASCII)]
        kept = [d for d in found if not any(e is not d and e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1] and (e[:2] != d[:2] or e[2:4] < d[2:4]) for e in found)]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == sorted(base) and r.labels == sorted(base | {d[4] for d in kept}) and 0 <= r.score <= 1


def _wordings(pattern, most=60):
    """Texts that a rule's pattern matches: all combinations of its alternatives, or as many drawn ones where there are more."""
    rng = random.Random(0)

    def of(items):
        parts = [one(*item) for item in items]
        if math.prod(map(len, parts)) <= most:
            return list(dict.fromkeys("".join(p) for p in itertools.product(*parts)))
        # each alternative of each part, among drawn ones of the others
        drawn = ["".join([*map(rng.choice, parts[:k]), x, *map(rng.choice, parts[k + 1 :])]) for k, part in enumerate(parts) for x in part]
        return list(dict.fromkeys(drawn))

    def one(op, arg):
        op = str(op)
        if op == "LITERAL":
            return [chr(arg)]
        if op == "IN":
            return ["x" if str(a) == "CATEGORY_WORD" else "1" if str(a) == "CATEGORY_DIGIT" else chr(a) for _, a in arg]
        if op == "BRANCH":
            return [t for branch in arg[1] for t in of(branch)]
        if op == "SUBPATTERN":
            return of(arg[-1])
        assert op == "MAX_REPEAT", op
        return ["", *of(arg[2])] if arg[0] == 0 else of(arg[2])

    return of(sre.parse(pattern))


def test_license_scan_of_single_mentions(spark):
    """One mention of each alternative of each pattern and no other word: no rule may need words beside its own."""
    cases = sorted({t for _, _, _, rx in license_scan.rules() for t in _wordings(rx)} | {"This tool is GPLv3.", "gnu gplv2", "LGPLv2 1", "lgpl3", "AGPLv3", "agpl3"})
    rules = [(label, level, k, word, re.compile(f"(?<= )(?:{rx})(?= )", re.ASCII)) for k, (label, level, word, rx) in enumerate(license_scan.rules())]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    wrong = []
    for r in license_scan.scan(df).collect():
        norm = " " + " ".join(re.findall("[0-9a-z]+", cases[r.doc_id].lower())) + " "
        found = [(m.start(), m.end(), level, k, label) for label, level, k, word, rx in rules if word in norm for m in rx.finditer(norm)]
        kept = [d for d in found if not any(e is not d and e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1] and (e[:2] != d[:2] or e[2:4] < d[2:4]) for e in found)]
        want = sorted((d[0], d[1], d[2], d[4]) for d in kept)
        if sorted((d.start, d.end, d.level, d.label) for d in r.detections) != want:
            wrong.append((cases[r.doc_id], want))
    assert not wrong, (len(wrong), wrong[:10])


def test_license_keywords_are_in_each_match(spark):
    """The keyword of a rule excludes no wording of its own pattern; a scan finds what the patterns alone find."""
    rules = license_scan.rules()
    assert [(word, t) for _, _, word, rx in rules for t in _wordings(rx) if word not in f" {t} "] == []
    cases = ["PSF License 2.0", "Licensed under the terms of the PSF licence", "Unauthorised copying is forbidden.", "unauthorized use", "Published under a pseudonym", "released under protest", "SPDX-License-Identifier: Python-2.0"]
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in license_scan.scan(df).collect():
        norm = " " + " ".join(re.findall("[0-9a-z]+", cases[r.doc_id].lower())) + " "
        found = [(m.start(), m.end(), level, k, label) for k, (label, level, _, rx) in enumerate(rules) for m in re.finditer(f"(?<= )(?:{rx})(?= )", norm, re.ASCII)]
        kept = [d for d in found if not any(e is not d and e[2] <= d[2] and e[0] <= d[0] and e[1] >= d[1] and (e[:2] != d[:2] or e[2:4] < d[2:4]) for e in found)]
        assert kept and sorted((d.start, d.end, d.level, d.label) for d in r.detections) == sorted((d[0], d[1], d[2], d[4]) for d in kept), cases[r.doc_id]


def test_embeddings_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "CELL", 8)
    monkeypatch.setattr(embedding_join, "TILE", 16)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 64))
    x = np.concatenate([b + rng.standard_normal((12, 64)) * s for b in base for s in (0.2, 0.27)]).astype(np.float32)
    x = np.concatenate([x, x[:5]])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    odd_rows = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] + [1.0] * 63, 0), (904, x[0].tolist(), None), (905, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit(1))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    label = np.arange(len(x)) % 2
    near = (u @ u.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    groups = jaccard_join._Sets(len(x))
    for a, b in zip(*np.nonzero(near), strict=True):
        groups.join(int(a), int(b))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_join.near_vectors(df).collect()}
    assert near.sum() > 100
    for i in range(len(x)):
        assert got[i] == (int(near[i].sum()), groups.find(i), groups.find(i) == i)
    assert all(got[i] == (0, i, True) for i in range(900, 906))
    assert embedding_join.near_vectors(df.limit(0)).count() == 0


def test_embeddings_without_id(spark):
    """Rows with a null id link like others; ids beyond 2^53 keep their digits."""
    a, b = 2**53 + 1, 2**53 + 3
    turns = [(a, 0), (None, 20), (b, 40), (None, 120), (None, 120), (None, 135), (7, 250), (None, 250), (8, 320)]
    rows = [(i, [math.cos(math.radians(t)), math.sin(math.radians(t))], 1) for i, t in turns] + [(None, None, 1), (None, [1.0, 0.0], None)]
    got = embedding_join.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert dict(got.dtypes)["component_id"] == "bigint"
    want = [(a, 1, a, True), (None, 2, a, False), (b, 1, a, False)] + [(None, 2, None, True)] * 3 + [(7, 1, 7, True), (None, 1, 7, False), (8, 0, 8, True)] + [(None, 0, None, True)] * 2
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_near_duplicates_without_id(spark):
    """Sets that only rows with a null id hold carry links between others."""

    def words(name, start):
        return " ".join(f"{name}{i}" for i in range(start, start + 100))

    rows = [(1, words("a", 0)), (None, words("a", 5)), (None, words("a", 5)), (2, words("a", 10)), (None, words("b", 0)), (None, words("b", 5)), (3, words("c", 0)), (None, words("c", 0)), (None, None), (None, "")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rule=jaccard_join.Rule(size=1, percent=90)).collect()
    want = [(1, 100, 1), (None, 100, 1), (None, 100, 1), (2, 100, 1), (None, 100, None), (None, 100, None), (3, 100, 3), (None, 100, 3), (None, 0, None), (None, 0, None)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "a://example.com/en/", "a://xexample.com/en/", "a://b.net/es/1", "a://net/fr/", "a://b.net/esx", "x://cheap-pills.example.org/en/", "x://pills.com", "x://pills.com/", "x://h?a/b", "x://h/p#q?r://z"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: tuple(r.j) for r in df.select("page_id", url_filter.Filter().judge(spark, F.col("url")).alias("j")).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[5][2:] == ("example.com/en/", "block") and got[6][2:] == ("com/", "allow")
    assert got[7][2:] == ("net/es/", "block") and got[8][2:] == ("net/fr/", "block") and got[9][2] is None
    assert got[10][2:] == (None, "block") and got[11][2:] == (None, "block") and got[12][2:] == ("com/", "allow") and got[13][:2] == ("h", "") and got[14][:2] == ("h", "/p")


def shingle_sets(rows, size):
    out = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER_TABLE).split()
        out[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize("size, percent", [(4, 85), (5, 80)])
def test_jaccard_against_brute_force(spark, monkeypatch, size, percent):
    monkeypatch.setattr(jaccard_join, "TILE", 8)
    rng = random.Random(size)
    words = [f"w{i}" for i in range(300)]
    rows, base = [], [[rng.choice(words) for _ in range(rng.randint(3, 120))] for _ in range(8)]
    passage = [rng.choice(words) for _ in range(20)]
    for b in base:
        for _ in range(14):
            t = list(b) if rng.random() < 0.7 else b + passage
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((len(rows), " ".join(t)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1004, "one TWO"), (1005, "one"), (1006, rows[0][1])]
    sets, up = shingle_sets(rows, size), jaccard_join._Sets(len(rows))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[rows[a][0]], sets[rows[b][0]]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                up.join(a, b)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash"))
    for r in jaccard_join.near_duplicates(df, rule=jaccard_join.Rule(size, percent)).collect():
        place = [i for i, _ in rows].index(r.doc_id)
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), rows[up.find(place)][0])


def test_jaccard_of_empty_table(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_language_held_out(spark, sf):
    judged = language_id.op8_language_id(spark, sf)
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = judged.filter("held_out").join(truth, "doc_id")
    assert held.filter("lang_pred = lang").count() >= 0.95 * held.count() > 0


def test_language_of_odd_texts(spark, odd):
    model = language_id.train(spark.createDataFrame([(1, "the cat", "en"), (2, "der hund", "de"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.p for r in odd.select("doc_id", language_id.predict(spark, model, F.col("text")).alias("p")).collect()}
    assert got[0].lang == got[1].lang == got[2].lang == "und" and all(0 <= p.score <= 1 for p in got.values())
    empty = language_id.train(odd.select("doc_id", "text", F.lit(None).cast("string").alias("lang")).limit(0))
    assert odd.select(language_id.predict(spark, empty, F.col("text")).alias("p")).filter("p.lang <> 'und'").count() == 0


def test_decontamination_sql(spark, sf):
    check(spark, decontaminate.op9_decontaminate, decontaminate.OP9_SQL, sf)


def test_decontamination_of_odd_texts(spark, odd):
    items = spark.createDataFrame([(1, "one"), (2, " ".join(f"t{i}" for i in range(15))), (3, None), (4, "..."), (5, "null id")], "item_id long, text string")
    extra = spark.createDataFrame([(5000, "a ONE b"), (5001, "z " + " ".join(f"T{i}" for i in range(13)) + " z"), (5002, " ".join(f"t{i}" for i in range(12)))], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(extra)
    got = {r.doc_id: r for r in decontaminate.judge(docs, items).collect()}
    assert (got[5000].n_hit, got[5000].items, got[5000].contaminated) == (1, ["1"], True)
    assert (got[5001].n_words, got[5001].n_hit, got[5001].items) == (15, 13, ["2"]) and got[5002].n_hit == 0
    assert got[0].n_words == 0 and not got[0].contaminated
    assert decontaminate.judge(docs.limit(0), items).count() == 0 and decontaminate.judge(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_quality(spark, sf):
    judged = quality.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good, bad = judged.filter("quality = 1 AND toxic = 0"), judged.filter("quality = 0")
    assert good.filter("selected").count() >= 0.97 * good.count() and bad.filter("selected").count() <= 0.2 * bad.count()


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 3, 600)
    rows = [np.array([g, 10 + rng.integers(0, 50)], np.int32) for g in grades]
    model = quality.fit(rows, grades)
    assert (np.diff(model.thresholds) >= 0).all()
    assert model.weights[0] < model.weights[1] < model.weights[2]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, sf, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name], sf)


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.run(spark, sf)
    ids = [r.doc_id for r in kept.collect()]
    assert 0 < len(ids) <= docs.count() and len(set(ids)) == len(ids)
    left = docs.join(kept.select("doc_id"), "doc_id").select("doc_id", "text")
    again = jaccard_join.near_duplicates(left)
    assert again.filter("component_id <> doc_id").count() == 0
    assert decontaminate.judge(left, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns, name
    assert Counter(ids).most_common(1)[0][1] == 1
