"""Odd inputs and brute-force versions of the operators and the pipeline."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shutterloom.llm import bpe, decontaminate, embedding_join, jaccard_join, language_id, license_scan, quality, token_counts, token_store, url_filter
from shutterloom.llm.common import ALNUM_TABLE, LOWER_TABLE, SPACED_TABLE, Memory, Tables, hashed_words


def docs(spark, rows, clash="n"):
    """Documents with extra columns that have names of results."""
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(clash) for c in ("n_tokens", "ids", "doc", "mark", "component_id", "n_words")})


def test_hashed_words():
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\t\n日A.") for _ in range(rng.randint(0, 30))).encode() for _ in range(300)] + [b"", b"x" * 300_000 + b" y", b" "]
    for table in (SPACED_TABLE, ALNUM_TABLE):
        h, begins = hashed_words(texts, table)
        known = {}
        for i, t in enumerate(texts):
            words = t.translate(table).split()
            assert begins[i + 1] - begins[i] == len(words)
            for w, x in zip(words, h[begins[i] : begins[i + 1]].tolist(), strict=True):
                assert known.setdefault(w, x) == x
        assert len(set(known.values())) == len(known)
    assert hashed_words([])[1].tolist() == [0]


@pytest.mark.parametrize("text_of", [lambda i: None, lambda i: "", lambda i: "a  b " * 30_000])
def test_tokens_of_empty_and_long_tables(spark, text_of):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    none, some = docs(spark, []), docs(spark, [(1, text_of(1)), (1, text_of(1)), (None, "x")])
    assert token_counts.token_counts(none).count() == bpe.round_trip(none).count() == license_scan.scan(none).count() == 0
    ids = t.encode(text_of(1) or "", add_special_tokens=False).ids
    got = bpe.round_trip(some).collect()
    assert [r.ids for r in got] == [ids, ids, t.encode("x").ids] and got[0].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    assert [int(r.n_tokens) for r in token_counts.token_counts(some).collect()] == [len(word.encode(x or "", add_special_tokens=False).ids) for x in (text_of(1), text_of(1), "x")]
    scanned = license_scan.scan(some).collect()
    assert scanned[0].n_words == len((text_of(1) or "").split()) and scanned[0].labels == []


def test_long_runs_without_white_space(monkeypatch):
    """Parts end before digits, between ideographs and at white space; their counts add up to the library's."""
    monkeypatch.setattr(token_counts, "PART_BYTES", 64)
    word = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    counter = token_counts.WordCounter(P.path("word_bpe_49k.json"))
    rng = random.Random(4)
    alphabets = ["AbcdefE'ſ", "ab01'sS.,|<>", "".join(chr(c) for c in range(0x4FF0, 0x9010, 7)), "日本語の中国、。東京大学", "日 本\n中国5a\u0301", "=", "人", "é\u0301가각\u11a8Σς"]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (30, 65, 130, 700, 5000)]
    texts += ["".join(rng.choice("".join(alphabets)) for _ in range(3000)) for _ in range(20)] + ["x" * 200 + "<|endoftext|>" + "日本5" * 90]
    want = [len(word.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter([t.encode() for t in texts]) == want
    for t, longest in (("".join(rng.choice(alphabets[2]) for _ in range(5000)), 64), ("ab0.c" * 900, 64), ("=" * 500, 500)):
        parts = list(counter.cuts.parts(t.encode(), 64))
        assert b"".join(p for p, _ in parts).decode() == t and max(len(p) for p, _ in parts) <= longest


def test_token_store_with_repeated_and_null_ids(spark):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(5, "b c"), (5, "a"), (5, "a"), (None, "null id"), (1, None), (1, ""), (9, "d " * 40_000)]
    root = Tables(spark).keep(spark.range(1), "store-root").inputFiles()[0].rsplit("/", 1)[0]
    token_store.write(docs(spark, rows), f"{root}-a")
    at = 0
    got = token_store.digests(spark, f"{root}-a").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 5, 5, 5, 9]
    want = Counter((i, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for i, x in rows)
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == want
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert {r.n_tokens: len(r.ids) for r in token_store.read(spark, f"{root}-a").collect()} == {r.n_tokens: r.n_tokens for r in got}
    token_store.write(docs(spark, []), f"{root}-b")
    assert token_store.digests(spark, f"{root}-b").count() == 0


def test_embedding_ties_and_repeated_ids(spark):
    """A cosine of just the bound is a link; rows of one id have the links of their own vectors."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.6, 0.8, 0.0, 0.0]
    rows = [(1, a, 1), (2, b, 1), (3, [0.6 - 1e-12, 0.8, 0.0, 0.0], 1), (4, [0.0, 0.0, 1.0, 0.0], 1), (4, [0.0, 0.0, 2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    got = sorted(map(tuple, embedding_join.near_vectors(df, cosine=0.6).collect()))
    assert got == [(1, 1, 1, True), (2, 2, 1, False), (3, 1, 1, False), (4, 1, 4, True), (4, 1, 4, True)]


def test_outlines_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 300, 700, 3000):
        a = np.unique(rng.integers(0, 2**64, n, np.uint64))
        for m in (0, 3, n // 8):
            b = np.unique(np.concatenate((a[: len(a) - min(m, len(a))], rng.integers(0, 2**64, m, np.uint64))))
            differ = len(np.setxor1d(a, b))
            assert jaccard_join.differences(jaccard_join.outline(a), jaccard_join.outline(b)) <= differ
    x, y = (np.unique(rng.integers(0, 2**64, 3000, np.uint64)) for _ in range(2))
    assert jaccard_join.differences(jaccard_join.outline(x), jaccard_join.outline(y)) > 0.15 * 6000


def brute_components(rows, size, percent):
    """The smallest id reachable by links, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().translate(LOWER_TABLE).split()
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    up = jaccard_join._Sets(len(rows))
    for i, x in enumerate(sets):
        for k in range(i):
            y = sets[k]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * (n := len(x & y)) >= percent * (len(x) + len(y) - n):
                up.join(i, k)
    least = defaultdict(lambda: math.inf)
    for i, (d, _) in enumerate(rows):
        least[up.find(i)] = min(least[up.find(i)], d)
    return [(d, len(sets[i]), least[up.find(i)]) for i, (d, _) in enumerate(rows)]


def test_one_large_family_and_hot_lists(spark, monkeypatch):
    """A passage that all documents share, 150 copies with other ends, lists headed in parts, tiles of few sets."""
    monkeypatch.setattr(jaccard_join, "HOT_LIST", 5)
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(i, passage + " " + " ".join(f"w{rng.randint(0, 12)}" for _ in range(6))) for i in range(150)]
    rows += [(200 + i, passage + " " + " ".join(f"q{i}_{k}" for k in range(60))) for i in range(30)] + [(400, rows[3][1]), (401, None), (401, "")]
    got = jaccard_join.near_duplicates(docs(spark, rows)).collect()
    assert sorted(map(tuple, got)) == sorted(brute_components(rows, 5, 80))


def brute_language(model, text):
    words = text.translate(ALNUM_TABLE).split()
    if not model.langs or not language_id.has_letter(text):
        return "und", 0.0
    total = np.zeros(len(model.langs))
    for w, n in Counter(words).items():
        at, known = model.by_size[0].find(hashed_words([w])[0])
        if known.all():
            total += n * model.by_size[0].rows(at[:1])[0].astype(float)
            continue
        for size in range(language_id.GRAM_MOST, 0, -1):
            keys = np.array([language_id.unit_key(g) for g in language_id.grams(w.decode(), size)], np.uint64)
            at, known = model.by_size[size].find(keys)
            if known.any():
                total += n * model.by_size[size].rows(at[known]).astype(float).mean(0)
                break
    total *= min(1.0, language_id.WORDS_IN_SCORE / max(len(words), 1))
    odds = np.exp(total - total.max())
    return model.langs[int(odds.argmax())], float(odds.max() / odds.sum())


def test_language_against_brute_force(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.learned(table)
    odd = [(10_000, None), (10_001, ""), (10_002, "123 !?"), (10_003, "qzx " * 20_000), (10_003, "der hund"), (None, "le chat"), (10_004, "日本 語")]
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()] + odd
    got = docs(spark, rows).select("text", language_id.predict(spark, model, F.col("text")).alias("p")).collect()
    for r in got:
        lang, score = brute_language(model, (r.text or "").encode())
        assert r.p.lang == lang and abs(r.p.score - score) < 1e-4, r.text


def test_language_bounds_hold_for_each_language(spark):
    """A language with few texts is learned beside one with many; repeated rows count once; ties go to the first by name."""
    rows = [(i, f"common words number {i}", "aa") for i in range(300)] + [(9000, "selten gesehen", "bb"), (9000, "selten gesehen", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df, docs_most=20)
    assert model.langs == ["aa", "bb"] and brute_language(model, b"selten")[0] == "bb"
    place = model.by_size[0].find(hashed_words([b"selten", b"gesehen"])[0])
    assert place[1].all()
    same = language_id.train(spark.createDataFrame([(1, "x y", "bb"), (2, "x y", "aa")], "doc_id long, text string, lang string"))
    assert brute_language(same, b"x") == ("aa", 0.5)
    sampled = language_id.sampled(df.select("lang", "text"), "lang", F.xxhash64("text"), 20).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in sampled} == {"aa": 20, "bb": 1}


def test_quality_against_brute_force(spark, sf):
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(table, labels, quality.grade_of_labels())
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()] + [(None, None), (7, ""), (7, "!!! ###"), (8, "Word " * 30_000)]
    top = len(model.thresholds)
    for r in docs(spark, rows).select("text", quality.rate(spark, model, F.col("text")).alias("r")).collect():
        raw = (r.text or "").encode()
        words = raw.translate(ALNUM_TABLE).split()
        marks = [*set(words), *quality.form(raw, len(words), len(set(words)))]
        score = sum(float(np.float32(model.weights[int(hashed_words([m])[0][0]) & ((1 << quality.BITS) - 1)])) for m in marks)
        tails = [1 / (1 + math.exp(min(500, max(-500, t - score)))) for t in model.thresholds]
        assert abs(r.r.tail - tails[-1]) < 1e-6 and abs(r.r.grade - sum(tails)) < 1e-6 and 0 <= r.r.grade <= top


def test_quality_of_odd_tables(spark):
    """No labels, no documents, labels that repeat or are null, an id with several texts."""
    some = docs(spark, [(1, "good"), (1, "other"), (2, None), (None, "x")])
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    for given in ([], [(None, 1, 0), (1, None, None)], [(1, 1, 0), (1, 0, 0), (2, 0, 1), (77, 1, 1)]):
        model = quality.train(some, labels(given), quality.grade_of_labels())
        assert some.select(quality.rate(spark, model, F.col("text")).alias("r")).filter("r.tail BETWEEN 0 AND 1").count() == 4
    assert quality.train(docs(spark, []), labels([(1, 1, 0)]), quality.grade_of_labels()).weights.any() == False  # noqa: E712


def brute_contamination(text, items, size=13):
    words, hit, found = decontaminate.words_of((text or "").encode()), set(), set()
    places = defaultdict(list)
    for item, own in items:
        w = decontaminate.words_of((own or "").encode())
        for i in range(max(1, len(w) - size + 1) if w else 0):
            places[tuple(w[i : i + size])].append(item)
    lengths = {len(p) for p in places}
    for n in lengths:
        for i in range(len(words) - n + 1):
            if owners := places.get(tuple(words[i : i + n])):
                hit |= set(range(i, i + n))
                found |= {str(o) for o in owners}
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [0, decontaminate.MOST_TERMS])
def test_decontamination_against_brute_force(spark, most):
    """Sent and joined terms; repeated rows and ids, null ids, windows that items share, texts of one word over and over."""
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice("abcdefgh") + rng.choice("xy") for _ in range(n))
    items = [(1, some(20)), (2, "Same " * 14), (3, some(13)), (4, "short one"), (5, None), (6, "!!"), (6, "ax"), (7, "ax ax bx"), (None, "by by by")]
    items += [(8, items[0][1]), (9, items[2][1] + " " + items[0][1])]
    texts = [some(30) + " " + items[0][1] + " " + some(5), "same " * 60_000, items[2][1].upper(), "short, one!", None, "", "ax ax bx by by by", some(400)]
    rows = list(enumerate(texts)) + [(0, texts[0]), (0, texts[7]), (None, texts[0]), (None, texts[3]), (1, "same " * 12)]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit("clash"))
    got = decontaminate.judge(docs(spark, rows), table, most_terms=most).collect()
    assert len(got) == len(rows)
    want = Counter()
    for d, t in rows:
        n, k, found = brute_contamination(t, [x for x in items if x[0] is not None] + [("", "by by by")])
        want[(d, n, k, tuple(x for x in found if x), k > 0 and 20 * k >= n)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == want


def test_proximity_matches(spark):
    """The two rarest words of a window near their places, with another word between, are a proximity match and no hit."""
    item = "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11 k12 k13"
    near = "k1 k2 k3 k4 k5 k6 zz k7 k8 k9 k10 k11 k12 k13"
    rows = [(1, near), (2, item), (3, "k1 " + "y " * 50 + "k13"), *[(10 + i, "k2 k3 k4 k5 k6 k7 k8 k9 k10 k11 k12") for i in range(3)]]
    got = {r.doc_id: r for r in decontaminate.judge(docs(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got[1].near_items == ["1"] and got[1]["items"] == [] and got[1].n_hit == 0
    assert got[2]["items"] == ["1"] and got[2].near_items == [] and got[2].n_hit == 13
    assert got[3].near_items == got[10].near_items == []


def test_url_lists_as_tables(spark):
    """An index and a join give the same; a rule with both verdicts blocks; empty lists allow all."""
    urls = [None, "", "x", "http://a.example.com/en/p", "http://www.example.com/en/", "http://b.net/es/x", "http://b.net/es/x", "http://viagra-shop.io/", "http://both.org/p/q", "http://plain.org", "HTTP://plain.org#x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"rule": F.lit("clash"), "probe": F.lit("clash"), "u": F.lit(1)})
    rules = spark.createDataFrame([*url_filter.RULES, ("allow", "both.org/p"), ("block", "both.org/p"), ("block", "plain.org")], "verdict string, rule string")
    terms = spark.createDataFrame([(t,) for t in url_filter.TERMS], "term string")
    sent, joined = ({r.page_id: r.judged for r in url_filter.judge_by_tables(pages, rules, terms, most=most).collect()} for most in (1 << 20, 0))
    assert sent == joined and len(sent) == len(urls)
    assert [sent[i].verdict for i in range(len(urls))] == ["allow", "allow", "allow", "block", "allow", "block", "block", "block", "block", "block", "block"]
    assert sent[8].rule == "both.org/p" and sent[9].rule == "plain.org"
    assert url_filter.judge_by_tables(pages, rules.limit(0), terms.limit(0)).filter("judged.verdict = 'block'").count() == 0
    assert url_filter.judge_by_tables(pages.limit(0), rules, terms).count() == 0


def test_equal_digests_of_different_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: len(k))
    (tmp_path / "i").write_bytes(url_filter.serialise([b"aa", b"bb", b"ccc", b"dd"]))
    index = url_filter.Index(str(tmp_path / "i"))
    assert index.find([b"bb", b"xx", b"ccc", b"dd", b"c", b"aa"]).tolist() == [True, False, True, True, False, True]
    (tmp_path / "e").write_bytes(url_filter.serialise([]))
    assert url_filter.Index(str(tmp_path / "e")).find([b"a"]).tolist() == [False]


def test_pipeline_against_brute_force(spark, sf):
    """All five stages row by row in plain Python, with the models that the stages fit."""
    import corpus_pipeline

    table = spark.read.parquet(f"{sf}/documents.parquet")
    extra = [(900_000, None), (900_001, ""), (None, "!!"), (900_002, "12 34")]
    given = table.unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    tables = Tables(spark)
    kept, data = [(r.doc_id, r.text) for r in given.collect()], tables.keep(given, "pipeline-in")

    def step(name, want):
        nonlocal data, kept
        data = tables.keep(dict(corpus_pipeline.STAGES)[name](spark, data, sf), f"pipeline-{name}")
        kept = want
        assert sorted((r.doc_id, r.text) for r in data.collect()) == sorted(want), name

    model = language_id.learned(data)
    step("language", [(i, t) for i, t in kept if (p := brute_language(model, (t or "").encode()))[0] != "und" and p[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE])
    rating = quality.train(data, spark.read.parquet(f"{sf}/labels.parquet"), quality.grade_of_labels())
    step("quality", [(i, t) for i, t in kept if rating.tails(rating.scores([t.encode()])[0])[-1] >= quality.SELECT_FROM])
    step("near_duplicates", [row for row, (i, _, c) in zip(kept, brute_components(kept, 5, 80), strict=True) if i == c])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    step("decontamination", [(i, t) for i, t in kept if not ((x := brute_contamination(t, items))[1] and 20 * x[1] >= x[0])])
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for i, text in kept:
        ids = t.encode(text, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.tokens(spark, data, sf).collect())) == sorted(want) and 0 < len(want) < len(given.collect())
    got = [tuple(r) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_xxhash_is_the_key_of_units():
    assert language_id.unit_key("ab") == xxhash.xxh3_64_intdigest(b"ab")


def test_language_model_against_plain_counts(spark):
    """All words and n-grams of the chosen texts are kept, with the scores of their counts."""
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(30)), rng.choice(["x", "y", "z"])) for i in range(60)] + [(99, None, "x"), (100, "word", None), (101, "only", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert model.langs == ["w", "x", "y", "z"]
    counts = defaultdict(Counter)
    for _, t, lang in rows:
        if t and lang:
            for w in t.encode().translate(ALNUM_TABLE).split():
                counts[0][hashed_words([w])[0][0], lang] += 1
                for size in range(1, language_id.GRAM_MOST + 1):
                    for g in language_id.grams(w.decode(), size):
                        counts[size][language_id.unit_key(g), lang] += 1
    for size, scores in enumerate(model.by_size):
        keys = sorted({int(k) for k, _ in counts[size]})
        assert scores.keys.tolist() == keys
        below = {lang: sum(n for (_, one), n in counts[size].items() if one == lang) + language_id.SMOOTH * len(keys) for lang in model.langs}
        want = [[math.log((counts[size][k, lang] + language_id.SMOOTH) / below[lang]) for lang in model.langs] for k in keys]
        assert np.allclose(scores.rows(np.arange(len(keys))), want, atol=1e-5)


def test_two_hundred_languages(spark):
    """A model's size follows what was seen, not entries times languages."""
    rng = random.Random(5)
    rows = [(i * 3 + k, " ".join(f"{chr(0x4E00 + i)}{rng.choice('abc')}w{rng.randint(0, 60)}" for _ in range(60)), f"l{i:03d}") for i in range(200) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df)
    assert len(model.langs) == 200
    assert sum(len(s.score) for s in model.by_size) < 4 * sum(len(s.keys) for s in model.by_size)
    got = df.select("lang", language_id.predict(spark, model, F.col("text")).alias("p")).collect()
    assert all(r.p.lang == r.lang for r in got)


def test_hosts_of_very_many_labels(spark):
    """Only suffixes as long as listed hosts are looked up."""
    url = "http://" + "a." * 100_000 + "example.com/en/x"
    assert len(url_filter.probes_of(url.encode(), [4], 3)[2]) < 3 + 200_010
    rows = [(1, url), (2, "http://example.com/en/"), (3, "http://x" + ".y" * 5000 + ".net/fr/"), (4, "http://.../en/")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.j.rule, r.j.verdict) for r in df.select("page_id", url_filter.Filter().judge(spark, F.col("url")).alias("j")).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: ("example.com/en/", "block"), 3: ("net/fr/", "block"), 4: (None, "allow")}


def test_a_list_of_size(spark):
    """A hundred thousand rules, of one to five labels, against a plain dictionary."""
    rng = random.Random(6)
    host = lambda: ".".join(f"n{rng.randint(0, 300)}" for _ in range(rng.randint(1, 5)))
    rules = {host() + rng.choice(["/", "/a/", "/a/b", "/c"]): rng.choice(["allow", "block"]) for _ in range(100_000)}
    urls = [f"http://{host()}{rng.choice(['', '/', '/a/b', '/a/x', '/c?q'])}" for _ in range(3000)]

    def plain(url):
        h, p = (x.decode() for x in url_filter.host_and_path(url.encode()))
        labels = h.split(".")
        fits = [r for k in range(len(labels)) for n in range(1, len(p) + 1) if (r := ".".join(labels[k:]) + p[:n]) in rules]
        best = min(fits, key=lambda r: (-len(r), r)) if fits else None
        return best, rules[best] if fits else "allow"

    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([(v, r) for r, v in rules.items()], "verdict string, rule string")
    want = {i: plain(u) for i, u in enumerate(urls)}
    hits = sum(r is not None for r, _ in want.values())
    assert 500 < hits < 3000
    none = spark.createDataFrame([], "term string")
    for most in (1 << 28, 0):
        got = {r.page_id: (r.judged.rule, r.judged.verdict) for r in url_filter.judge_by_tables(df, listed, none, most=most).collect()}
        assert got == want


def test_long_pieces_are_forgotten():
    known = Memory(10, 8)
    for k in range(5):
        keys = [b"short%d" % k, b"x" * (100 + k)]
        known.young.update((w, len(w)) for w in known.missing(keys))
        assert all(w in known.young for w in keys)
        known.trim()
        assert max(map(len, [*known.young, *known.older])) <= 8
    assert known.missing([b"short0", b"short4"]) == []


def test_margin_covers_rounding_in_many_dimensions(spark):
    """Pairs at the bound of 4096 dimensions: single precision may be off, the result isn't."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal(4096)
    x /= np.linalg.norm(x)
    rows = [(0, x.tolist(), 1)]
    for i, c in enumerate([0.93 - 1e-6, 0.93 - 1e-12, 0.93 + 1e-12, 0.93 + 1e-6, 0.9, 0.99], 1):
        o = rng.standard_normal(4096)
        o -= (o @ x) * x
        o /= np.linalg.norm(o)
        rows.append((i, (c * x + math.sqrt(1 - c * c) * o).tolist(), 1))
    assert embedding_join.margin(64) == 1e-5 and embedding_join.margin(4096) > 4e-4
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    v = {i: np.array(e) for i, e, _ in rows}
    linked = lambda a, b: (v[a] * v[b]).sum() / math.sqrt((v[a] ** 2).sum() * (v[b] ** 2).sum()) >= 0.93
    got = {r.vec_id: r.n_links for r in embedding_join.near_vectors(df).collect()}
    assert got == {a: sum(a != b and linked(a, b) for b in v) for a in v}


def test_an_id_of_very_many_rows(spark, monkeypatch):
    """Rows that repeat an id and text come to their family's tiles once."""
    seen = []
    original = jaccard_join.family_links

    def watched(sets, percent):
        seen.append(sets.groupBy("key").count().agg(F.max("count")).first()[0])
        return original(sets, percent)

    monkeypatch.setattr(jaccard_join, "family_links", watched)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text)] * 500 + [(8, text + " more"), (9, "another text of no kin at all here"), (7, text + " end")]
    got = jaccard_join.near_duplicates(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter({(7, 7): 501, (8, 7): 1, (9, 9): 1})
    assert seen == [1]
