"""Nearest vectors, lexical search and vector codes against brute force, on small odd inputs."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterloom.llm import lexical_search, nearest, vector_codes
from shutterloom.llm.common import LOWER_TABLE, Tables

NAN, INF = float("nan"), float("inf")
BAD = [None, [0.0] * 8, [NAN] + [1.0] * 7, [INF] * 8]


def vectors(spark, rows):
    """Vectors with extra columns that have names of results and of inner columns."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    return df.withColumns({c: F.lit("clash") for c in ("num", "row", "entry", "code", "error", "score", "rank", "vec", "vector")})


def brute_nearest(rows, most, step):
    """For each query row its neighbours in order: (score, id)."""
    usable = [(k, i, np.array(v, float)) for k, (i, v, _) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for k, i, v in usable:
        if i is not None and i % step == 0:
            near = sorted(((-float((v * w).sum()), math.inf if j is None else j, j) for n, j, w in usable if n != k and len(w) == len(v)), key=lambda x: x[:2])[:most]
            out.append((i, [(-s, j) for s, _, j in near]))
    return out


def found(spark, rows, most=5, step=3, **more):
    out = defaultdict(list)
    for r in nearest.nearest(vectors(spark, rows), F.col("vec") % step == 0, most, **more).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.rank, r.score, r.vec_id))
    return out


def test_nearest_of_odd_rows(spark):
    """Ties, copies, other lengths, lengths of vectors that differ, unusable rows; so few rows that the radius takes all."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 8)], 1) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 0.0, -1.0, 0.0, 0.0, 1.0, 0.0], 1) for i in range(40)] + [(None, rows[3][1], 1), (None, [1.0] * 8, 1)]
    rows += [(3 * i, v, 1) for i, v in enumerate(BAD)] + [(600 + i, [float(i), 1.0, -1.0], 1) for i in range(7)] + [(900, [1.0] * 2, 1)]
    got = found(spark, rows, reach=1.0)
    want = brute_nearest(rows, 5, 3)
    assert {i for i, near in want if near} == set(got)
    for i, near in want:
        assert [r for r, _, _ in got[i]] == list(range(1, len(near) + 1))
        assert [s for _, s, _ in got[i]] == pytest.approx([s for s, _ in near], abs=1e-12)
    # integers have exact scores, so ties go by id; a repeated id would be two queries
    for i, near in want:
        if i < 600:
            assert [v for _, _, v in got[i]] == [v for _, v in near], i


def test_nearest_without_rows_or_queries(spark):
    assert found(spark, []) == {} and found(spark, [(1, [1.0, 2.0], 1)]) == {} and found(spark, [(0, None, 1)]) == {}
    assert found(spark, [(0, [1.0, 2.0], 1)]) == {}  # no candidate
    assert found(spark, [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1)])[0] == [(1, 5.0, 0), (1, 5.0, 0)]  # each is the other's


def test_nearest_recall_and_tiles(spark, monkeypatch):
    """Recall of random vectors of different lengths, with lists in several blocks and tiles; a dense group of near copies."""
    monkeypatch.setattr(nearest, "TILE", 300)
    monkeypatch.setattr(nearest, "QUERY_TILE", 40)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2500, 24)) * rng.uniform(0.2, 3, (2500, 1))
    x[2000:] = x[7] + 1e-3 * rng.standard_normal((500, 24))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got, hit, total = found(spark, rows, 20, 10), 0, 0
    for i, near in brute_nearest(rows, 20, 10):
        assert len(got[i]) == 20 and all(s == pytest.approx(float((x[i] * x[v]).sum()), abs=1e-12) for _, s, v in got[i])
        assert all(a[1] >= b[1] for a, b in zip(got[i], got[i][1:]))
        hit += len({v for _, v in near} & {v for _, _, v in got[i]})
        total += len(near)
    assert hit / total >= 0.9


def test_shares_hold_every_pair():
    """Two codes within the radius differ in some substring by its share at most."""
    rng = random.Random(4)
    for radius in [*range(12), 50, 52, 128]:
        share = nearest.shares(radius)
        for _ in range(200):
            cuts = sorted(rng.randint(0, radius) for _ in range(nearest.PIECES - 1))
            parts = [b - a for a, b in zip([0, *cuts], [*cuts, radius])]
            assert any(d <= s for d, s in zip(parts, share, strict=True))


# ---- lexical search


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER_TABLE).decode())


def brute_search(docs, items, most):
    corpus = [(i, Counter(w)) for i, t in docs if (w := terms_of(t))]
    n, total, held = len(corpus), sum(sum(c.values()) for _, c in corpus), Counter(t for _, c in corpus for t in c)
    out = []
    for key, text in items:
        weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) for t in set(terms_of(text)) if t in held}
        scored = []
        for i, c in corpus:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weight.items() if t in c)
            if s > 0:
                scored.append((-s, math.inf if i is None else i, i))
        out += [(key, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2])[:most], 1)]
    return sorted(out, key=str)


def searched(spark, docs, items, most, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("item", "score", "rank", "terms", "ids")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("clash") for c in ("item", "key", "terms", "doc_id")})
    index = Tables(spark).keep(lexical_search.build(d), "index", **lexical_search.WRITER)
    return sorted((tuple(r) for r in lexical_search.search(index, i, most, **more).collect()), key=str)


ODD_TEXTS = [None, "", " ... ", "É é E", "don't", "日本 語 日本", "a_b", "x" * 5000, "A a 1 1 1"]


@pytest.mark.parametrize("words,short,most", [(64, 0.5, 3), (64, 0.0, 7), (1 << 20, 100.0, 50), (200, 0.1, 10)])
def test_search_against_scoring_everything(spark, monkeypatch, words, short, most):
    """Small and large shards, all lists short or all long, ties, copies, rows without id, items in several blocks."""
    monkeypatch.setattr(lexical_search, "SHARD_WORDS", words)
    monkeypatch.setattr(lexical_search, "SHORT_PART", short)
    rng = random.Random(words)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(300)] + [(500 + i, t) for i, t in enumerate(ODD_TEXTS)]
    docs += [(700 + i, docs[5][1]) for i in range(12)] + [(7, docs[7][1]), (None, docs[5][1]), (800, "w1 " * 3000)]
    items = [(i, text(12)) for i in range(8)] + [(20, docs[5][1]), (20, "É 1 日本"), (21, None), (22, "nowhere"), (None, "w1 w2 a")]
    assert searched(spark, docs, items, most, block_terms=40) == brute_search(docs, items, most)


def test_search_without_rows(spark):
    assert searched(spark, [], [(1, "a")], 5) == [] and searched(spark, [(1, "a")], [], 5) == [] and searched(spark, [(1, None)], [(1, "a"), (2, None)], 5) == []


def test_norms_beyond_64_bits():
    n = np.array([1, 10**9, 3], np.int64)
    c = lexical_search.Corpus(10**10, 10**13, {})
    assert c.norms(n).tolist() == [50 + 50 * k * 10**10 // 10**13 for k in n.tolist()]


# ---- vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """(id, code, error, label error, digest) of rows of one length."""
    kept = [(i, np.floor(np.array(v, float) * 256).astype(int), lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (math.inf if r[0] is None else r[0], r[1].tolist()))
    cut = lambda v: np.array_split(v, parts)
    books = [[p[k] for p in map(lambda r: cut(r[1]), order[:entries])] for k in range(parts)]
    near = lambda x, book: min((int(((x - e) ** 2).sum()), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                x = cut(v)[p]
                members[near(x, books[p])[1]].append(x)
            books[p] = [np.array([s // len(members[k]) for s in np.sum(members[k], 0).tolist()], int) if k in members else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e.tolist()).encode()).hexdigest()
    coded = [(i, [near(x, b) for x, b in zip(cut(v), books, strict=True)], lab) for i, v, lab in kept]
    sums = Counter()
    for _, c, lab in coded:
        sums[lab] += sum(d for d, _ in c)
    return sorted(((i, "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), sums[lab], digest) for i, c, lab in coded), key=str)


def compressed(spark, rows, **more):
    return sorted((tuple(r) for r in vector_codes.compress(vectors(spark, rows), **more).collect()), key=str)


@pytest.mark.parametrize("dim,n", [(32, 150), (16, 20), (20, 90), (7, 70)])
def test_codes_against_brute_force(spark, dim, n):
    """Ties in distance, copies, unused entries, few vectors, lengths that parts don't divide, rows without id or label."""
    rng = np.random.default_rng(dim)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, dim) / 256], int(i % 3) if i % 5 else None) for i in range(n)]
    rows += [(n + i, rows[2][1], 7) for i in range(20)] + [(2, rows[9][1], 1), (None, rows[4][1], None)] + [(500 + i, v, 1) for i, v in enumerate((None, [NAN] * dim, [INF] * dim))]
    rows += [(600, [float(x) for x in 50 * rng.standard_normal(dim)], 0)]
    assert compressed(spark, rows) == brute_codes(rows)


def test_codes_of_odd_tables(spark):
    assert compressed(spark, []) == [] and compressed(spark, [(1, None, 1)]) == []
    empty = hashlib.sha256(b"").hexdigest()
    assert compressed(spark, [(1, [], 1)]) == [(1, "00" * 16, 0, 0, empty)]
    # each length by itself; huge components are held in the bound
    rows = [(i, [float(i)] * 16, 1) for i in range(5)] + [(10 + i, [i / 8] * 32, 1) for i in range(5)]
    got = compressed(spark, rows)
    assert [r[1:3] + r[4:] for r in got] == [r[1:3] + r[4:] for r in sorted(brute_codes(rows[:5]) + brute_codes(rows[5:]), key=str)] and {r[3] for r in got} == {0}
    assert len(compressed(spark, [(i, [(-1.0) ** i * 1e300] * 16, 1) for i in range(4)])) == 4


def test_masks_give_the_nearest_entry():
    rng = np.random.default_rng(5)
    for scale in (2, 100, 10**8):
        book = vector_codes.Codebook(rng.integers(-scale, scale + 1, (64, 4)))
        x = np.concatenate((rng.integers(-2 * scale, 2 * scale + 1, (500, 4)), book.entries))
        far = np.square(x[:, None] - book.entries[None]).sum(2)
        index, distance = book.nearest(x)
        assert (index == far.argmin(1)).all() and (distance == far.min(1)).all()
        inside = book.inside(x, np.full(len(x), scale))
        want = (np.abs(x[:, None] - book.entries[None]).max(2) <= scale) @ (1 << np.arange(64, dtype=np.uint64))
        assert (inside == want).all()
