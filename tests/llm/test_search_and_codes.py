"""Hard negatives, decontamination and vector codes: brute force, and odd rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayline.llm import decontaminate, hard_negatives, vector_codes

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


def brute_hits(docs, items, window):
    """{(doc, text): [(n_words, n_hit, items)]} by comparing every place with every window."""
    windows = {}
    for name, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add("" if name is None else str(name))
    out = []
    for ident, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        out.append((ident, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def random_case(seed):
    r = random.Random(seed)
    vocabulary = ["a", "Bb", "c1", "dé", "ee", "f", "zz", "qq"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)).replace("f a", "f, A")
    items = [(i, text(r.choice([0, 1, 2, 5, 9, 30]))) for i in range(12)] + [(3, text(8)), (None, text(7)), (90, None), (91, " .,! ")]
    docs = [(i, text(r.choice([0, 3, 40, 120]))) for i in range(60)]
    docs += [(100 + i, text(10) + " " + (items[i][1] or "") + " " + text(10)) for i in range(12)]
    docs += [(200, None), (201, ""), (202, "...!"), (0, docs[0][1]), (0, docs[0][1]), (0, "other f a Bb"), (None, docs[3][1])]
    return docs, items


@pytest.mark.parametrize("seed,block_words,shard_words", [(1, 1 << 21, 1 << 20), (2, 40, 1 << 20), (3, 25, 64), (4, 1 << 21, 50)])
def test_hits_against_brute_force(spark, seed, block_words, shard_words):
    docs, items = random_case(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("id", "item", "n_hit", "hits", "rk")})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontaminate.classify(d, b, window=4, block_words=block_words, shard_words=shard_words).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got], key=str) == brute_hits(docs, items, 4)
    for r in got:
        assert r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() and r.contaminated == (r.n_hit > 0)
    clean = decontaminate.decontaminate(d, b, window=4, block_words=block_words, shard_words=shard_words)
    assert clean.columns == d.columns
    assert sorted([r.doc_id for r in clean.collect()], key=str) == sorted([i for i, _, n, _ in brute_hits(docs, items, 4) if n == 0], key=str)


def test_longest_matches(spark):
    docs, items = random_case(7)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([x for x in items if x[0] not in (3, None)], "item_id long, text string")
    texts = [words_of(t) for _, t in docs]
    for r in decontaminate.longest_matches(d, b, window=2).collect():
        w = words_of(dict(items)[int(r["item"])])
        fits = lambda n, t: any(t[p : p + n] == w[i : i + n] for i in range(len(w) - n + 1) for p in range(len(t) - n + 1))
        assert any(fits(r.length, t) for t in texts) and not any(fits(r.length + 1, t) for t in texts if r.length < len(w))
        assert any(i == r.doc_id and words_of(t)[r.doc_word : r.doc_word + r.length] == w[r.item_word : r.item_word + r.length] for i, t in docs)


def test_decontamination_of_odd_tables(spark):
    d = spark.createDataFrame([("a", "one two three"), ("b", None)], "doc_id string, text string")
    b = spark.createDataFrame([("q", "one two three")], "item_id string, text string")
    assert {(r.doc_id, r.n_hit) for r in decontaminate.classify(d, b).collect()} == {("a", 3), ("b", 0)}
    assert decontaminate.classify(d, b.limit(0)).where("contaminated").count() == 0 and decontaminate.classify(d, b.limit(0)).count() == 2
    assert decontaminate.classify(d.limit(0), b).count() == 0 and decontaminate.longest_matches(d, b.limit(0)).count() == 0


def test_a_very_long_text_is_hashed_in_pieces(spark):
    text = " ".join(f"Word{i % 977}é" for i in range(900_000)) + " x" * 5 + "y" * 70_000
    (first, end, h, counts), = decontaminate.hashed_words(pa.array([text]))
    (_, _, small, _), = decontaminate.hashed_words(pa.array([" ".join(f"word{i}é" for i in range(977))]))
    assert (first, end, counts.tolist()) == (0, 1, [900_005]) and (h[:977] == small).all() and (h[977 * 500 : 977 * 501] == small).all()
    d = spark.createDataFrame([(1, text), (2, "no")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "x x x x x" + "y" * 70_000), (2, "word975é word976é word0é")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.classify(d, b, shard_words=100_000).collect()}
    assert got == {1: (5 + 3 * 921, ["1", "2"]), 2: (0, [])}


def whole(v, scale):
    return [int(np.floor(scale * float(x))) for x in v]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_negatives(rows, anchors, k=5, m=10):
    rows = [(i, whole(v, 256), y) for i, v, y in rows if i is not None and y is not None and usable(v)]
    own = {}
    for i, v, y in rows:
        if anchors(i):
            own[i] = min(own.get(i, (v, y)), (v, y))
    out = set()
    for a, (va, ya) in own.items():
        met = sorted((-sum(x * y for x, y in zip(va, v)), i, y) for i, v, y in rows if i != a and len(v) == len(va))
        for n, (s, p, _) in enumerate([x for x in met if x[2] == ya][:k]):
            ok = [x for x in met if x[2] != ya and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
            out |= {(a, p, n + 1, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(ok)}
    return out


def vectors(seed, n, dims=11):
    g = np.random.default_rng(seed)
    rows = [(i, g.normal(0.3, 0.5, dims).astype(np.float32).tolist(), f"c{int(g.integers(4))}") for i in range(n)]
    rows += [(i + n, rows[i % 7][1], rows[i % 5][2]) for i in range(40 if n > 40 else 0)]  # ties and a group of copies
    rows += [(0, rows[n // 2][1], "c1"), (None, rows[1][1], "c1"), (900, None, "c1"), (901, [None] * dims, "c1"), (902, [float("nan")] * dims, "c1"), (903, [float("inf")] * dims, "c2")]
    return rows + [(904, rows[2][1], None), (910, [0.5, 0.25], "c1"), (920, [0.5, 0.5], "c1"), (921, [0.25, 0.5], "c2"), (930, [], "c1"), (931, [], "c1"), (932, [], "c2"), (940, [300000.0] * dims, "c0")]


@pytest.mark.parametrize("seed", [1, 2])
def test_negatives_against_brute_force(spark, seed, monkeypatch):
    rows = vectors(seed, 150)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").withColumns({"id": F.lit(1), "slot": F.lit(2), "rank": F.lit("x")})
    monkeypatch.setattr(hard_negatives, "BATCH", 20 if seed == 1 else 4096)
    got = {tuple(r) for r in hard_negatives.mine(df, F.col("id") % 5 == 0).collect()}
    assert got == brute_negatives(rows, lambda i: i % 5 == 0) and len(got) > 300


def test_scores_by_lookups():
    g = np.random.default_rng(5)
    for dims, top in ((1, 3), (8, 1), (13, 1 << 20), (64, 300), (3, 1 << 27)):
        a, c = g.integers(-top, top + 1, (9, dims)), g.integers(-top, top + 1, (20, dims))
        assert (hard_negatives.scores(hard_negatives.planes(c), hard_negatives.subset_sums(a), slice(0, 20)) == c @ a.T).all()


def test_best_keeps_the_first(monkeypatch):
    monkeypatch.setattr(hard_negatives, "HELD", 50)
    r, best, rows = random.Random(3), hard_negatives.Best(4, 3), []
    for _ in range(40):
        part = np.array([(r.randrange(4), r.randrange(10**6), r.randrange(9)) for _ in range(17)])
        rows += part.tolist()
        best.add(*part.T)
    want = [x for s in range(4) for x in sorted((x for x in rows if x[0] == s), key=lambda x: (-x[2], x[1]))[:3]]
    assert best.cut().T.tolist() == want


def test_negatives_of_empty_tables(spark):
    df = spark.createDataFrame([(1, [1.0], "a")], "vec_id long, embedding array<float>, label string")
    assert hard_negatives.mine(df.limit(0), F.col("id") > 0).count() == 0 and hard_negatives.mine(df, F.col("id") > 5).count() == 0 and hard_negatives.mine(df, F.col("id") > 0).count() == 0


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = [(i, whole(v, 4096), y) for i, v, y in rows if usable(v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    rows = [r for r in rows if len(r[1]) == len(rows[0][1])]
    at = vector_codes.cuts(len(rows[0][1]), parts)
    x = [np.array([r[1][a:b] for r in rows], np.int64).reshape(len(rows), b - a) for a, b in zip(at[:-1], at[1:])]
    books = [p[:entries].copy() for p in x]
    near = lambda p, b: (far := ((p[:, None, :] - b[None]) ** 2).sum(-1)).argmin(1) if True else far
    for _ in range(rounds):
        for p, b in zip(x, books):
            own = near(p, b)
            for e in range(len(b)):
                if (own == e).any():
                    b[e] = p[own == e].sum(0) // (own == e).sum()
    codes = np.stack([near(p, b) for p, b in zip(x, books)], axis=1)
    error = sum(((p - b[c]) ** 2).sum(1) for p, b, c in zip(x, books, codes.T))
    by = {}
    for (_, _, y), e in zip(rows, error.tolist()):
        by[y] = by.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    return sorted([(i, y, "".join(f"{c:02x}" for c in code), e, by[y], digest) for (i, _, y), code, e in zip(rows, codes.tolist(), error.tolist())], key=str)


@pytest.mark.parametrize("seed,n,dims,entries", [(1, 400, 16, 16), (2, 300, 11, 5), (3, 30, 8, 16), (4, 3, 24, 16), (5, 250, 3, 40), (6, 600, 16, 2)])
def test_codes_against_the_plain_method(spark, seed, n, dims, entries):
    rows = [r for r in vectors(seed, n, dims) if r[0] not in (930, 931, 932, 940)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").withColumns({"id": F.lit(1), "code": F.lit(2), "state": F.lit("x")})
    got = vector_codes.compress(df.repartition(3), entries=entries)
    assert sorted([(r.vec_id, r.label, *tuple(r)[2:]) for r in got.collect()], key=str) == plain_codes(rows, entries=entries)


def test_codes_of_large_components_and_of_none(spark):
    g = np.random.default_rng(3)
    rows = [(i, (g.normal(0, 1, 16) * 10 ** g.integers(0, 4)).tolist(), None if i % 3 else 7) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted([tuple(r) for r in vector_codes.compress(df).collect()], key=str) == plain_codes(rows)
    assert vector_codes.compress(df.limit(0)).count() == 0
    none = vector_codes.compress(spark.createDataFrame([(1, [], 1), (2, [], 2)], "vec_id long, embedding array<float>, label int")).collect()
    assert [(r.code, r.error) for r in none] == [("00" * 8, 0)] * 2


def test_bounds_settle_most_rows():
    """The bounds spare distances, and the lists follow what is needed."""
    g = np.random.default_rng(1)
    x = np.concatenate([g.normal(c, 20, (500, 4)) for c in g.normal(0, 3000, (16, 4))]).astype(np.int64)
    book = x[::500].copy()
    bounds = vector_codes.Bounds.blank(len(x), 4)
    assert bounds.assign(x, book)[-1] == len(x)
    moved = book + g.integers(-5, 6, book.shape)
    bounds.moved(np.sqrt(((moved - book) ** 2).sum(1)) * (1 + 1e-6))
    used = bounds.assign(x, moved)
    assert used[0] > 0.95 * len(x) and (bounds.order[:, 0] == vector_codes.squared(x, moved).argmin(1)).all()
    assert vector_codes._listed(used, 4, 16) == 2 and vector_codes._listed(np.array([0, 0, 0, 50, 50]), 3, 16) == 4
