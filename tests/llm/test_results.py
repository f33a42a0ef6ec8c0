"""Results against brute force, exact round trips and held-out labels."""

import collections
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from wayline.llm import components, exact_dedup, html_text, mixing, ngram_join, packing, suffix_dedup, topk_search
from wayline.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def brute_substrings(rows, length):
    seen = collections.Counter()
    raw = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raw:
        seen.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "kgram", "shard"), [(40, 12, 8), (40, 30, 1024), (25, 10, 4)])
def test_suffix_dedup(spark, length, kgram, shard):
    r = random.Random(3)
    letters = "abcdefgh é"
    base = ["".join(r.choice(letters) for _ in range(r.randrange(5, 300))) for _ in range(20)]
    part = lambda: r.choice(base)[r.randrange(0, 40) : r.randrange(20, 250)] + "".join(r.choice(letters) for _ in range(r.randrange(0, 30)))
    rows = [(i, "".join(part() for _ in range(r.randrange(0, 5)))) for i in range(100)]
    rows += [(1000, None), (1001, ""), (1002, "ab" * 300), (1003, "a" * 500), (7, rows[7][1]), (None, rows[9][1])]
    noise = lambda: "".join(r.choice(letters) for _ in range(60))
    rows += [(2000 + i, noise() + base[0][:60] + noise()) for i in range(60)]  # one anchor over several shards
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.dedup_substrings(df, length=length, kgram=kgram, shard=shard, with_text=False).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_substrings(rows, length)


def test_suffix_dedup_in_slices_and_parts(spark):
    """Long documents come in overlapping slices, and one anchor's fingerprints in several parts."""
    r = random.Random(8)
    base = "".join(r.choice("abcdefgh") for _ in range(300))
    noise = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    rows = [(i, noise(60) + base[: r.randrange(50, 90)] + noise(r.randrange(20, 200))) for i in range(80)]
    rows += [(500, noise(900) + base + noise(700) + base[40:200]), (501, base[20:] * 6), (502, noise(2000)), (None, noise(50) + base[:70])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for merge_rows, slice_bytes in [(50, 150), (1 << 20, 64), (7, 1 << 20)]:
        got = suffix_dedup.dedup_substrings(df, length=40, kgram=12, shard=8, with_text=False, merge_rows=merge_rows, slice_bytes=slice_bytes).collect()
        assert sorted((tuple(x) for x in got), key=str) == brute_substrings(rows, 40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.sampled_from([4, 8, 9, 16]))
def test_suffix_groups(texts, length):
    raw = [t.encode() for t in texts if t] or [b"a"]
    bounds = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    at, group = suffix_dedup.repeated_groups(data, bounds, length)
    strings = {}
    for p, g in zip(at.tolist(), group.tolist()):
        strings.setdefault(g, set()).add(bytes(data[p : p + length]))
    assert all(len(x) == 1 for x in strings.values()) and len({next(iter(x)) for x in strings.values()}) == len(strings)
    assert len(at) == sum(max(0, len(x) - length + 1) for x in raw)


def brute_components(rows, width, share):
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = frozenset(zip(*[w[k:] for k in range(width)])) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "share"), [(3, 90), (5, 80), (2, 60)])
def test_near_duplicates(spark, width, share):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    common = [r.choice(vocabulary) for _ in range(12)]
    rows = []
    for family in range(6):
        base = [r.choice(vocabulary) for _ in range(r.randrange(20, 120))]
        for _ in range(r.choice([2, 5, 40])):
            copy = [x if r.random() > 0.01 * family else r.choice(vocabulary) for x in base]
            rows.append((len(rows), " ".join(copy + (common if r.random() < 0.3 else []))))
    rows += [(len(rows) + i, " ".join([r.choice(vocabulary) for _ in range(30)] + common)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.near_duplicates(df, width=width, share=share).collect()}
    assert got == brute_components(rows, width, share)


def test_connected_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_hot_copies(spark):
    """A text with many copies is cut into pieces; the pieces' winners meet again."""
    rows = [(i, "same text" + " " * (i % 7)) for i in range(400)] + [(1000 + i, f"text {i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect()}
    assert {got[i] for i in range(400) if i != 6} == {(6, 400, False)} and got[6] == (6, 400, True)
    assert all(got[1000 + i] == (1000 + i - i % 2, 2, i % 2 == 0) for i in range(600))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60))
def test_packing(lengths):
    sequences = packing.pack_run(lengths, 64)
    pieces = sorted((d, s, n) for q in sequences for d, s, n in q)
    at = dict.fromkeys(range(len(lengths)), 0)
    for d, s, n in pieces:
        assert at[d] == s and n > 0
        at[d] += n
    assert [at[i] for i in range(len(lengths))] == lengths
    assert all(sum(n for _, _, n in q) <= 64 for q in sequences)


def test_best_fit_takes_the_tightest():
    assert packing.best_fit_decreasing([6, 5, 4, 3, 2], 10) == [[0, 2], [1, 3, 4]]
    r = random.Random(1)
    lengths = [r.randrange(1, 4097) for _ in range(3000)]
    windows = packing.best_fit_decreasing(lengths)
    assert sum(lengths) / (4096 * len(windows)) > 0.97


@pytest.mark.parametrize("length", [2100, 3000, 3900])
def test_packing_of_equal_lengths(length):
    """What is left of cut windows is packed together, so documents of one length need next to no padding."""
    sequences = packing.pack_run([length] * 500)
    pieces = sorted((d, s, n) for q in sequences for d, s, n in q)
    assert [sum(n for d, _, n in pieces if d == i) for i in range(500)] == [length] * 500
    used = [sum(n for _, _, n in q) for q in sequences]
    assert sum(4096 - n for n in used if n & (n - 1)) < 0.01 * 500 * length


def test_packing_padding(spark):
    pieces = QUERIES["op8_packing"].run(spark, SF).toPandas()
    used = pieces.groupby("sequence_id").length.sum()
    padding = sum(4096 - n for n in used if n & (n - 1))
    assert padding < 0.01 * used.sum()


@pytest.mark.parametrize("seed", range(4))
def test_search_is_exact(spark, seed):
    r = np.random.default_rng(seed)
    v = r.normal(size=(300, 8)) * (10.0**seed if seed else 1)
    v[::7] = v[0]
    v[::11] = 0
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(300), "embedding": v.tolist()}))
    got = sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in topk_search.search(df, F.col("id") % 50 == 0, scale=256).collect())
    whole = np.floor(v * 256).astype(np.int64)
    want = []
    for q in range(0, 300, 50):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(300), -s)) if i != q][:5]
        want.extend((q, k + 1, int(i), int(s[i])) for k, i in enumerate(order))
    assert got == want


def test_block_stops_on_proof():
    r = np.random.default_rng(0)
    v = np.floor(r.normal(size=(2000, 16)) ** 3 * 50)
    block = topk_search.Block(np.arange(2000), v)
    for q in range(20):
        member, done = block.members(v[q], np.array([q]), 5, -np.inf)
        exact = v @ v[q]
        exact[q] = -np.inf
        assert set(np.argsort(-exact)[:5]) <= set(member.tolist())
        assert done < np.count_nonzero(v) and len(member) <= 40
        assert block.scores(v[q], member) == exact[member].tolist()


def test_block_stops_on_given_table(spark):
    """Every query of the given table ends before its postings do."""
    rows = topk_search.quantised(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding", 256).toPandas()
    block = topk_search.Block(rows.id.to_numpy(), np.stack(rows.v))
    asked = np.flatnonzero(block.ids % 50 == 0)
    assert all(block.members(block.vectors[q], np.array([q]), 5, -np.inf)[1] < 0.95 * len(block.place) for q in asked)


def test_search_in_batches_with_repeated_ids(spark):
    r = np.random.default_rng(5)
    rows = [(int(i) % 90, r.integers(-9, 9, 6).astype(float).tolist()) for i in range(200)] + [(3, [1.0]), (50, [2.0]), (60, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).withColumns({c: F.lit("x") for c in ("id", "v", "rank", "score")})
    whole = [(i, np.floor(np.array(v) * 256).astype(int)) for i, v in rows]
    asked = {i: min([v.tolist() for j, v in whole if j == i]) for i in range(0, 90, 10)}
    want = []
    for i, q in asked.items():
        scored = sorted((-int(v @ np.array(q, int)), j) for j, v in whole if j != i and len(v) == len(q))[:5]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    got = topk_search.search(df, F.col("id") % 10 == 0, batch_values=20).collect()
    assert sorted((x.query_id, x["rank"], x.vec_id, x.score) for x in got) == sorted(want)


def test_toxicity_held_out(spark):
    found = QUERIES["op3_toxicity"].run(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    held = found[found.held_out].merge(labels, on="doc_id")
    caught = ((held.predicted == 1) & (held.toxic == 1)).sum()
    assert len(found) == 10_000 and caught / held.predicted.sum() > 0.9 and caught / held.toxic.sum() > 0.75


def test_language_held_out(spark):
    found = QUERIES["op5_language_id"].run(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    held = found[found.held_out].merge(docs, on="doc_id")
    assert len(found) == 1000 and (held.lang == held.lang_pred).mean() > 0.98


def test_html_markup(spark):
    """On the given pages the network agrees with their own markup; on rewritten ones with what was rewritten."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("html").toPandas().html.tolist()
    net = html_text.train(pages[:120])
    blocks = [html_text.blocks_of(p) for p in pages[120:]]
    want = [np.array([html_text.markup_says(b) for b in p]) for p in blocks]
    got = html_text.label_pages(blocks, net)
    assert np.mean([(a == b).all() for a, b in zip(got, want)]) > 0.97
    rng = random.Random(9)
    texts = [b.text for p in blocks[:40] for b in p]
    made = [html_text.rewritten(p, list(w), texts, rng) for p, w in zip(blocks[40:], want[40:])]
    got = html_text.label_pages([p for p, _ in made], net)
    assert np.mean(np.concatenate(got) == np.concatenate([m for _, m in made])) > 0.97


def test_gradients():
    """Back-propagation against differences of the loss."""
    rng = np.random.default_rng(1)
    net = html_text.Network.fresh(5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(4, 3, 5))
    mask = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], bool)
    y = (rng.random((4, 3)) > 0.5).astype(float)

    def loss():
        p = net.probabilities(x, mask)
        return -(np.log(np.where(y > 0, p, 1 - p)) * mask).sum() / mask.sum()

    g = net.gradients(x, mask, y)
    for k in net.p:
        flat = net.p[k].reshape(-1)
        at = int(rng.integers(len(flat)))
        old, step = flat[at], 1e-4
        flat[at] = old + step
        up = loss()
        flat[at] = old - step
        down = loss()
        flat[at] = old
        assert abs((up - down) / (2 * step) - np.asarray(g[k]).reshape(-1)[at]) < 1e-3


@pytest.mark.parametrize("most", [None, 1.0])
def test_mixing_meets_targets(spark, most):
    r = random.Random(2)
    rows = [(i, r.randrange(50, 500), [p, 1 - p]) for i in range(400) for p in [r.choice([0.02, 0.5, 0.97])]]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, posteriors array<double>")
    solution = mixing.solve(members, ["a", "b"], {"a": 0.7, "b": 0.3}, most)
    got = mixing.with_rates(members, solution).toPandas()
    assert (got.rate >= 0).all() and (most is None or (got.rate <= most).all())
    a = sum(t * q * p[0] for t, p, q in zip(got.tokens, got.posteriors, got.rate))
    b = sum(t * q * p[1] for t, p, q in zip(got.tokens, got.posteriors, got.rate))
    assert abs(a / (a + b) - 0.7) < 0.02


@pytest.mark.parametrize("share", [0.01, 0.003])
def test_mixing_scarce_domain(spark, share):
    """A domain with a hundredth of the tokens reaches its tenth, though other documents seem to hold a little of it."""
    r = random.Random(3)
    rows = [(i, r.randrange(50, 500), [1 - p, p]) for i in range(4000) for p in [0.9 if i % round(1 / share) == 0 else 0.005]]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, posteriors array<double>")
    solution = mixing.solve(members, ["a", "b"], {"a": 0.9, "b": 0.1})
    got = mixing.with_rates(members, solution).toPandas()
    held = np.array([t * q * np.array(p) for t, p, q in zip(got.tokens, got.posteriors, got.rate)]).sum(axis=0)
    assert (got.rate >= 0).all()
    assert held / sum(t for _, t, _ in rows) == pytest.approx([0.9, 0.1], abs=1e-3)
    assert solution.settled


def dense_totals(n, p, targets, low, high, rounds=200_000):
    """Expected totals by plain accelerated projected gradient on the rates themselves, in the operator's metric."""
    total = n.sum()
    metric = np.linalg.pinv((p * n[:, None]).T @ p / total + mixing.RIDGE * ((p * n[:, None]) * p).sum() / total * np.eye(p.shape[1]), hermitian=True)
    x = last = np.clip(np.ones(len(n)), low, high)
    t = 1.0
    for _ in range(rounds):
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = x + (t - 1) / u * (x - last)
        step = np.clip(y - p @ (metric @ ((n * y) @ p - targets) / total), low, high)
        t = 1.0 if (y - step) @ (step - x) > 0 else u
        moved = np.abs(step - x).max()
        x, last = step, x
        if moved < 1e-13:
            break
    return (n * x) @ p


@pytest.mark.parametrize(("domains", "most"), [(2, None), (3, None), (4, 1.0), (3, 2.0)])
def test_mixing_against_dense_solver(spark, domains, most):
    """Domains of a hundredth and of three thousandths of the tokens, targets in and out of reach."""
    r = np.random.default_rng(domains)
    share = np.array([0.987, 0.01, 0.003, 0.0][:domains])
    kind = r.choice(domains, 1500, p=share / share.sum())
    p = r.dirichlet(np.full(domains, 0.3), 1500) * 0.2 + np.eye(domains)[kind] * 0.8
    n = r.integers(20, 400, 1500)
    names = list("abcd")[:domains]
    weights = dict(zip(names, [0.5, 0.3, 0.2, 0.4]))
    members = spark.createDataFrame([(int(x), y.tolist()) for x, y in zip(n, p)], "tokens long, posteriors array<double>")
    solution = mixing.solve(members, names, weights, most)
    want = dense_totals(n.astype(float), p, solution.targets, 0.0, np.inf if most is None else most)
    assert solution.settled and (solution.rates(p) >= 0).all()
    assert solution.expected == pytest.approx((n * solution.rates(p)) @ p)
    assert solution.expected / n.sum() == pytest.approx(want / n.sum(), abs=2e-4)


def test_mixing_deals_repeats(spark):
    """A document that is repeated some hundred times is written by several tasks, as often as its rate says."""
    rows = [(i, " ".join(["good words here"] * 20)) for i in range(300)] + [(1000, "poor bad text")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "good") for i in range(100)] + [(1000, "poor")], "doc_id long, domain string")
    mixed = mixing.mixed_rows(df, labels, {"good": 0.9, "poor": 0.1}, least=1.0)
    n = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert len(n) == 301 and n[1000] > 4 * mixing.REPEATS and mixed.columns == df.columns
    assert 3 * n[1000] / (3 * n[1000] + sum(60 * c for i, c in n.items() if i < 1000)) > 0.09
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be put together again
    try:
        assert mixed.where("doc_id = 1000").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("share", [0.3, 0.05, 0.003])
def test_mixing_keeps_everything(spark, share):
    """With a least rate of 1 nothing goes, whichever domain is the scarcer one."""
    r = random.Random(4)
    rows = [(i, r.randrange(50, 500), [1 - p, p]) for i in range(4000) for p in [0.9 if i % round(1 / share) == 0 else 0.005]]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, posteriors array<double>")
    got = mixing.with_rates(members, mixing.solve(members, ["a", "b"], {"a": 0.9, "b": 0.1}, least=1.0)).toPandas()
    held = np.array([t * q * np.array(p) for t, p, q in zip(got.tokens, got.posteriors, got.rate)]).sum(axis=0)
    assert got.rate.min() >= 1
    assert held / held.sum() == pytest.approx([0.9, 0.1], abs=1e-3)


def test_mixing_stage_keeps_clean_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mixed = dict(corpus_pipeline.STAGES)["mixing"](spark, docs, "/root/testdata/sf0.001")
    assert {r.doc_id for r in mixed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_mixing_says_what_is_missed(spark):
    rows = [(i, 100, [0.99, 0.01]) for i in range(50)]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, posteriors array<double>")
    with pytest.warns(UserWarning, match="missed"):
        mixing.solve(members, ["a", "b"], {"a": 0.5, "b": 0.5})


def test_pipeline_stages(spark):
    """Each stage of the pipeline against brute force on its own input."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf = "/root/testdata/sf0.001"
    steps = dict(corpus_pipeline.STAGES)
    clean = steps["toxicity"](spark, docs, sf)
    assert 150 < clean.count() <= 200
    once = steps["exact_dedup"](spark, clean, sf)
    best = {}
    for r in clean.collect():
        key = "".join((r.text or "").split())
        best[key] = min(best.get(key, (0, 1 << 60)), (-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in once.collect()} == {i for _, i in best.values()}
    near = steps["ngram_jaccard_join"](spark, once, sf)
    groups = brute_components([(r.doc_id, r.text) for r in once.collect()], 5, 80)
    assert {r.doc_id for r in near.collect()} == {root for _, root in groups.values()}
    mixed = steps["mixing"](spark, near, sf)
    ids = [r.doc_id for r in mixed.collect()]
    # Every clean document stays; those of the scarcer domain are repeated.
    assert set(ids) == {r.doc_id for r in near.collect()} and len(ids) >= len(set(ids))
    assert {r.doc_id for r in steps["packing"](spark, mixed, sf).collect()} == set(ids)
