"""Near duplicates, components and top-k search against brute force."""

import collections
import random
import re

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from millrace.llm import near_dup, topk, vectors  # noqa: E402
from millrace.llm.common import Scratch  # noqa: E402
from millrace.llm.graph import components  # noqa: E402




def similarity(texts):
    split = re.compile(rb"[a-z0-9\x80-\xff]+")
    told = [split.findall((t or "").lower().encode()) for t in texts]
    df = collections.Counter(w for ws in told for w in set(ws))
    idf = {w: 1 + np.log((1 + len(told)) / (1 + c)) for w, c in df.items()}
    bags = []
    for ws in told:
        bag = collections.Counter()
        for i in range(len(ws) - 4):
            bag[tuple(ws[i : i + 5])] += np.mean([idf[w] for w in ws[i : i + 5]])
        if 0 < len(ws) < 5:
            bag[tuple(ws)] += np.mean([idf[w] for w in ws])
        bags.append(bag)

    def sim(a, b):
        both = sum(min(x, bags[b][k]) for k, x in bags[a].items() if k in bags[b])
        whole = sum(bags[a].values()) + sum(bags[b].values()) - both
        return both / whole if whole else 0.0

    return sim, bags


def expected(ids, texts, sim, bags, threshold=0.8):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for k, bag in enumerate(bags):
        for s in bag:
            holders[s].append(k)
    for a, b in {(a, b) for v in holders.values() for a in v for b in v if a < b}:
        if sim(a, b) >= threshold:
            x, y = find(ids[a]), find(ids[b])
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def made_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7)))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    for base in (texts[3], texts[40]):  # a large group of near copies, each another edit
        words = base.split()
        for _ in range(70):
            w = list(words)
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    passage = " ".join(word() for _ in range(60))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randrange(20, 90))) for _ in range(60)]
    texts += [texts[5].upper() + "!", texts[5], texts[5], "", None, "   ", "...", "one", "One.", "x " * 3000, "long " * 9 + "w" * 5000]
    return texts


@pytest.mark.parametrize("crowd", [16, 2])
def test_near_duplicates_against_all_pairs(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_dup, "CROWD", crowd)
    monkeypatch.setattr(near_dup, "TILE", 8 * crowd)
    monkeypatch.setattr("millrace.llm.common.FEW", 250 if crowd > 2 else 1)  # 1: keys with a thousandth of the rows are broadcast
    texts = made_texts()
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] + [(None, texts[5], "c"), (5, texts[5], "c")], "doc_id long, text string, class_id string")
    sim, bags = similarity([t for t in texts] + [texts[5], texts[5]])
    want = expected(list(range(len(texts))), texts, sim, bags[: len(texts)])
    rows = near_dup.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 2
    assert all(r["kept"] and r["class_id"] is None for r in rows if r["doc_id"] is None)
    got = {r["doc_id"]: r["class_id"] for r in rows if r["doc_id"] is not None}
    assert got == want
    kept = near_dup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted([i for i, c in want.items() if i == c] + [5] * (want[5] == 5))
    assert near_dup.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("crowd", [16, 2])
def test_an_id_with_different_texts_stands_for_each(spark, monkeypatch, crowd):
    monkeypatch.setattr(near_dup, "CROWD", crowd)
    monkeypatch.setattr(near_dup, "TILE", 8 * crowd)
    rng = random.Random(5)
    texts = [[f"{c}{rng.randrange(10**6)}" for _ in range(80)] for c in "abc"]
    a, b, c = (" ".join(t) for t in texts)
    near = [[" ".join([*t[:k], "other", *t[k + 1 :]]) for k in (0, 79)] for t in texts]
    rows = [(2, near[0][0]), (5, a), (5, b), (8, b), (9, near[1][0]), (11, near[1][1]), (5, c), (12, near[2][0]), (13, near[2][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["id"], r["th"], r["class_id"]) for r in near_dup.groups(docs).collect())
    of = [2, 2, 5, 5, 5, 5, 5, 5, 5]
    th = [r[0] for r in docs.selectExpr("xxhash64(text)").collect()]
    assert got == sorted((i, h, g) for (i, _), h, g in zip(rows, th, of))
    assert sorted(near_dup.one_of_each(docs).collect()) == sorted([(2, near[0][0]), (5, b), (5, c)])


def test_layout_follows_the_threshold():
    for threshold in (0.5, 0.7, 0.8, 0.9, 1.0):
        bands, rows, least = near_dup.layout(threshold)
        assert 1 - (1 - threshold**rows) ** bands >= 0.997 and bands * rows <= 64 and least <= threshold * bands * rows
    assert near_dup.layout(0.8) == (12, 4, 24)


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_other_thresholds(spark, threshold):
    texts = made_texts()
    sim, bags = similarity(texts)
    want = expected(list(range(len(texts))), texts, sim, bags, threshold)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), threshold=threshold).collect()}
    assert sum(got[i] != want[i] for i in want) <= 0.02 * len(want)


def test_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    sampler = near_dup.Sampler(400)
    codes = np.sort(rng.integers(0, 2**63, 900).astype("u8"))
    a, b = codes[:700], codes[200:]
    weights = rng.gamma(2, 1, 900)
    wa, wb = weights[:700], weights[200:] * rng.choice([1.0, 1.3], 700)
    got = [sampler(c, w, np.asarray([0, len(c)]))[0] for c, w in ((a, wa), (b, wb))]
    assert abs((got[0] == got[1]).mean() - near_dup.weighted_jaccard((a, wa), (b, wb))) < 0.08


def test_tile_equals_pairs():
    rng = np.random.default_rng(3)
    bags = []
    for _ in range(40):
        codes = np.sort(rng.choice(60, rng.integers(0, 50), replace=False)).astype("u8")
        bags.append((codes, (1 + codes % 7) * rng.integers(1, 4, len(codes)) * 1.0))
    begins = np.cumsum([0, *[len(c) for c, _ in bags]])
    got = near_dup.similarities(np.concatenate([c for c, _ in bags]), np.concatenate([w for _, w in bags]), begins, columns=7)
    want = [[near_dup.weighted_jaccard(x, y) for y in bags] for x in bags]
    off = ~np.eye(40, dtype=bool)
    assert np.allclose(got[off], np.asarray(want)[off])


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(None, 1), (7, 7), (3, 2), (900, 900)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark)).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark)).count() == 0


def odd_vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 16)).astype("f4")
    near = [x[3] + rng.standard_normal(16) * 0.05 for _ in range(60)] + [x[9] * s for s in (2, 1e-3, 1e3)] + [x[9]] * 3
    rows = [(i, v.tolist(), "z") for i, v in enumerate(np.concatenate([x, np.asarray(near, "f4")]))]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [3.0, 6.1]]
    rows += [(1000 + i, v, "z") for i, v in enumerate(bad)] + [(None, x[3].tolist(), "z"), (3, x[3].tolist(), "z")]
    return rows, "vec_id long, embedding array<float>, n_links string"


def sound(v, zero=False):
    return v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and (zero or any(v))


def test_near_vectors_against_all_pairs(spark):
    rows, schema = odd_vectors()
    got = vectors.near_vectors(spark.createDataFrame(rows, schema)).collect()
    good = [(i, np.asarray(v, "f8")) for i, v, _ in rows if i is not None and sound(v)]
    n, root = collections.Counter(), {i: i for i, *_ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v) in enumerate(good):
        for j, w in good[k + 1 :]:
            if len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.95:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    assert len(got) == len(rows) - 1
    want = {i: (n[i], find(i)) for i in root}
    want[3] = (n[3] // 2, find(3))  # its two rows are copies of one another
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("spread", [1.0, 0.35])
def test_near_vectors_recall_on_planted_pairs(spark, spread):
    """12,000 vectors of 64 dimensions, 1,500 pairs just above the threshold; with spread below 1 all share a direction."""
    rng = np.random.default_rng(12)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    shared = np.zeros(64) if spread == 1.0 else 3 * np.ones(64) / 8
    x = unit(rng.standard_normal((10_500, 64)) * (1.0 if spread == 1.0 else spread * 1.2) + shared)
    w = rng.standard_normal((1500, 64))
    w = unit(w - (w * x[:1500]).sum(1, keepdims=True) * x[:1500])
    c = rng.uniform(0.9505, 0.96, (1500, 1))
    x = np.concatenate([x, c * x[:1500] + np.sqrt(1 - c * c) * w])
    n = (x @ x.T >= 0.95).sum(1) - 1
    assert n[:1500].min() >= 1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(rows).collect()}
    assert all(got[i] <= n[i] for i in got) and sum(got.values()) >= 0.99 * n.sum()


def test_near_vectors_with_a_repeated_id(spark):
    rng = np.random.default_rng(13)
    a, b = rng.standard_normal((2, 16)).tolist()
    near = lambda v: [c + 1e-3 for c in v]
    df = spark.createDataFrame([(5, a), (5, b), (2, near(a)), (8, near(b)), (8, near(b))], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, vectors.near_vectors(df).collect()))
    assert got == sorted([(5, 1, 2, False), (5, 2, 5, True), (2, 1, 2, True), (8, 2, 5, False), (8, 2, 5, False)])


def test_layout_grows_with_the_logarithm():
    widths = [vectors.layout(n, vectors.agreement(0.95)) for n in (10, 1000, 10**5, 10**9)]
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(widths, widths[1:])) and widths[-1][0] < 30


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_k_against_all_products(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "QUERIES", 7)
    monkeypatch.setattr(topk, "LOOK", 100)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 8)) * np.exp(spread * rng.standard_normal((600, 1)))
    x[100:300] = x[:200] * 1.02
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x.astype("f4"))]
    rows += [(700, None, "z"), (720, [float("nan")] * 8, "z"), (740, [0.0] * 8, "z"), (760, [1.0, 2.0], "z"), (761, [1.0, 3.0], "z"), (None, [1.0] * 8, "z"), (780, [3e9] * 8, "z"), (20, [0.5] * 8, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id % 20 = 0 and vec_id <> 20"), k=20).collect())
    good = [(i, [int(np.floor(64 * float(np.float32(c)))) for c in v]) for i, v, _ in rows if i is not None and sound(v, True)]
    want = []
    for q, v in good:
        if q % 20 == 0 and q != 20:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:20]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert got == sorted(want)
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


@pytest.mark.parametrize("d", [1, 2, 3, 64])
def test_survivors_hold_all_that_reach_the_floor(d):
    rng = np.random.default_rng(d)
    x = rng.standard_normal((2000, d))
    x[:, 0] = rng.choice([-1, 1], 2000) * (1 + rng.random(2000)) * np.linalg.norm(x, axis=1)
    x = np.floor(64 * x)
    lens = np.linalg.norm(x, axis=1)
    order = np.argsort(-lens)
    x, lens = x[order], lens[order]
    for i in range(0, 2000, 40):
        scores = np.delete(x @ x[i], i)
        floor = np.sort(scores)[-20]
        want = np.flatnonzero(x @ x[i] >= floor)
        assert set(want) <= set(topk.survivors(x[i], lens[i], floor, x, lens))


def test_top_k_with_one_dominant_coordinate(spark):
    x = [[1.0, 0.0], [0.99, 0.1], *[[0.8, 0.59]] * 3, [1.0, 0.02], [-1.0, 0.0], [-1.0, 0.05], *[[-0.8, 0.59]] * 3]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    v = np.floor(64 * np.asarray(x)).astype("i8")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, df, k=3).collect()}
    for q in range(len(x)):
        best = sorted((-int(v[q] @ v[i]), i) for i in range(len(x)) if i != q)[:3]
        assert [got[q, n + 1] for n in range(3)] == [(i, -s) for s, i in best]


def brute_top_k(rows, k):
    v = {i: [int(np.floor(64 * c)) if abs(c) < 2**46 else int(c) * 64 for c in x] for i, x in rows}
    out = []
    for q in v:
        best = sorted((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q)[:k]
        out += [(q, n + 1, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1e5, 1e7, 5e7, 1e30, 1e155])
def test_top_k_of_large_components(spark, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(9)
    rows = [(i, (scale * (1 + 1e-9 * rng.random(4))).tolist()) for i in range(120)]
    rows += [(200 + i, rng.standard_normal(4).tolist()) for i in range(60)] + [(300 + i, (-scale * rng.random(4)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top_k(df, df, k=5).collect()))
    assert got == brute_top_k(rows, 5)


def test_one_huge_row_leaves_the_others_as_they_are(spark):
    rng = np.random.default_rng(10)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(300)] + [(300, [1e30] * 8), (301, [1.7e308] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(map(tuple, topk.top_k(df, df, k=20).collect())) == brute_top_k(rows[:-1], 20)  # 64 x of the last is no finite double


def test_only_texts_that_may_go_are_shuffled(spark):
    from pyspark.sql import functions as F

    from millrace.llm import common

    keys = spark.range(0, 20000, 10).select(F.xxhash64("id").alias("h"))
    found = spark.range(20000).where(common.maybe_among(keys, common.Scratch(spark))(F.xxhash64("id"))).toPandas()["id"]
    assert set(range(0, 20000, 10)) <= set(found) and len(found) < 2000 + 600
    assert not spark.range(5).where(common.maybe_among(keys.limit(0), common.Scratch(spark))(F.xxhash64("id"))).count()
    texts = [" ".join(f"w{(i * 97 + j * j) % 5003}" for j in range(40)) for i in range(60)]
    docs = spark.createDataFrame([(i, texts[i % 50]) for i in range(60)] + [(None, texts[0]), (None, None), (99, None)], "doc_id long, text string")
    left = near_dup.one_of_each(docs)
    assert "might_contain" in left._jdf.queryExecution().toString()
    assert sorted((r["doc_id"] is not None, r["doc_id"]) for r in left.collect() if r["doc_id"] is not None) == [(True, i) for i in [*range(50), 99]] and left.where("doc_id is null").count() == 2
