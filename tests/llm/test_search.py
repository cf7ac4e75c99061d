"""SimHash, near copies, nearest neighbours against brute force."""

import random
import re

import numpy as np
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from runlens.llm import ann, common, graph, simhash


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(items, linked):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def test_op1_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = simhash.op1_simhash(spark, sf).collect()
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {r["doc_id"]: int(r["fingerprint"], 16) for r in got} == fps and all(len(r["fingerprint"]) == 16 for r in got)
    assert {r["doc_id"]: r["component_id"] for r in got} == groups(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)


@pytest.mark.parametrize(("tau", "parts", "block"), [(3, 3, 2048), (3, 4, 5), (8, 5, 16), (2, 2, 2048), (3, None, 7), (5, None, 2048)])
def test_links_keep_every_component(spark, monkeypatch, tau, parts, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(tau * (parts or 9))
    fps = {rng.getrandbits(64) for _ in range(20)}
    for f in list(fps):
        for _ in range(8):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, tau + 2)))
            fps.add(f)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    comp = graph.components(simhash.links(df, tau, parts)).collect()
    got = {s: s for s in signed} | {r["node"]: r["component"] for r in comp}
    want = groups(range(len(fps)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= tau)
    same = lambda label: {frozenset(k for k in label if label[k] == v) for v in set(label.values())}
    assert same({i: got[signed[i]] for i in range(len(fps))}) == same(want)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}


@pytest.mark.parametrize("small", [1 << 18, 0])
def test_few_edges_need_no_rounds(spark, monkeypatch, small):
    """On the driver or in rounds the components are the same; a few edges are written once and joined with nothing."""
    monkeypatch.setattr(graph, "SMALL", small)
    written, stash = [], graph.stash
    monkeypatch.setattr(graph, "stash", lambda df, label: written.append(label) or stash(df, label))
    rng = random.Random(8)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 - i) for i in range(30)] * 2
    edges += [(-(1 << 63), 1 << 62), (5, 5), (None, 3), (4, None)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and b is not None and a != b]
    near = {frozenset(e) for e in real}
    assert got == groups(sorted({x for e in real for x in e}), lambda a, b: frozenset((a, b)) in near)
    assert written == ["edges"] if small else len(written) > 4
    empty = graph.components(spark.createDataFrame([(7, 7)], "a long, b long"))
    assert empty.collect() == [] and empty.dtypes == [("node", "bigint"), ("component", "bigint")]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup_edges(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    near = base.copy()
    near[60] = "changed"
    far = base[:50] + [f"v{i}" for i in range(70)]
    rows = [
        (5, " ".join(base), "a", 1), (4, " ".join(near), "b", 2), (6, " ".join(far), "c", 3), (7, None, "d", 4), (8, "", "e", 5),
        (9, "one", "f", 6), (9, "one", "f", 6), (None, "no id", "g", 7), (None, "no id", "g", 8), (None, " ".join(base), "h", 9), (10, "x " * 30000, "i", 10),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id long")  # names that the operator uses too
    for text_hash in (F.xxhash64, F.length):  # lengths: texts that share a hash are told apart by the second one
        got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["fp"]) for r in simhash.near_dedup(docs, text_hash=text_hash).collect())
        assert got == [(-1, "g"), (4, "b"), (6, "c"), (7, "d"), (9, "f"), (10, "i")]
    assert simhash.near_dedup(docs).columns == docs.columns
    assert simhash.near_dedup(docs.limit(0)).count() == 0


def test_near_dedup_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    comp = groups(list(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    assert {r["doc_id"] for r in simhash.near_dedup(docs).select("doc_id").collect()} == {i for i, c in comp.items() if i == c}


def test_near_dedup_finds_cut_extended_and_short_copies(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARED", 4)
    rng = random.Random(5)
    rows = []
    for size in [14] * 30 + [40] * 20 + [150] * 20 + [600] * 10:
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        rows.append(base)
        for edit in rng.sample(range(5), 3):
            n = max(1, size * rng.randrange(8, 18) // 100)
            more = [f"w{rng.randrange(3000)}" for _ in range(n)]
            rows.append([base[:-n], base + more, [*base[:-1], "end"], base[n:], more + base][edit])
    line = [f"l{i}" for i in range(12)]
    rows += [line + [f"x{i}", f"y{i}"] for i in range(20)] + [[f"z{i}"] + line[:10] for i in range(20)] + rows[:3] * 2
    texts = {i: " ".join(r) for i, r in enumerate(rows)}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    comp = groups(list(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == comp
    assert {r["doc_id"] for r in simhash.near_dedup(docs).collect()} == set(comp.values())


def at_once(plan):
    """The most Python functions that a task of the plan runs at once, and those of its last stage."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return at_once(plan.executedPlan())
    kids = [at_once(plan.children().apply(i)) for i in range(plan.children().size())]
    own = [n for _, n in kids]
    last = (max if plan.nodeName() == "Union" else sum)([0, *own]) + (plan.nodeName() == "MapInArrow")
    return max([last, *(most for most, _ in kids)]), 0 if "Exchange" in plan.nodeName() else last


def test_near_dedup_runs_one_python_function_in_a_task(spark, sf, monkeypatch):
    """Each process that a task has at once is one that its executor keeps, with some 100 MB each."""
    seen = []
    for module, name in ((common, "_merged"), (simhash, "stash"), (graph, "stash")):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a, f=f: seen.append(at_once(df._jdf.queryExecution().executedPlan())[0]) or f(df, *a))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = simhash.near_dedup(docs)
    seen.append(at_once(kept._jdf.queryExecution().executedPlan())[0])
    assert len(seen) > 20 and max(seen) == 1


def test_bitmap_of_mapped_rows(spark):
    rows = spark.createDataFrame([(1, 7), (2, None), (3, -9), (4, 8)], "i long, h long")
    odd = common.map_arrow(rows, lambda batch: batch.filter(pc.not_equal(batch.column("i"), 4)), "i long, h long")
    want = common.Bitmap.of(rows.where("i < 4 and h is not null"), "h")
    assert common.Bitmap.of(odd, "h").packed == want.packed
    assert want.may_hold(np.array([7, -9, 8])).tolist() == [True, True, False]


def test_near_dedup_takes_texts_without_copies_for_copies(spark, monkeypatch):
    """What a bitmap takes for a text with copies, and is none, is searched like any other."""
    of = simhash.Bitmap.of.__func__
    full = classmethod(lambda cls, df, column: cls(b"\xff" * (cls.LEAST // 8)) if column == "th" else of(cls, df, column))
    monkeypatch.setattr(simhash.Bitmap, "of", full)
    rng = random.Random(6)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(60)]
        rows += [base, [*base, *(f"w{rng.randrange(3000)}" for _ in range(10))]]
    texts = {i: " ".join(r) for i, r in enumerate(rows)} | {100: "a text with a copy", 101: "a text with a copy"}
    sets = {i: shingle_set(t) for i, t in texts.items()}
    comp = groups(list(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs, tau=1).collect()} == comp
    assert len(set(comp.values())) == 13


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        scored = sorted((-float(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:k]
        out[q] = [i for _, i in scored]
    return out


def searched(df, **given):
    got: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, **given).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def recall(df, **given):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    want, got = brute(rows, [i for i in rows if i % 20 == 0], 20), searched(df, **given)
    for q, found in got.items():
        assert [i for i, _ in found] == [i for i, s in sorted(found, key=lambda x: (-x[1], x[0]))] and len(found) == min(20, len(rows) - 1)
        for i, score in found:
            assert score == pytest.approx(float(rows[q] @ rows[i]), rel=1e-12, abs=1e-15)
    return np.mean([len({i for i, _ in got[q]} & set(w)) / len(w) for q, w in want.items()])


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_op3_recall(spark, folder):
    assert recall(spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")) >= 0.9


def made(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")


def test_recall_beyond_the_fitting_sample(spark):
    rng = np.random.default_rng(1)
    assert recall(made(spark, rng.normal(size=(12_000, 16)))) >= 0.9


def test_recall_with_a_third_of_rows_equal(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24))
    x[1::3] = x[1]
    df = made(spark, x)
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    own = [i for i in rows if i % 20 == 0 and i % 3 != 1]
    want, got = brute(rows, own, 20), searched(df)
    kth = lambda q: float(rows[q] @ rows[want[q][-1]])
    assert np.mean([sum(s >= kth(q) - 1e-9 for _, s in got[q]) / 20 for q in own]) >= 0.9


def test_long_vectors_lose_nothing_to_rounding(spark):
    """Products that nearly cancel: their rounding is that of the vectors' lengths, not of the products."""
    rng = np.random.default_rng(3)
    q = rng.normal(size=32)
    x = rng.normal(size=(800, 32)) * 1e9
    x -= np.outer(x @ q / (q @ q), q)
    x[0] = q
    df = made(spark, x)
    rows = {i: v for i, v in enumerate(x)}

    def product(v):
        total = 0.0
        for a, b in zip(x[0], v):
            total += a * b
        return total

    want = sorted((-product(v), i) for i, v in rows.items() if i)[:20]
    assert searched(df, share=1.0)[0] == [(i, -s) for s, i in want]


def test_clustered_vectors_need_a_small_share():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(64, 16)) * 5, 40, axis=0) + rng.normal(size=(2560, 16)) * 0.05
    x = x[rng.permutation(len(x))]
    many = ann.centroids_for(len(x), len(x))
    assert ann.share_for(ann.kmeans(x[:, :8], many), ann.kmeans(x[:, 8:], many), x, 20, 0.94) < 0.15


def test_a_repeated_query_id_has_a_list_for_each_vector(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    lists: dict = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=2).orderBy("rank").collect():
        lists.setdefault((r["query_id"], r["query_hash"]), []).append((r["rank"], r["vec_id"]))
    assert sorted(lists.values()) == [[(1, 1), (2, 3)], [(1, 2), (2, 3)]]


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [0.5, 0.5]), (7, []), (20, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit("x"))
    got = [tuple(r)[:4] for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 8, 1.0), (0, 3, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 1, 1.0), (20, 3, 8, 1.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
