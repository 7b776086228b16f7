"""The n-gram join and exact search against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.llm import jaccard, topk

from .cases import documents, empty, ordered, plain, wild


def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
        w = [x for x in w.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
        m = min(n, len(w))
        sets.append({tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)]


def noisy(rng, base, changes):
    w = base.split()
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


def crowd():
    """Groups of near copies around hubs, chains, shared passages and small texts."""
    rng = random.Random(11)
    text = lambda n: " ".join(f"t{rng.randrange(3000)}" for _ in range(n))
    rows, passage = [], text(60)
    for size in (12, 30, 80, 300):
        base = text(size)
        rows += [noisy(rng, base, rng.randrange(1, 1 + max(2, size // 25))) for _ in range(12)] + [base, base]
        chain = base
        for _ in range(5):
            chain = noisy(rng, chain, max(1, size // 90))
            rows.append(chain)
    rows += [passage + " " + text(rng.randrange(2, 60)) for _ in range(15)] + [text(3), "a b", "a b", "a", "", None]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_components(spark, n, num, den):
    rows = crowd()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.with_component_ids(jaccard.components(df, n, num, den)).select("doc_id", "nj_n", "component_id")
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute_components(rows, n, num, den))


def test_sets_come_from_their_own_texts(spark):
    """Only the texts that stand for the nodes are split again, not all that have the same set."""
    rows = [(1, "a b c d e f"), (2, "A b  c d e f"), (3, "x y z u v w"), (4, "other words that nobody needs")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    node = {t: jaccard.node_of(jaccard.shingles(t, 4)) for _, t in rows}
    of = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    wanted = [(node[rows[0][1]], of[rows[1][1]]), (node[rows[2][1]], of[rows[3][1]])]
    nodes = spark.createDataFrame(wanted, "nj_node long, nj_text long")
    got = jaccard.needed_sets(df, nodes, 4).collect()
    assert [(r.nj_node, len(r.nj_set)) for r in got] == [(node[rows[0][1]], 3)]


def test_odd_documents(spark):
    docs = wild(documents(spark), "nj_node", "nj_id", "nj_row", "nj_key", "nj_kept", "nj_whole", "nj_rest", "nj_empty", "component")
    got = jaccard.with_component_ids(jaccard.components(docs)).select("doc_id", "nj_n", "component_id")
    assert ordered(tuple(r) for r in got.collect()) == ordered(brute_components(plain(docs), 5, 80, 100))
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    kept = plain(kept)
    assert sorted(str(i) for i, _ in kept if i not in (4, 5, None)) == sorted(map(str, [1, 6, 7, 8, 9, 11, 12, 13, 14, 15, 16]))
    assert jaccard.representatives(empty(spark)).count() == 0


def test_one_row_of_each_component(spark):
    """Ids that stand in several components, repeated rows and null ids."""
    rng = random.Random(5)
    a, b, c, d, e, f, g, h = (" ".join(f"{x}{rng.randrange(900)}" for _ in range(120)) for x in "zbcdefgh")
    once = [(5, a), (3, b), (8, c), (8, d), (9, e), (None, f), (None, g), (6, h), (20, "")]
    more = [(7, noisy(rng, a, 2)), (5, noisy(rng, b, 2)), (9, e), (11, c), (None, f), (None, h), (8, noisy(rng, b, 1)), (20, "")]
    for rows in (once[:2] + more[:2], once + more):
        got = plain(jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string")))
        assert ordered(got) == ordered(x for x in (*once, (20, "")) if x in rows and (x[1] or len(rows) > 4))


def test_signatures_miss_nothing():
    """Random pairs at the threshold share a signature, whatever their sizes."""
    rng = np.random.default_rng(4)
    for num, den in ((85, 100), (80, 100)):
        bands = jaccard.Bands(num, den)
        for n in [*range(2, 60, 3), 100, 333, 1000, 4000]:
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            drop = rng.integers(0, n)
            kept = a[: n - min(drop, n * (den - num) // den)]
            extra = 0
            while den * len(kept) >= num * (n + extra + 1):
                extra += 1
            b = np.concatenate([kept, rng.integers(0, 2**63, extra).astype(np.uint64)])
            x, y = np.unique(a), np.unique(b)
            if len(np.intersect1d(x, y)) * den < num * len(np.union1d(x, y)) or np.array_equal(x, y):
                continue
            assert len(np.intersect1d(jaccard.signatures(x, bands), jaccard.signatures(y, bands))), (n, len(y))


def test_contraction(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 20)] + [(rng.randrange(200, 230), rng.randrange(200, 230)) for _ in range(25)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    df = spark.createDataFrame(links, "nj_a long, nj_b long")
    got = {r["nj_node"]: r["nj_comp"] for r in jaccard.contracted(df).collect()}
    assert got == {x: root(x) for x in list(up)}


def test_search(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = [rng.normal(size=6).tolist() for _ in range(300)] + [[0.5] * 6] * 120
    rows = [(i, x) for i, x in enumerate(v)] + [(1000, None), (1001, [1.0, None] + [0.0] * 4), (1002, [float("nan")] * 6), (1003, [float("inf")] * 6), (None, [1.0] * 6), (1050, [1.0, 2.0]), (1004, [0.3, 0.1]), (5, v[5]), (1100, []), (1101, []), (1200, [3e5, 1e6, 0.1]), (1201, [2e5, 1e5, 0.3]), (1202, [1e3, -1e5, 0.7])]
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 5)
    df = wild(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id", "vec", "cell", "dim", "kth", "shard", "h")
    q = topk.quantised(df)
    got = ordered(tuple(r) for r in topk.search(q, q.where("id % 50 = 0"), 5).collect())
    whole = {i: np.floor(256 * np.array(x)).astype(int) for i, x in rows if i is not None and x is not None and None not in x and np.isfinite(np.array(x, float)).all()}
    want = []
    for i in whole:
        if i % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(whole[i].tolist(), whole[j].tolist(), strict=True)), j) for j in whole if j != i and len(whole[j]) == len(whole[i]))[:5]
            want += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    assert got == ordered(want)
    none = topk.quantised(df.limit(0))
    assert topk.search(none, none, 5).count() == 0


def test_tree_bounds_hold():
    rng = np.random.default_rng(8)
    v = rng.integers(-200, 200, (500, 5))
    tree = topk.BallTree(np.arange(500), v)
    q = rng.integers(-200, 200, (20, 5))
    s, i = tree.search(np.arange(1000, 1020), q, 3, np.full(20, topk.NONE))
    want = np.sort(q @ v.T, axis=1)[:, ::-1][:, :3]
    assert np.array_equal(s, want) and (i >= 0).all()


def test_far_cells_are_not_asked(spark, monkeypatch):
    """On clustered vectors most (query, cell) pairs are cut before they travel."""
    rng = np.random.default_rng(1)
    centers = np.eye(24) * 4
    rows = [(i, (centers[i % 24] + rng.normal(size=24) * 0.05).tolist()) for i in range(2400)]
    q = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    sent = []
    whole = topk.reached

    def counted(*args):
        sent.append(whole(*args))
        return sent[0]

    monkeypatch.setattr(topk, "reached", counted)
    got = topk.search(q, q.where("id % 50 = 0"), 5).count()
    n = sent[0].agg(F.sum(F.size("cells")), F.count("*")).first()
    assert got == 240 and n[0] < 0.1 * n[1] * topk.CELLS


def test_components_beyond_whole_numbers(spark):
    """A component whose floor has no 63 bits is an error, not a saturated score; unusable ones are left out."""
    rows = [(0, [1e17]), (1, [2.0]), (2, [float("inf")]), (3, [None])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert topk.quantised(df.where("vec_id > 0")).collect() == [(1, [512])]
    with pytest.raises(Exception, match="63 bits"):
        topk.quantised(df).collect()


def test_sample_of_pivots_reaches_the_driver_once(spark, monkeypatch):
    """Not once for each task: rows are thinned out before they are ordered, and the least hashes stay."""
    from pyspark.sql.classic.dataframe import DataFrame

    rng = np.random.default_rng(3)
    q = spark.createDataFrame([(i, x) for i, x in enumerate(rng.integers(-200, 200, (3000, 4)).tolist())], "id long, vec array<bigint>").repartition(12)
    least = [r["id"] for r in q.orderBy(F.xxhash64("id")).limit(60).collect()]
    monkeypatch.setattr(topk, "SAMPLE", 60)
    taken, ordered_by = [], DataFrame.orderBy

    def counted(rows, *by):
        taken.append(rows.count())
        return ordered_by(rows, *by)

    monkeypatch.setattr(DataFrame, "orderBy", counted)
    topk.search(q, q.where("id % 50 = 0"), 5)
    monkeypatch.setattr(DataFrame, "orderBy", ordered_by)
    assert taken and max(taken) < 4 * 60
    assert [r["id"] for r in topk.sampled(q, 3000)] == least


@pytest.mark.parametrize("top", [100, 100_000, 100_000_000, 1_000_000_000])
def test_tree_in_every_type(top):
    """Scores in floats, doubles and whole numbers, with many ties: those of all pairs, ties to the smaller id;
    packing gives the vectors back."""
    rng = np.random.default_rng(top)
    v = np.repeat(rng.integers(-top, top, (60, 4)), 10, axis=0)
    ids, q_ids = rng.permutation(600), np.arange(0, 600, 7)
    q = v[np.argsort(ids)][q_ids]
    s, i = topk.BallTree(ids, v).search(q_ids, q, 5, np.full(len(q), topk.NONE))
    for n, (x, own) in enumerate(zip(q.tolist(), q_ids, strict=True)):
        want = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j) for y, j in zip(v.tolist(), ids.tolist(), strict=True) if j != own)[:5]
        assert list(zip((-s[n]).tolist(), i[n].tolist(), strict=True)) == want
    assert np.array_equal(topk.unpacked(topk.packed(v), 4), v)
