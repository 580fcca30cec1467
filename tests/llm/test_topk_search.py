import math

import numpy as np
from pyspark.sql import functions as F

from assayframe.llm import topk_search
from assayframe.llm.topk_search import top_k


def brute(rows, k, asks):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i] = [math.floor(256 * x) for x in v]
    out = []
    for q, v in usable.items():
        if not asks(q):
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), i) for i, w in usable.items() if i != q and len(w) == len(v)
        )
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, k=3):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in top_k(frame, F.col("vec_id") % 5 == 0, k).collect())


def test_like_brute_force_with_ties_copies_and_bad_rows(spark):
    random = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in random.integers(-3, 4, 4) / 2]) for i in range(120)]
    # A hot group of equal vectors, and rows that take no part.
    rows += [(i, [0.5, 0.5, -0.5, 1.0]) for i in range(200, 260)]
    rows += [(300, None), (305, [None, 1.0, 1.0, 1.0]), (310, [float("nan")] * 4), (315, [float("inf")] * 4)]
    rows += [(None, [1.0] * 4), (320, [1.0, 2.0]), (325, [3.0, 4.0]), (330, [])]
    assert found(spark, rows + rows[:3]) == brute(rows, 3, lambda q: q % 5 == 0)


def test_small_trees_prune_without_loss(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK_ROWS", 40)
    monkeypatch.setattr(topk_search, "BLOCK_QUERIES", 8)
    monkeypatch.setattr(topk_search, "SAMPLE", 30)
    random = np.random.default_rng(4)
    centres = random.standard_normal((6, 3)) * 4
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + random.standard_normal(3) / 9]) for i in range(400)]
    assert found(spark, rows, 4) == brute(rows, 4, lambda q: q % 5 == 0)


def test_fewer_than_k_and_none(spark):
    assert found(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert found(spark, []) == []


def test_every_node_covers_its_points():
    random = np.random.default_rng(0)
    tree = topk_search.cover_tree(np.unique(random.integers(-9, 9, (900, 3)), axis=0))
    assert sorted(tree.order) == list(range(len(tree.points)))
    for i, children in enumerate(tree.children):
        own = tree.points[tree.start[i] : tree.end[i]].astype(float)
        away = np.linalg.norm(own - tree.points[tree.centre[i]], axis=1)
        assert (away <= tree.radius[i] + 1e-9).all()
        if children:
            spans = [(tree.start[c], tree.end[c]) for c in children]
            assert spans[0][0] == tree.start[i] and spans[-1][1] == tree.end[i]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_id_with_several_vectors_of_one_score_counts_once(spark):
    rows = [(0, [1.0, 0.0]), (6, [1.0, 0.25]), (6, [1.0, 0.5]), (7, [0.5, 0.0]), (8, [0.25, 0.0])]
    assert found(spark, rows, 2) == [(0, 1, 6, 65536), (0, 2, 7, 32768)]


def test_net_of_a_block_takes_no_pass_for_each_centre(monkeypatch):
    """Where no points are near each other every one of them is a centre."""
    calls, plain = [], topk_search._distances
    monkeypatch.setattr(topk_search, "_distances", lambda *given: calls.append(1) or plain(*given))
    points = np.random.default_rng(1).integers(-40, 40, (600, 48))
    tree = topk_search.cover_tree(points)
    assert sorted(tree.order) == list(range(600))
    assert len(calls) <= 2 * len(tree.start)


def test_distances_are_exact_for_any_whole_numbers():
    random = np.random.default_rng(3)
    for most in (100, 10**6, 10**9):
        left, right = (random.integers(-most, most, (n, 5)) for n in (40, 7))
        right[0] = left[0] + 1
        plain = np.sqrt(((left[:, None, :] - right[None, :, :]).astype(float) ** 2).sum(axis=2))
        assert np.allclose(topk_search.distances(left, right), plain, rtol=1e-12, atol=0)


def test_best_is_kept_from_block_to_block_for_many_candidates():
    random = np.random.default_rng(5)
    queries, points = random.integers(-50, 50, (30, 8)), random.integers(-50, 50, (900, 8))
    own = np.arange(30) * 10
    best = topk_search.Best(own, 4, np.full(30, topk_search.LEAST))
    data = [topk_search.cover_tree(points[low : low + 300]) for low in (0, 300, 600)]
    asked = topk_search.cover_tree(queries)
    best.query_ids = own[asked.order]
    for low, tree in zip((0, 300, 600), data):
        ids = topk_search.Ids(np.ones(300, dtype=int), tree.order + low)
        topk_search.dual_search(asked, tree, ids, best)
    for at, query in enumerate(asked.order):
        scored = sorted((-int(queries[query] @ p), i) for i, p in enumerate(points) if i != own[query])[:4]
        assert [(-s, i) for s, i in scored] == list(zip(best.scores[at].tolist(), best.ids[at].tolist()))
