from __future__ import annotations

import json

import numpy as np
import pytest

from assayframe.operators import forests, trees

SCHEMA = "target string, fit int, role string, sample_id string, y double, features array<double>"
ONE = {"model__n_estimators": 3, "model__min_samples_leaf": 2, "model__max_features": "sqrt"}
TWO = {
    "model__n_estimators": 4,
    "model__max_depth": 3,
    "model__min_samples_split": 5,
    "model__max_features": 0.5,
    "model__bootstrap": False,
}


def brute_tree(x, y, times, key, depth, params):
    """One tree by recursion, with sums over plain lists."""

    def below(rows, key, depth):
        weight, total = sum(times[i] for i in rows), sum(times[i] * y[i] for i in rows)
        leaf = (total / weight,)
        if len(rows) < max(params.min_split, 2 * params.min_leaf) or len({y[i] for i in rows}) == 1:
            return leaf
        if params.max_depth is not None and depth >= params.max_depth:
            return leaf
        best, varied = None, False
        order = sorted(range(len(x)), key=lambda f: (int(trees.mixed(key, f)), f))
        for visit, f in enumerate(order):
            if visit >= params.features and varied:
                break
            ranked = sorted(rows, key=lambda i: x[f][i])
            varied = varied or x[f][ranked[0]] < x[f][ranked[-1]]
            left_weight = left = 0.0
            for place in range(len(ranked) - 1):
                i, j = ranked[place], ranked[place + 1]
                left_weight, left = left_weight + times[i], left + times[i] * y[i]
                sizes = place + 1, len(ranked) - place - 1
                if x[f][j] > x[f][i] and min(sizes) >= params.min_leaf:
                    score = left * left / left_weight + (total - left) ** 2 / (weight - left_weight)
                    if best is None or score > best[0]:
                        best = score, f, x[f][i] / 2 + x[f][j] / 2
        if best is None:
            return leaf
        _, f, cut = best
        left, right = [i for i in rows if x[f][i] <= cut], [i for i in rows if x[f][i] > cut]
        return (
            f,
            cut,
            below(left, int(trees.mixed(key, 0)), depth + 1),
            below(right, int(trees.mixed(key, 1)), depth + 1),
        )

    return below([i for i in range(len(y)) if times[i]], key, depth)


def nested(nodes, place):
    if nodes.feature[place] < 0:
        return (nodes.value[place],)
    return (
        nodes.feature[place],
        nodes.threshold[place],
        nested(nodes, nodes.left[place]),
        nested(nodes, nodes.right[place]),
    )


def flat(tree):
    return [v for part in tree for v in (flat(part) if isinstance(part, tuple) else [float(part)])]


@pytest.mark.parametrize("seed", range(60))
def test_trees_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, width = int(rng.integers(1, 40)), int(rng.integers(1, 7))
    x = rng.integers(0, rng.choice([2, 5, 1000]), size=(width, n)).astype(float)
    y = rng.integers(0, 8, size=n).astype(float)
    params = trees.TreeParams(
        3, [None, 2, 5][seed % 3], int(rng.choice([2, 5])), int(rng.choice([1, 2, 4])),
        int(rng.integers(1, width + 1)), bool(seed % 2),
    )
    table = trees.Table(x, y, rng.integers(0, trees.PRIME, n), float(np.rint(y.mean())))
    numbers = np.arange(1, 4)
    roots = trees.planted(table, 42, numbers, params.bootstrap)
    nodes = trees.grow(table, roots, 0, params)
    keys = trees.mixed(np.int64(42), numbers)
    times = trees.times_drawn(keys, table.keys) if params.bootstrap else np.ones((3, n), int)
    for tree in range(3):
        expected = brute_tree(x, y, times[tree], int(keys[tree]), 0, params)
        assert flat(nested(nodes, tree)) == pytest.approx(flat(expected))


def test_rows_are_drawn_as_often_as_with_replacement():
    rng = np.random.default_rng(0)
    times = trees.times_drawn(rng.integers(0, trees.PRIME, 200), rng.integers(0, trees.PRIME, 2_000))
    assert times.mean() == pytest.approx(1, abs=0.02)
    assert (times == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert times.var() == pytest.approx(1, abs=0.05)
    # Trees and rows have no draws in common.
    assert abs(np.corrcoef(times)[np.triu_indices(200, 1)]).mean() < 0.03


def test_parameters():
    p = trees.tree_params({**ONE, "model__max_features": 0.2}, 11)
    assert (p.trees, p.max_depth, p.min_split, p.min_leaf, p.features, p.bootstrap) == (3, None, 2, 2, 2, True)
    tried = [trees.features_tried(s, 20) for s in ("sqrt", "log2", 0.8, None, 0.01)]
    assert tried == [4, 4, 16, 20, 1]
    with pytest.raises(ValueError):
        trees.tree_params({"model__criterion": "mae"}, 3)


def design(spark, n=60, width=6, targets=("A", "B")):
    rng = np.random.default_rng(1)
    rows = []
    for target in targets:
        x = rng.integers(0, 9, size=(n, width)).astype(float)
        x[:, 0] = 3.0  # varies nowhere
        y = np.rint(x[:, 1] * 3 + x[:, 2] * 2 + rng.normal(size=n) * 2)
        for i in range(n):
            for fit in (-1, 0, 1):
                if fit < 0:
                    role = "train" if i % 5 else "test"
                else:
                    role = ("valid" if i % 2 == fit else "train") if i % 5 else None
                if role:
                    rows.append((target, fit, role, f"s{i}", float(y[i]), x[i].tolist()))
    return spark.createDataFrame(rows, SCHEMA)


def draws_of(spark, *listed):
    return spark.createDataFrame([(i + 1, json.dumps(d)) for i, d in enumerate(listed)], "draw long, params string")


def test_levels_and_tasks_grow_the_same_forests(spark):
    table, draws = design(spark), draws_of(spark, ONE, TWO)

    def found(local_cells):
        rows = forests.search(table, draws, 42, local_cells, bins=64).collect()
        return {(r.target, r.fit, r.draw, r.sample_id): r.prediction for r in rows}

    whole, by_levels = found(10**6), found(60)
    assert whole.keys() == by_levels.keys() and len(whole) == 2 * 2 * 48
    assert all(whole[k] == pytest.approx(by_levels[k], abs=1e-9) for k in whole)


def test_nodes_and_their_use(spark):
    table = design(spark)
    chosen = spark.createDataFrame([("A", 1, json.dumps(ONE)), ("B", 2, json.dumps(TWO))], "target string, draw long, params string")
    nodes, predicted = forests.fit(table, chosen, 42)
    level_nodes, _ = forests.fit(table, chosen, 42, local_cells=60, bins=64)
    named = ["target", "tree", "node", "feature", "threshold", "left", "right", "rows", "weight"]
    assert sorted(map(tuple, nodes.select(*named).collect()), key=repr) == sorted(
        map(tuple, level_nodes.select(*named).collect()), key=repr
    )
    counts = {(r.target, r.tree) for r in nodes.collect()}
    assert counts == {("A", t) for t in (1, 2, 3)} | {("B", t) for t in (1, 2, 3, 4)}
    held_out = table.where("fit = -1 and role = 'test'").select("target", "sample_id", "features")
    applied = {(r.target, r.sample_id): r.prediction for r in forests.apply(nodes, held_out).collect()}
    assert applied == pytest.approx({(r.target, r.sample_id): r.prediction for r in predicted.collect()})
    shares = forests.importances(nodes).collect()
    assert all(r.feature != 0 for r in shares)
    for target in ("A", "B"):
        assert sum(r.importance for r in shares if r.target == target) == pytest.approx(1)


def test_layout_changes_nothing(spark):
    table, draws = design(spark, targets=("A",)), draws_of(spark, ONE)
    one = forests.search(table.coalesce(1), draws, 7).collect()
    other = forests.search(table.repartition(9), draws, 7).collect()
    key = lambda r: (r.fit, r.sample_id)
    assert [r.prediction for r in sorted(one, key=key)] == pytest.approx([r.prediction for r in sorted(other, key=key)])


def test_odd_tables(spark):
    draws = draws_of(spark, ONE)
    assert forests.search(spark.createDataFrame([], SCHEMA), draws, 1).collect() == []
    constant = [("C", 0, "train", f"s{i}", 5.0, [1.0, float(i)]) for i in range(6)] + [("C", 0, "valid", "v", 4.0, [1.0, 2.0])]
    (row,) = forests.search(spark.createDataFrame(constant, SCHEMA), draws, 1).collect()
    assert row.prediction == 5.0
    no_features = [("N", 0, "train", f"s{i}", float(i), []) for i in range(4)] + [("N", 0, "valid", "v", 1.0, [])]
    (row,) = forests.search(spark.createDataFrame(no_features, SCHEMA), draws, 1).collect()
    assert 0 <= row.prediction <= 3


@pytest.mark.parametrize("whole", [True, False])
def test_draws_that_differ_in_limits_share_their_trees(whole):
    """Cut off at the limits of a draw, a tree grown with the loosest ones is its own."""
    random = np.random.default_rng(7)
    n = 160
    x = np.round(random.standard_normal((5, n)), 1)
    y = random.integers(0, 6, n) * 1.0 if whole else random.standard_normal(n)
    table = trees.Table(x, y, random.integers(0, trees.PRIME, n), round(y.mean()))
    held_out = random.standard_normal((5, 40))
    draws = [
        trees.TreeParams(4, None, 2, 1, 2, True),
        trees.TreeParams(7, 3, 5, 1, 2, True),
        trees.TreeParams(7, 6, 20, 1, 2, True),
        trees.TreeParams(5, None, 2, 4, 2, True),
        trees.TreeParams(3, None, 10, 1, 5, False),
        trees.TreeParams(0, None, 2, 1, 3, False),
    ]
    grown, seen = 0, {place: [] for place in range(len(draws))}
    for places, loosest, numbers in trees.shared(draws, np.arange(1, 12)):
        for some, nodes in trees.forest(table, loosest, 3, numbers):
            grown += len(some)
            for place in places:
                cut = trees.cut_off(nodes, draws[place], len(some))
                values = trees.descend(cut, held_out, len(some))
                for number, line in zip(some.tolist(), values):
                    seen[place].append(number)
                    _, own = next(trees.forest(table, draws[place], 3, np.array([number])))
                    assert np.allclose(line, trees.descend(own, held_out, 1)[0], rtol=1e-12)
    assert {place: sorted(numbers) for place, numbers in seen.items()} == {
        place: list(range(1, params.trees + 1)) for place, params in enumerate(draws)
    }
    assert grown == 7 + 5 + 3


def test_neighbours_of_one_value_are_not_parted_however_many():
    """Values of few kinds, so that most neighbours in rank are equal."""
    random = np.random.default_rng(11)
    x, y = random.integers(0, 3, (4, 90)) * 1.0, random.integers(0, 4, 90) * 1.0
    table = trees.Table(x, y, random.integers(0, trees.PRIME, 90), 2.0)
    params = trees.TreeParams(1, None, 2, 3, 2, True)
    _, nodes = next(trees.forest(table, params, 5, np.array([1])))
    root = trees.planted(table, 5, np.array([1]), True)
    times = np.zeros(90, dtype=int)
    times[root.row] = root.times
    brute = brute_tree(x.tolist(), (y - 2.0).tolist(), times.tolist(), int(root.key[0]), 0, params)
    assert flat(nested(nodes, 0)) == pytest.approx(
        [v + 2.0 if leaf else v for v, leaf in _leaves(brute)], rel=1e-12
    )


def _leaves(tree):
    if len(tree) == 1:
        return [(tree[0], True)]
    return [(tree[0], False), (tree[1], False), *_leaves(tree[2]), *_leaves(tree[3])]


def test_each_group_of_trees_has_a_partition_of_its_own(spark):
    from pyspark.sql import functions as F

    rows = design(spark, targets=tuple("ABCDEF"))
    folds = rows.where("fit <> -1").select("target", "fit").distinct().orderBy("target", "fit").collect()
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(folds)], "target string, fit int, at int")
    own = rows.withColumns({"row_key": F.lit(5).cast("long"), "centre": F.lit(0.0)}).join(numbered, ["target", "fit"])
    listed = [(1, {**ONE, "model__n_estimators": 600})]
    grown = forests._grow_whole(own, listed, 1, len(folds), False)
    found = grown.withColumn("partition", F.spark_partition_id()).select("target", "fit", "trees", "partition").distinct()
    assert found.count() == found.select("partition").distinct().count() > 1
