"""Exact top-k inner products by a dual-tree search over cover trees."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.llm.common import in_batches
from assayframe.sources.scratch import materialize

SCALE = 256
# Vectors of one tree, and queries of one tree.
BLOCK_ROWS, BLOCK_QUERIES = 2048, 256
LEAF = 64
# Most vectors and queries that meet in one task, and the least vectors worth a task.
CELL_ROWS, CELL_QUERIES, LEAST_CELL_ROWS = 1 << 17, 1 << 16, 1 << 13
# Cells per core, so that slow ones even out.
CELLS_PER_CORE = 6
# Vectors held against a group of queries at once.
STEP_ROWS = 2048
# Candidates for each place from which on the low ones are left out before sorting.
MANY = 8
# The top level is chosen from a sample of this size, which also gives each query a
# first bound. It has no say in the result, only in what is pruned.
SAMPLE, MOST_PIVOTS = 1024, 256
LEAST = np.iinfo(np.int64).min


def scaled(embedding: Column) -> Column:
    """Components times 256, rounded down."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))


def usable(embedding: Column) -> Column:
    """Not null, and every component a finite number."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return embedding.isNotNull() & ~F.coalesce(F.exists(embedding, bad), F.lit(False))


def _most(points: np.ndarray) -> int:
    return max(abs(int(points.max(initial=0))), abs(int(points.min(initial=0))))


def exact_kind(most: int, width: int) -> type:
    """Numbers in which sums of ``width`` products, each of ``most`` at the utmost, are
    exact; the fastest ones."""
    bound = most * max(1, width)
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products as int64; by floats where those are exact."""
    kind = exact_kind(_most(left) * _most(right), left.shape[1])
    return (left.astype(kind) @ right.astype(kind).T).astype(np.int64)


def compact(points: np.ndarray) -> np.ndarray:
    """The smallest integers that hold the points."""
    for kind in (np.int16, np.int32):
        if not points.size or (np.abs(points) < np.iinfo(kind).max).all():
            return points.astype(kind)
    return points


@dataclass
class CoverTree:
    """Points in tree order. Node i covers points ``start[i]:end[i]``, all within
    ``radius[i]`` of point ``centre[i]``; its children are further nodes."""

    points: np.ndarray
    order: np.ndarray
    start: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    centre: list[int] = field(default_factory=list)
    radius: list[float] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)

    def finish(self) -> None:
        self.norms = np.sqrt((self.points.astype(float) ** 2).sum(axis=1))
        self.starts, self.ends = np.array(self.start, dtype=int), np.array(self.end, dtype=int)
        self.centres = np.array(self.centre, dtype=int)
        self.radii = np.array(self.radius)
        self.most = _most(self.points)
        self.cast: dict[type, np.ndarray] = {}

    def points_as(self, kind: type) -> np.ndarray:
        if kind not in self.cast:
            self.cast[kind] = self.points.astype(kind)
        return self.cast[kind]


def _distances(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - at) ** 2).sum(axis=1))


def distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of whole points, a line per point of ``left``; from inner products where those
    are exact."""
    most, width = max(_most(left), _most(right)), left.shape[1]
    kind = exact_kind(4 * most * most, width)
    if kind is np.int64:
        return np.stack([_distances(left, at) for at in right], axis=1)
    left, right = left.astype(kind), right.astype(kind)
    squares = left @ right.T
    squares *= -2
    squares += (left * left).sum(axis=1)[:, None]
    squares += (right * right).sum(axis=1)[None, :]
    return np.sqrt(squares, dtype=float)


def net_of(away: np.ndarray, first: int, reach: float, most: int) -> tuple[list[int], np.ndarray]:
    """Farthest-first centres until all points lie within ``reach`` of one or there
    are ``most``; and the centre of each point. ``away`` has all their distances."""
    centres, nearest = [first], np.zeros(len(away), dtype=int)
    left = away[first].copy()
    while len(centres) < most:
        new = int(left.argmax())
        if left[new] <= reach:
            break
        np.putmask(nearest, away[new] < left, len(centres))
        np.minimum(left, away[new], out=left)
        centres.append(new)
    return centres, nearest


def cover_tree(points: np.ndarray) -> CoverTree:
    """Top down: children are a net of half their parent's radius. Small children
    of one parent share leaves of at most ``LEAF`` points."""
    floats = points.astype(float)
    tree = CoverTree(points, np.arange(len(points)))
    away = distances(points, points)

    def add(start: int, end: int, centre: int) -> int:
        rows = tree.order[start:end]
        tree.start.append(start)
        tree.end.append(end)
        tree.centre.append(centre)
        tree.radius.append(float(_distances(floats[rows], floats[centre]).max()))
        tree.children.append([])
        return len(tree.start) - 1

    pending = [add(0, len(points), 0)] if len(points) else []
    while pending:
        node = pending.pop()
        start, end = tree.start[node], tree.end[node]
        if end - start <= LEAF or tree.radius[node] == 0:
            continue
        rows = tree.order[start:end].copy()
        own = int(np.flatnonzero(rows == tree.centre[node])[0])
        centres, nearest = net_of(away[np.ix_(rows, rows)], own, tree.radius[node] / 2, len(rows))
        sizes = np.bincount(nearest, minlength=len(centres))
        # Large children first, then the small ones side by side.
        ranks = np.argsort(np.argsort(-np.where(sizes > LEAF, sizes, 0), kind="stable"))
        tree.order[start:end] = rows[np.argsort(ranks[nearest], kind="stable")]
        at = start
        for child in np.flatnonzero(sizes > LEAF)[np.argsort(-sizes[sizes > LEAF], kind="stable")]:
            new = add(at, at + int(sizes[child]), int(rows[centres[child]]))
            tree.children[node].append(new)
            pending.append(new)
            at += int(sizes[child])
        for leaf in range(at, end, LEAF):
            tree.children[node].append(add(leaf, min(end, leaf + LEAF), int(tree.order[leaf])))
    # From here on points stand in tree order.
    place = np.empty(len(points), dtype=int)
    place[tree.order] = np.arange(len(points))
    tree.centre = [int(place[c]) for c in tree.centre]
    tree.points = points[tree.order]
    tree.finish()
    return tree


def _reach(dots, left_norm, left_radius, right_norm, right_radius):
    """Upper bound of the inner products of points within two balls; the last terms
    stand for rounding."""
    bound = dots + left_norm * right_radius + right_norm * left_radius + left_radius * right_radius
    return bound + 1e-9 * np.abs(bound) + 1e-6


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of ranges, one after another."""
    ends = np.cumsum(counts)
    return np.arange(counts.sum()) + np.repeat(starts - (ends - counts), counts)


@dataclass
class Ids:
    """The ids of some points, one point after another."""

    counts: np.ndarray
    flat: np.ndarray

    def __post_init__(self):
        self.starts = np.cumsum(self.counts) - self.counts
        self.single = len(np.unique(self.flat)) == len(self.flat)

    def of(self, points: np.ndarray) -> np.ndarray:
        return self.flat[_spread(self.starts[points], self.counts[points])]


class Best:
    """The k best candidates of each query of a block so far."""

    def __init__(self, query_ids: np.ndarray, k: int, floor: np.ndarray):
        self.query_ids, self.k, self.floor = query_ids, k, floor
        self.scores = np.full((len(query_ids), k), LEAST)
        self.ids = np.full((len(query_ids), k), np.iinfo(np.int64).max)

    def worst(self, rows: slice | np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: Ids, columns: np.ndarray) -> None:
        """Scores of some points, a column each (the places ``columns`` of ``ids``)."""
        worst = self.worst(rows)
        # Rounded down; the few that pass are held against the whole numbers.
        least = worst.astype(scores.dtype)
        if scores.dtype != np.int64:
            least = np.where(least.astype(float) > worst, np.nextafter(least, -np.inf, dtype=least.dtype), least)
        hit = np.flatnonzero(scores >= least[:, None])
        if len(hit) > MANY * self.k * len(scores) and scores.shape[1] > self.k + 1 and ids.single:
            # k + 1 points at least that high have k other ids, if no id comes twice.
            high = np.partition(scores, -self.k - 1, axis=1)[:, -self.k - 1]
            least = np.maximum(least, high)
            hit = np.flatnonzero(scores >= least[:, None])
        if not len(hit):
            return
        row, column = np.divmod(hit, scores.shape[1])
        score, point = scores.reshape(-1)[hit].astype(np.int64), columns[column]
        # Equal scores may still win by their smaller id.
        useful = score >= worst[row]
        row, score, point = row[useful], score[useful], point[useful]
        count = ids.counts[point]
        row, score = np.repeat(rows[row], count), np.repeat(score, count)
        found = ids.of(point)
        other = self.query_ids[row] != found
        if other.any():
            self._merge(row[other], score[other], found[other])

    def _merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(row)
        old = self.scores[touched] > LEAST
        row = np.concatenate([row, np.repeat(touched, old.sum(axis=1))])
        score = np.concatenate([score, self.scores[touched][old]])
        ids = np.concatenate([ids, self.ids[touched][old]])
        # Products reach LEAST in no case, so that they have a negative.
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        # An id may have several vectors; one of equal score counts once.
        new = np.append(True, (row[1:] != row[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1]))
        row, score, ids = row[new], score[new], ids[new]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        top = place < self.k
        self.scores[row[top], place[top]], self.ids[row[top], place[top]] = score[top], ids[top]


def _bounds(queries: CoverTree, data: CoverTree) -> np.ndarray:
    """Upper bound of the products of every pair of nodes."""
    return _reach(
        products(queries.points[queries.centres], data.points[data.centres]),
        queries.norms[queries.centres][:, None],
        queries.radii[:, None],
        data.norms[data.centres][None, :],
        data.radii[None, :],
    )


def dual_search(queries: CoverTree, data: CoverTree, ids: Ids, best: Best) -> None:
    """Visit node pairs level by level, then the leaves, best bound first; leave out a
    pair whose bound is below the worst kth score of the queries in its node."""
    if not queries.start or not data.start:
        return
    bounds = _bounds(queries, data)
    rows = [slice(start, end) for start, end in zip(queries.start, queries.end)]
    worst = np.array([best.worst(own).min() for own in rows])
    pending, leaves = [(0, 0)], {}
    while pending:
        deeper = []
        for q, d in pending:
            if bounds[q, d] < worst[q]:
                continue
            deeper_q, deeper_d = queries.children[q], data.children[d]
            if deeper_q and (not deeper_d or queries.radii[q] >= data.radii[d]):
                deeper.extend((child, d) for child in deeper_q)
            elif deeper_d:
                # A node of the data and all its children at once.
                near = np.array(deeper_d)
                deeper.extend((q, child) for child in near[bounds[q, near] >= worst[q]].tolist())
            else:
                leaves.setdefault(q, []).append(d)
        pending = deeper
    # Leaves of queries that meet the same leaves of the data go together.
    together: dict[tuple, list[int]] = {}
    for q, near in leaves.items():
        together.setdefault(tuple(sorted(near)), []).append(q)
    kind = exact_kind(queries.most * data.most, data.points.shape[1])
    points = data.points_as(kind)
    for near, own in together.items():
        lines = np.concatenate([np.arange(queries.start[q], queries.end[q]) for q in own])
        asked, near = queries.points_as(kind)[lines], np.array(near)
        near = near[np.argsort(-bounds[np.ix_(own, near)].max(axis=0), kind="stable")]
        upto = np.cumsum(data.ends[near] - data.starts[near])
        low = 0
        while low < len(near):
            done = upto[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(upto, done + STEP_ROWS, side="right")))
            worst = np.array([best.worst(rows[q]).min() for q in own])
            some = near[low:high]
            some = np.sort(some[(bounds[np.ix_(own, some)] >= worst[:, None]).any(axis=0)])
            low = high
            if len(some):
                columns = _spread(data.starts[some], data.ends[some] - data.starts[some])
                best.offer(lines, asked @ points[columns].T, ids, columns)


def _matrix(lists: pa.ListArray | pa.ChunkedArray, width: int) -> np.ndarray:
    """A line per list; all are of one length."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _nearest(pivots: dict[int, np.ndarray]):
    """Add to each row the pivot of its length that is nearest, and how far it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            pivot, away = np.zeros(len(dims), dtype=np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                if dim in pivots:
                    own = np.flatnonzero(dims == dim)
                    far = distances(_matrix(batch.column("vec").take(pa.array(own)), dim), pivots[dim])
                    pivot[own] = far.argmin(axis=1)
                    # Rounded up, so that the radius covers.
                    away[own] = far.min(axis=1) * (1 + 1e-9)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot, pa.int32()), pa.array(away, pa.float64())],
                names=[*batch.schema.names, "pivot", "away"],
            )

    return run


def _salted(rows: DataFrame, most: int) -> DataFrame:
    """Pivots with many rows are split evenly into blocks of about ``most``."""
    sizes = rows.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / most).alias("salts"))
    return rows.join(sizes, ["dim", "pivot"]).withColumn(
        "salt", F.pmod(F.xxhash64("vec", "row"), F.col("salts")).cast("int")
    )


def _ids_of(lists: list[list[int]]) -> Ids:
    return Ids(np.array([len(x) for x in lists], dtype=int), np.array([i for x in lists for i in x], dtype=np.int64))


def _packed(tree: CoverTree, *further) -> bytes:
    """A tree without what can be computed again."""
    tree.points, tree.order = compact(tree.points), tree.order[:0]
    return pickle.dumps((tree, *further))


def _cells(
    nodes: dict[int, list], pivots: dict[int, np.ndarray], coarse: dict[int, np.ndarray], most: int
) -> tuple[dict[tuple[int, int, int], int], int]:
    """Cell of each block (length, pivot, salt), of about ``most`` points; pivots near the
    same coarse one lie side by side. And the number of cells."""
    cell_of, cell = {}, -1
    for dim, own in nodes.items():
        cell, held = cell + 1, 0
        side = distances(pivots[dim], coarse[dim]).argmin(axis=1) if dim in pivots else np.zeros(1)
        for pivot, _, n, salts in sorted(own, key=lambda node: (side[node[0]], node[0])):
            for salt in range(salts):
                if held and held + n / salts > most:
                    cell, held = cell + 1, 0
                cell_of[dim, pivot, salt] = cell
                held += n / salts
    return cell_of, cell + 1


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` candidates with the highest integer
    inner products for every row where ``queries`` holds, out of all rows with another
    id; fewer where there are fewer. Ties go to the smaller id.

    Rows with a null id or vector, or with a null or non-finite component, take no
    part. Vectors are compared with those of their own length. Repeated rows count
    once. Products must fit 64 bits.

    Equal vectors are one point of a tree, with their k + 1 smallest ids: no other of
    them can be among the k best. Points go to their nearest pivot, the top level of
    the tree, and pivots with many points are split into blocks, each with a cover
    tree of its own. Blocks and groups of queries meet in cells of many of either, so
    that a tree is sent once for many others and a query keeps its k best from block to
    block. Groups of queries meet only the cells of pivots that can hold something
    better than the k best of the sample.
    """
    spark = vectors.sparkSession
    rows = (
        vectors.where(usable(F.col(vector_column)) & F.col(id_column).isNotNull())
        .select(
            F.col(id_column).cast("long").alias("row"),
            scaled(F.col(vector_column)).alias("vec"),
            F.coalesce(queries, F.lit(False)).alias("asks"),
        )
        .withColumn("dim", F.size("vec"))
    )
    # The hash only makes sorting cheap.
    same = Window.partitionBy("dim", "hash", "vec").orderBy("row")
    points = materialize(
        rows.select("row", "vec", "dim")
        .distinct()
        .withColumn("hash", F.xxhash64("vec"))
        .withColumn("n", F.row_number().over(same))
        .where(F.col("n") <= k + 1)
        .groupBy("dim", "hash", "vec")
        .agg(F.sort_array(F.collect_list("row")).alias("ids"), F.min("row").alias("row"))
        .drop("hash"),
        "search-points",
    )
    asking = materialize(rows.where("asks").drop("asks").distinct(), "search-queries")

    # Bounded: SAMPLE vectors, and at most MOST_PIVOTS pivots of each length.
    drawn: dict[int, list] = {}
    for r in points.orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect():
        drawn.setdefault(r["dim"], []).append((r["vec"], r["ids"]))
    sample = {
        dim: (np.array([v for v, _ in own], dtype=np.int64).reshape(len(own), dim), _ids_of([ids for _, ids in own]))
        for dim, own in drawn.items()
    }
    n_points, n_queries = points.count(), asking.count()
    wanted = lambda n, most: min(MOST_PIVOTS, max(1, -(-n // most)))
    pivots = {}
    for dim, (own, _) in sample.items():
        centres, _ = net_of(distances(own, own), 0, 0.0, wanted(n_points, BLOCK_ROWS))
        pivots[dim] = own[centres]
    # A coarser level of the same net for the queries, which are fewer.
    coarse = {dim: own[: wanted(n_queries, BLOCK_QUERIES)] for dim, own in pivots.items()}

    placed = "dim int, vec array<bigint>, ids array<bigint>, row bigint, pivot int, away double"
    points = materialize(
        in_batches(points.select("dim", "vec", "ids", "row"), _nearest(pivots), placed),
        "search-placed",
    )
    asking = in_batches(
        asking.select("dim", "vec", F.array("row").alias("ids"), "row"),
        _nearest(coarse),
        placed,
    )
    # One row per pivot and length.
    nodes: dict[int, list] = {}
    for r in points.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect():
        nodes.setdefault(r["dim"], []).append((r["pivot"], r["radius"], r["n"], -(-r["n"] // BLOCK_ROWS)))
    query_cells = max(1, -(-n_queries // CELL_QUERIES))
    cores = spark.sparkContext.defaultParallelism
    cell_rows = min(CELL_ROWS, max(LEAST_CELL_ROWS, -(-n_points * query_cells // (CELLS_PER_CORE * cores))))
    cell_of, n_cells = _cells(nodes, pivots, coarse, cell_rows)
    sent = spark.sparkContext.broadcast((sample, pivots, nodes, cell_of))

    def data_tree(key: tuple, group: pa.Table) -> pa.Table:
        dim, pivot, salt = (value.as_py() for value in key)
        tree = cover_tree(_matrix(group.column("vec"), dim))
        lists = group.column("ids").combine_chunks().take(pa.array(tree.order))
        ids = Ids(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy())
        return pa.table({"cell": pa.array([sent.value[3][dim, pivot, salt]], pa.int32()), "data": [_packed(tree, ids)]})

    def query_tree(key: tuple, group: pa.Table) -> pa.Table:
        sample, pivots, nodes, cell_of = sent.value
        dim = key[0].as_py()
        tree = cover_tree(_matrix(group.column("vec"), dim))
        ids = group.column("row").to_numpy()[tree.order]
        # The kth best of the sample is a bound to begin with.
        floor = Best(ids, k, np.full(len(ids), LEAST))
        if dim in sample:
            own, own_ids = sample[dim]
            floor.offer(np.arange(len(ids)), products(tree.points, own), own_ids, np.arange(len(own)))
        floor = floor.scores[:, -1]
        found = set()
        centre, radius = tree.points[tree.centre[0]].astype(float), tree.radius[0]
        for pivot, reach, _, salts in nodes.get(dim, []):
            ball = pivots[dim][pivot].astype(float) if dim in pivots else np.zeros(dim)
            near = dim not in pivots or _reach(
                centre @ ball, np.linalg.norm(centre), radius, np.linalg.norm(ball), reach
            ) >= floor.min()
            if near:
                found.update(cell_of[dim, pivot, salt] for salt in range(salts))
        return pa.table(
            {"cells": pa.array([sorted(found)], pa.list_(pa.int32())), "asked": [_packed(tree, ids, floor)]}
        )

    cell = (F.col("cell") * query_cells + F.col("part")).alias("cell")
    blocks = (
        _salted(points, BLOCK_ROWS)
        .groupBy("dim", "pivot", "salt")
        .applyInArrow(data_tree, "cell int, data binary")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(query_cells - 1))))
        .select(cell, "data")
    )
    groups = (
        _salted(materialize(asking, "search-asking"), BLOCK_QUERIES)
        .groupBy("dim", "pivot", "salt")
        .applyInArrow(query_tree, "cells array<int>, asked binary")
        .withColumn("part", F.pmod(F.xxhash64("asked"), F.lit(query_cells)).cast("int"))
        .withColumn("cell", F.explode("cells"))
        .select(cell, "asked")
    )

    def search(key: tuple, asked: pa.Table, data: pa.Table) -> pa.Table:
        others = [pickle.loads(packed) for packed in data.column("data").to_pylist()] if asked.num_rows else []
        found = []
        for packed in asked.column("asked").to_pylist() if others else []:
            tree, ids, floor = pickle.loads(packed)
            best = Best(ids, k, floor)
            for other, other_ids in others:
                dual_search(tree, other, other_ids, best)
            row, place = np.nonzero(best.scores > LEAST)
            found.append((ids[row], best.ids[row, place], best.scores[row, place]))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, dtype=np.int64)] * 3
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))

    # A partition for each cell: none has to wait for another.
    partitions = max(1, n_cells * query_cells)
    found = (
        groups.repartitionById(partitions, "cell")
        .groupBy("cell")
        .cogroup(blocks.repartitionById(partitions, "cell").groupBy("cell"))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct()
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
