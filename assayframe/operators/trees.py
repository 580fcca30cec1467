"""Regression trees on the rows of one task, many trees level by level at once."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, fields, replace
from math import log2

import numpy as np

# Random choices come from whole numbers below this prime, so that they are the same
# in every engine and on any partitioning. Products of two stay within 64 bits.
PRIME = 2147483647
# Cumulative Poisson(1) probabilities times the prime: how often a row is drawn.
DRAWN_FROM = [790015084, 1580030169, 1975037711, 2106706892, 2139624187, 2146207646, 2147304889, 2147461638]
# Rows times features of the nodes that are searched at once, few enough for a cache;
# and rows of the trees that are grown at once.
CELLS_AT_ONCE = 1 << 16
ROWS_AT_ONCE = 1 << 19
ROOT_DEPTH = 0


def mixed(a, b):
    """A number below :data:`PRIME` from two of them."""
    x = (a * 48271 + b * 16807 + 1) % PRIME
    x = (x * x + 39373 * x + 7) % PRIME
    return (x * x + 69621 * x + 3) % PRIME


def times_drawn(tree_keys: np.ndarray, row_keys: np.ndarray) -> np.ndarray:
    """How often each row is in the sample of each tree. Every row is drawn by itself,
    as often as in a sample with replacement from very many rows."""
    numbers = mixed(tree_keys[:, None], row_keys[None, :])
    times = np.searchsorted(DRAWN_FROM, numbers, side="right")
    # A sample without any row is the whole table.
    times[times.sum(axis=1) == 0] = 1
    return times


@dataclass(frozen=True)
class TreeParams:
    """What one draw of the search sets. ``features`` are tried for a split."""

    trees: int
    max_depth: int | None
    min_split: int
    min_leaf: int
    features: int
    bootstrap: bool


def features_tried(share: str | float | None, width: int) -> int:
    if share is None:
        return width
    if share == "sqrt":
        return max(1, int(width**0.5))
    if share == "log2":
        return max(1, int(log2(width)))
    return max(1, int(share * width))


def tree_params(drawn: Mapping, width: int) -> TreeParams:
    """Parameters of a draw, by their names in the search grid."""
    named = {name.removeprefix("model__"): value for name, value in drawn.items()}
    known = {"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "max_features", "bootstrap"}
    if set(named) - known:
        raise ValueError(f"unknown parameters: {sorted(set(named) - known)}")
    return TreeParams(
        trees=named.get("n_estimators", 500),
        max_depth=named.get("max_depth"),
        min_split=named.get("min_samples_split", 2),
        min_leaf=named.get("min_samples_leaf", 1),
        features=features_tried(named.get("max_features", 1.0), width),
        bootstrap=named.get("bootstrap", True),
    )


@dataclass
class Nodes:
    """Nodes of one or more trees, parents before children. ``feature`` is -1 at a
    leaf; ``left`` and ``right`` are places in these columns. ``gain`` is what the
    split takes from the weighted sum of squares."""

    root: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    rows: np.ndarray
    weight: np.ndarray
    gain: np.ndarray

    def __len__(self) -> int:
        return len(self.feature)


@dataclass
class Table:
    """Rows of one fit: ``x`` has a line per feature. Labels are taken from ``centre``,
    a whole number near their mean, so that sums of whole labels stay exact."""

    x: np.ndarray
    y: np.ndarray
    keys: np.ndarray
    centre: float

    def __post_init__(self):
        order = np.argsort(self.x, axis=1, kind="stable")
        rank = np.empty(self.x.shape, dtype=np.int32)
        np.put_along_axis(rank, order, np.arange(self.x.shape[1], dtype=np.int32)[None, :], axis=1)
        self.shifted = self.y - self.centre
        # By feature and row, and by feature and rank.
        self.rank, self.flat = rank.reshape(-1), self.x.reshape(-1)
        self.ordered = np.take_along_axis(self.x, order, axis=1).reshape(-1)
        # Splits are told by multiples of a power of two, whose sums are exact in any order:
        # equal splits have equal scores wherever they are computed.
        most = len(DRAWN_FROM) * max(len(self.y), CELLS_AT_ONCE) * np.abs(self.shifted).max(initial=0)
        unit = 2.0 ** (np.ceil(np.log2(most)) - 52) if 0 < most < np.inf else 1.0
        self.label = (np.rint(self.shifted / unit) * unit)[order].reshape(-1)
        # Whether the next one in rank has the same value.
        self.ties = np.append(self.ordered[1:] == self.ordered[:-1], False)


@dataclass
class Open:
    """Nodes still to be split: their rows lie side by side, ``counts`` of each."""

    row: np.ndarray
    times: np.ndarray
    counts: np.ndarray
    key: np.ndarray
    node: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of ranges, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _visits(key: np.ndarray, width: int) -> np.ndarray:
    """Features of each node in the order they are tried in."""
    number = mixed(key[:, None], np.arange(width)[None, :]) << width.bit_length() | np.arange(width)
    number.sort(axis=1)
    return number & (1 << width.bit_length()) - 1


@dataclass
class Splits:
    """Best split so far of each open node."""

    score: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    varied: np.ndarray


def _try_features(table: Table, nodes: Open, which: np.ndarray, order: np.ndarray, best: Splits, least: int):
    """Hold the splits by some features (``order``, a line per node of ``which``, in
    the order of their trial) against the best ones so far."""
    n, counts = len(table.y), nodes.counts[which]
    at = _spread(nodes.starts[which], counts)
    row, times = nodes.row[at], nodes.times[at]
    ends = np.cumsum(counts)
    starts = ends - counts
    own = np.repeat(np.arange(len(which)), counts)
    # A line for each trial: rows in the order of node and rank. Sorted are numbers that
    # hold both, and how often a row is drawn.
    most = int(times.max())
    times_bits = most.bit_length() if most > 1 else 0
    rank_bits = (n - 1).bit_length()
    kind = np.int32 if len(which).bit_length() + rank_bits + times_bits < 32 else np.int64
    base = (order.T * n).take(own, axis=1)
    number = table.rank.take(base + row).astype(kind, copy=False)
    number <<= times_bits
    number |= ((own << rank_bits + times_bits) | (times if times_bits else 0)).astype(kind)
    number.sort(axis=1)
    place = base
    place += number >> times_bits & (1 << rank_bits) - 1
    total = table.label.take(place)
    position = np.arange(1, len(row) + 1) - starts.take(own)
    after = counts.take(own) - position
    if times_bits:
        drawn = (number & (1 << times_bits) - 1).astype(float)
        total *= drawn
        weight = np.cumsum(drawn, axis=1, out=drawn)
        # Whole numbers, the same for each trial.
        upto = weight[0].take(ends - 1)
        weight -= np.append(0.0, upto[:-1]).take(own)
        other_weight = np.diff(upto, prepend=0.0).take(own) - weight
        other_weight[:, ends - 1] = 1
    else:
        weight, other_weight = position.astype(float), np.maximum(after, 1).astype(float)
    left = np.cumsum(total, axis=1, out=total)
    upto = left[0].take(ends - 1)
    left -= np.append(0.0, upto[:-1]).take(own)
    right = np.diff(upto, prepend=0.0).take(own) - left
    left *= left
    left /= weight
    right *= right
    right /= other_weight
    left += right
    left += np.where((position >= least) & (after >= least), 0.0, -np.inf)
    score = left
    low, high = table.ordered.take(place.take(starts, axis=1)), table.ordered.take(place.take(ends - 1, axis=1))
    best.varied[which] |= (low < high).any(axis=0)
    while True:
        # Of equal scores the feature tried first counts, then the lower threshold.
        highest = np.maximum.reduceat(score, starts, axis=1)
        trial = highest.argmax(axis=0)
        top = highest[trial, np.arange(len(which))]
        found = np.flatnonzero((top > -np.inf) & (top > best.score[which]))
        if not len(found):
            return
        hit = np.flatnonzero(score[trial.take(own), np.arange(len(row))] == top.take(own))
        cut = hit[np.searchsorted(hit, starts[found])]
        x, after = table.ordered[place[trial[found], cut]], table.ordered[place[trial[found], cut + 1]]
        if (x < after).all():
            break
        # Neighbours of one value are not parted; most splits don't fall between such.
        tied = np.flatnonzero(table.ties.take(place))
        value = place.reshape(-1)
        tied = tied[tied < value.size - 1]
        score.reshape(-1)[tied[table.ordered[value[tied]] == table.ordered[value[tied + 1]]]] = -np.inf
    trial, node = trial[found], which[found]
    middle = x / 2 + after / 2
    best.score[node] = top[found]
    best.feature[node] = order[found, trial]
    best.threshold[node] = np.where(middle >= after, x, middle)


def _best_splits(table: Table, nodes: Open, params: TreeParams) -> Splits:
    count, width = len(nodes.counts), len(table.x)
    best = Splits(
        np.full(count, -np.inf), np.full(count, -1), np.zeros(count), np.zeros(count, dtype=bool)
    )
    low = 0
    reach = np.cumsum(nodes.counts * params.features)
    while low < count:
        done = reach[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(reach, done + CELLS_AT_ONCE, side="right")))
        which = np.arange(low, high)
        order = _visits(nodes.key[which], width)
        _try_features(table, nodes, which, order[:, : params.features], best, params.min_leaf)
        # Where all of them are constant, further ones are tried until one isn't.
        for further in range(params.features, width):
            flat = ~best.varied[which]
            if not flat.any():
                break
            which, order = which[flat], order[flat]
            _try_features(table, nodes, which, order[:, further : further + 1], best, params.min_leaf)
        low = high
    return best


def grow(table: Table, roots: Open, depth: int, params: TreeParams) -> Nodes:
    """Grow subtrees from nodes of the same depth (their rows have ``times`` > 0).

    A split maximises the decrease of the weighted sum of squares over midpoints of
    neighbouring values. A node stays a leaf at the deepest level, with fewer than
    ``min_split`` rows or twice ``min_leaf``, with a single label, or without a
    feature that varies. Rows count once for these limits, however often drawn.
    """
    parts: list[dict[str, np.ndarray]] = []
    nodes, made = roots, 0
    origin = np.arange(len(roots.counts))
    while len(nodes.counts):
        starts, count = nodes.starts, len(nodes.counts)
        label = table.shifted[nodes.row]
        weight = np.add.reduceat(nodes.times.astype(float), starts)
        total = np.add.reduceat(nodes.times * label, starts)
        open_ = (nodes.counts >= max(params.min_split, 2 * params.min_leaf)) & (
            np.minimum.reduceat(label, starts) < np.maximum.reduceat(label, starts)
        )
        if not len(table.x) or (params.max_depth is not None and depth >= params.max_depth):
            open_[:] = False
        level = {
            "root": origin,
            "feature": np.full(count, -1),
            "threshold": np.zeros(count),
            "left": np.full(count, -1),
            "right": np.full(count, -1),
            "value": total / weight + table.centre,
            "rows": nodes.counts,
            "weight": weight,
            "gain": np.zeros(count),
        }
        parts.append(level)
        kept = np.flatnonzero(open_)
        at = _spread(starts[kept], nodes.counts[kept])
        inner = Open(nodes.row[at], nodes.times[at], nodes.counts[kept], nodes.key[kept], kept)
        best = _best_splits(table, inner, params)
        found = best.feature >= 0
        split = kept[found]
        level["feature"][split] = best.feature[found]
        level["threshold"][split] = best.threshold[found]
        level["gain"][split] = best.score[found] - total[split] ** 2 / weight[split]
        below = made + count + 2 * np.arange(len(split))
        level["left"][split], level["right"][split] = below, below + 1
        made += count
        # Rows of the children, left before right, in the order of the parents.
        at = _spread(starts[split], nodes.counts[split])
        parent = np.repeat(np.arange(len(split)), nodes.counts[split])
        row, times = nodes.row[at], nodes.times[at]
        feature = best.feature[found] * len(table.y)
        right = table.flat.take(feature.take(parent) + row) > best.threshold[found].take(parent)
        sizes = nodes.counts[split]
        upto = np.cumsum(right)
        of_right = np.diff(upto[np.cumsum(sizes) - 1], prepend=0)
        # Rows stay in their order within either child.
        ahead = np.cumsum(of_right) - of_right
        to_right = upto - 1 + np.cumsum(sizes - of_right).take(parent)
        to_left = np.arange(len(row)) - upto + ahead.take(parent)
        order = np.empty(len(row), dtype=np.int64)
        order[np.where(right, to_right, to_left)] = np.arange(len(row))
        keys = nodes.key[split]
        nodes = Open(
            row[order],
            times[order],
            np.stack([sizes - of_right, of_right], axis=1).reshape(-1),
            np.stack([mixed(keys, 0), mixed(keys, 1)], axis=1).reshape(-1),
            below,
        )
        origin = np.repeat(origin[split], 2)
        depth += 1
    names = [f.name for f in fields(Nodes)]
    return Nodes(**{name: np.concatenate([p[name] for p in parts]) for name in names})


def descend(nodes: Nodes, x: np.ndarray, roots: int) -> np.ndarray:
    """Value each subtree gives each row (``x`` with a line per feature): a line per
    subtree. Children lie side by side, as :func:`grow` puts them."""
    n = x.shape[1]
    flat, start = x.reshape(-1), nodes.feature * n
    at = np.repeat(np.arange(roots), n)
    going = np.flatnonzero(nodes.feature.take(at) >= 0)
    here, row = at[going], going % max(1, n)
    while len(going):
        here = nodes.left.take(here) + (flat.take(start.take(here) + row) > nodes.threshold.take(here))
        at[going] = here
        inner = np.flatnonzero(nodes.feature.take(here) >= 0)
        going, here, row = going[inner], here[inner], row[inner]
    return nodes.value.take(at).reshape(roots, n)


def planted(table: Table, seed: int, trees: np.ndarray, bootstrap: bool) -> Open:
    """Roots of some trees of a forest with the rows drawn for them."""
    keys = mixed(np.int64(seed), trees)
    n = len(table.y)
    times = times_drawn(keys, table.keys) if bootstrap else np.ones((len(trees), n), dtype=np.int64)
    which, row = np.nonzero(times)
    return Open(row, times[which, row], np.bincount(which, minlength=len(trees)), keys, np.arange(len(trees)))


def forest(table: Table, params: TreeParams, seed: int, trees: np.ndarray) -> Iterator[tuple[np.ndarray, Nodes]]:
    """The given trees of a forest, as many at once as memory allows."""
    step = max(1, ROWS_AT_ONCE // max(1, len(table.y)))
    for low in range(0, len(trees), step):
        some = trees[low : low + step]
        yield some, grow(table, planted(table, seed, some, params.bootstrap), ROOT_DEPTH, params)


def shared(draws: list[TreeParams], numbers: np.ndarray) -> Iterator[tuple[list[int], TreeParams, np.ndarray]]:
    """Trees that several draws have in common: the places of the draws in the list, what
    to grow them with, and their numbers.

    Draws that differ only in their depth, least rows to split a node and number of trees
    grow the same trees, cut off at different nodes (:func:`cut_off`): what a node
    tries follows from its rows and its way from the top.
    """
    alike: dict[tuple, list[int]] = {}
    for place, params in enumerate(draws):
        alike.setdefault((params.min_leaf, params.features, params.bootstrap), []).append(place)
    for places in alike.values():
        low = 0
        for high in sorted({draws[place].trees for place in places}):
            own = [place for place in places if draws[place].trees >= high]
            depths = [draws[place].max_depth for place in own]
            loosest = replace(
                draws[own[0]],
                max_depth=None if None in depths else max(depths),
                min_split=min(draws[place].min_split for place in own),
            )
            some = numbers[(numbers > low) & (numbers <= high)]
            if len(some):
                yield own, loosest, some
            low = high


def cut_off(nodes: Nodes, params: TreeParams, roots: int) -> Nodes:
    """Whole trees grown with looser limits, as these limits would leave them; what is
    below a node that is now a leaf is not reached any more."""
    stays = nodes.rows >= params.min_split
    if params.max_depth is not None:
        here = np.arange(roots)
        for _ in range(params.max_depth):
            here = here[nodes.feature[here] >= 0]
            here = np.concatenate([nodes.left[here], nodes.right[here]])
        stays[here] = False
    return replace(nodes, feature=np.where(stays, nodes.feature, -1))
