"""Merkle manifest of a dataset, with a witness for every row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayframe.sources.scratch import materialize

# Leaves of an aligned block are 2 ** BLOCK_LEVELS, all that one task holds at once.
BLOCK_LEVELS = 10
STEP = "struct<sibling: string, left: boolean>"
WITNESSED = f"grp string, block long, place long, root string, path array<{STEP}>"


def digest(*parts: str) -> str:
    """Lower-case hex SHA-256 of the parts one after another."""
    return sha256("".join(parts).encode()).hexdigest()


class WitnessTree:
    """Appends leaves from left to right and keeps a witness for each.

    ``open`` has the finished subtrees that have no sibling yet, widest first. A leaf
    starts as a subtree of its own; whenever the two last subtrees are equally high
    they become one, and the witnesses of all their leaves get the other's root. A
    witness is a list of ``(sibling, sibling is to the left)``, ``(None, False)`` where
    a node had none.
    """

    def __init__(self) -> None:
        self.open: list[tuple[int, int, str]] = []  # level, first leaf, root
        self.witnesses: list[list[tuple[str | None, bool]]] = []

    def append(self, leaf: str) -> None:
        self.open.append((0, len(self.witnesses), leaf))
        self.witnesses.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        _, middle, right = self.open.pop()
        level, first, left = self.open.pop()
        for witness in self.witnesses[first:middle]:
            witness.append((right, False))
        for witness in self.witnesses[middle:]:
            witness.append((left, True))
        self.open.append((level + 1, first, digest(left, right)))

    def _lift(self) -> None:
        """The last subtree has no sibling on its level."""
        level, first, root = self.open.pop()
        for witness in self.witnesses[first:]:
            witness.append((None, False))
        self.open.append((level + 1, first, digest(root)))

    def close(self, level: int | None = None) -> str:
        """Root once no leaf follows: of all leaves, or of the subtree of ``level``
        that further blocks of leaves lie beside."""
        while len(self.open) > 1:
            if self.open[-1][0] == self.open[-2][0]:
                self._join()
            else:
                self._lift()
        while level is not None and self.open[0][0] < level:
            self._lift()
        return self.open[0][2]


def fold(leaf: str, path: Iterable[tuple[str | None, bool]]) -> str:
    """Root that a leaf and its witness lead to."""
    for sibling, left in path:
        if sibling is None:
            leaf = digest(leaf)
        else:
            leaf = digest(sibling, leaf) if left else digest(leaf, sibling)
    return leaf


def encoded(column: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in columns]).cast("binary"), 256)


def group_key(column: Column) -> Column:
    """Text that orders as the group does, UTF-8 bytewise with null first; never null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def placed(nodes: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """Add ``place``, counted from 0 in every group, and ``total``, its size.

    One range sort over groups and order together, so a large group lies in many
    partitions; what lies before a partition comes from sums over a row per partition
    and group. The sorted rows are stored first, so that their places stay the same
    when a task is repeated.
    """
    keys = [group, *order]
    dealt = nodes.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = materialize(
        dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")),
        name,
    )
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        stored.groupBy(group, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
        .select(
            group,
            "_part",
            "_first",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"),
            F.sum("_n").over(Window.partitionBy(group)).alias("total"),
        )
    )
    return (
        stored.join(bases, [group, "_part"])
        .withColumn("place", F.col("_base") + F.col("_at") - F.col("_first"))
        .drop("_part", "_at", "_first", "_base")
    )


def _appended(levels: int, kept: pa.Schema, row: Callable) -> Callable[[pa.Table], pa.Table]:
    """One aligned block: its leaves appended in order, then closed."""

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("place")
        tree = WitnessTree()
        for leaf in block.column("digest").to_pylist():
            tree.append(leaf)
        whole = block.column("total")[0].as_py() <= 1 << levels
        root = tree.close(None if whole else levels)
        return row(block, tree.witnesses, root).cast(kept)

    return run


def _node_rows(levels: int):
    kept = pa.schema(
        [
            ("grp", pa.string()),
            ("block", pa.int64()),
            ("place", pa.int64()),
            ("root", pa.string()),
            ("path", pa.list_(pa.struct([("sibling", pa.string()), ("left", pa.bool_())]))),
        ]
    )

    def row(block: pa.Table, witnesses: list, root: str) -> pa.Table:
        paths = [[{"sibling": s, "left": left} for s, left in path] for path in witnesses]
        return pa.table(
            [
                block.column("grp"),
                block.column("block"),
                block.column("place"),
                pa.array([root] * block.num_rows, pa.string()),
                pa.array(paths, kept.field("path").type),
            ],
            schema=kept,
        )

    return _appended(levels, kept, row)


def _leaf_rows(levels: int):
    kept = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("grp", pa.string()),
            ("block", pa.int64()),
            ("total", pa.int64()),
            ("digest", pa.string()),
            ("root", pa.string()),
            ("siblings", pa.binary()),
            ("folded", pa.string()),
        ]
    )

    def row(block: pa.Table, witnesses: list, root: str) -> pa.Table:
        given = block.column("given").to_pylist()
        return pa.table(
            [
                block.column("doc_id"),
                block.column("grp"),
                block.column("block"),
                block.column("total"),
                block.column("digest"),
                pa.array([root] * block.num_rows, pa.string()),
                pa.array([bytes.fromhex("".join(s or "" for s, _ in path)) for path in witnesses]),
                pa.array([fold(leaf, path) for leaf, path in zip(given, witnesses)], pa.string()),
            ],
            schema=kept,
        )

    return _appended(levels, kept, row)


def _rounds(nodes: DataFrame, levels: int, name: str) -> tuple[DataFrame, DataFrame]:
    """Witnesses of ``grp, place, total, digest`` up to the root of their group, and
    the roots.

    Blocks become roots, which are appended in the next round like leaves, until a
    group is one block: a round for every ``levels`` levels. Returns
    ``grp, place, path`` and ``grp, root``.
    """
    paths, upper, unfinished = [], nodes, True
    while unfinished:
        blocked = upper.withColumn("block", F.shiftright("place", levels))
        done = materialize(
            blocked.groupBy("grp", "block").applyInArrow(_node_rows(levels), WITNESSED), f"{name}-{len(paths)}"
        )
        paths.append(done)
        upper = (
            done.groupBy("grp", F.col("block").alias("place"))
            .agg(F.first("root").alias("digest"))
            .join(done.groupBy("grp").agg((F.max("block") + 1).alias("total")), "grp")
            .select("grp", "place", "total", "digest")
        )
        # A group that is done goes through further rounds as the only leaf of its tree.
        unfinished = not upper.where("total > 1").isEmpty()
    roots = upper.select("grp", F.col("digest").alias("root"))
    whole = paths[-1].select("grp", "place", "path")
    for below in reversed(paths[:-1]):
        further = whole.select("grp", F.col("place").alias("block"), F.col("path").alias("further"))
        whole = below.join(further, ["grp", "block"]).select(
            "grp", "place", F.concat("path", "further").alias("path")
        )
    return whole, roots


def _folded(leaf: Column, path: Column) -> Column:
    return F.aggregate(
        path,
        leaf,
        lambda at, step: F.sha2(
            F.when(step["sibling"].isNull(), at)
            .when(step["left"], F.concat(step["sibling"], at))
            .otherwise(F.concat(at, step["sibling"]))
            .cast("binary"),
            256,
        ),
    )


def manifest(leaves: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """Witness every row of ``doc_id, grp, digest, given``.

    ``grp`` is a :func:`group_key`; in every group leaves ascend by ``doc_id``, then
    digest (null ids first), and their binary tree has a subroot, the subroots in the
    order of the groups the root. Returns ``doc_id, grp, leaf, subroot, root,
    proof_sha256, folded_root, verified``: the hash of all siblings from the leaf to
    the root, and the root that ``given`` (the leaf as it is found now) leads to by
    the witness of the leaf as it was.

    Equal rows are leaves of their own, side by side. No row gives no rows. A group of
    one leaf has that leaf as its subroot, and a single subroot is the root.

    A block of ``2 ** levels`` leaves is appended by one task; its root is appended in
    the next round among the roots of its group. Rows are sorted and grouped as
    digests, never with their texts.
    """
    ranked = placed(
        leaves.select(F.col("doc_id").cast("long").alias("doc_id"), "grp", "digest", "given"),
        "grp",
        ["doc_id", "digest"],
        "merkle-sorted",
    )
    blocked = ranked.withColumn("block", F.shiftright("place", levels))
    lowest = materialize(
        blocked.groupBy("grp", "block").applyInArrow(
            _leaf_rows(levels),
            "doc_id long, grp string, block long, total long, digest string, root string,"
            " siblings binary, folded string",
        ),
        "merkle-blocks",
    )
    blocks = lowest.groupBy("grp", F.col("block").alias("place")).agg(
        F.first("root").alias("digest"),
        F.first(F.shiftright(F.col("total") - 1, levels) + 1).alias("total"),
    )
    paths, subroots = _rounds(blocks.select("grp", "place", "total", "digest"), levels, "merkle-roots")
    groups = placed(
        subroots.select(F.lit("").alias("grp"), F.col("grp").alias("member"), F.col("root").alias("digest")),
        "grp",
        ["member"],
        "merkle-groups",
    )
    group_paths, root = _rounds(groups.select("grp", "place", "total", "digest"), levels, "merkle-root")
    upper = (
        groups.select("grp", "member", "place", F.col("digest").alias("subroot"))
        .join(group_paths.select("grp", "place", F.col("path").alias("further")), ["grp", "place"])
        .join(root, "grp")
        .select(F.col("member").alias("grp"), "subroot", "further", "root")
    )
    above = paths.join(upper, "grp").select(
        "grp",
        F.col("place").alias("block"),
        F.concat("path", "further").alias("path"),
        "subroot",
        F.col("root").alias("whole_root"),
    )
    text = F.concat(
        F.lower(F.hex("siblings")),
        F.array_join(F.filter(F.col("path")["sibling"], lambda s: s.isNotNull()), ""),
    )
    folded = _folded(F.col("folded"), F.col("path"))
    return (
        lowest.join(above, ["grp", "block"])
        .select(
            "doc_id",
            "grp",
            F.col("digest").alias("leaf"),
            "subroot",
            F.col("whole_root").alias("root"),
            F.sha2(text.cast("binary"), 256).alias("proof_sha256"),
            folded.alias("folded_root"),
        )
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )


def document_leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """Leaves of documents for :func:`manifest`; ``given`` is the leaf with one more
    character in ``n_chars`` where ``tampered`` holds (a null count stays null)."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    columns = [F.col(c) for c in fields]
    other = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in fields]
    return materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            group_key(F.col("lang")).alias("grp"),
            leaf_digest(columns).alias("digest"),
            F.when(tampered, leaf_digest(other)).alias("other"),
        ).withColumn("given", F.coalesce("other", "digest")).drop("other"),
        "merkle-leaves",
    )
