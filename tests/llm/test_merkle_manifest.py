import zlib

import pytest
from pyspark.sql import functions as F

from assayframe.llm import merkle_manifest as merkle
from assayframe.llm.common import crc_of_id

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return merkle.digest(*[field(row[f]) for f in FIELDS])


def levels_of(nodes):
    found = [nodes]
    while len(nodes) > 1:
        nodes = [merkle.digest(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        found.append(nodes)
    return found


def path_of(levels, place):
    path = []
    for nodes in levels[:-1]:
        other = place ^ 1
        path.append((nodes[other] if other < len(nodes) else None, other < place))
        place //= 2
    return path


def brute_force(rows):
    """Whole trees of plain lists."""
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, places = {}, {}
    for lang in langs:
        own = [r for r in rows if r["lang"] == lang]
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r)))
        places[lang], trees[lang] = own, levels_of([leaf_of(r) for r in own])
    top = levels_of([trees[lang][-1][0] for lang in langs])
    found = []
    for number, lang in enumerate(langs):
        for place, row in enumerate(places[lang]):
            path = path_of(trees[lang], place) + path_of(top, number)
            touched = zlib.crc32(("" if row["doc_id"] is None else str(row["doc_id"])).encode()) % 7 == 0
            changed = touched and row["n_chars"] is not None
            given = leaf_of({**row, "n_chars": row["n_chars"] + 1}) if changed else leaf_of(row)
            folded = merkle.fold(given, path)
            root = top[-1][0]
            proof = merkle.digest(*[s for s, _ in path if s])
            found.append((row["doc_id"], leaf_of(row), trees[lang][-1][0], root, proof, folded, folded == root))
            assert (folded == root) == (not changed)
    return sorted(found, key=repr)


def run(spark, rows, levels, extra=False):
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    if extra:
        for name in ("grp", "place", "digest", "root", "block", "leaf", "_part", "given"):
            docs = docs.withColumn(name, F.lit("other"))
    leaves = merkle.document_leaves(docs, crc_of_id(F.col("doc_id")) % 7 == 0)
    found = merkle.manifest(leaves, levels).drop("grp").collect()
    return sorted([tuple(r) for r in found], key=repr)


def row(doc_id, lang="en", text="some text", source="s", n_chars=9):
    return dict(doc_id=doc_id, text=text, lang=lang, source=source, n_chars=n_chars)


ODD = [
    row(None),
    row(None, lang=None, text=None, source=None, n_chars=None),
    row(3, lang=None, text=""),
    row(3, lang="é", text="ünï\ncode"),
    row(3, lang="é", text="ünï\ncode"),
    row(-4, lang="z", n_chars=None),
    row(5, lang="Z", text="x" * 300_000),
    row(6, lang=""),
]


def test_rows_with_nulls_ties_and_repeats(spark):
    for levels in (1, 10):
        assert run(spark, ODD, levels, extra=True) == brute_force(ODD)


@pytest.mark.parametrize("sizes", [[1], [2], [3], [37], [16, 17, 1], [8, 1, 1, 1, 1, 1]])
def test_blocks_in_rounds(spark, sizes):
    rows = [
        row(100 * g + i, lang=f"l{g}", text=f"text {i}") for g, size in enumerate(sizes) for i in range(size)
    ]
    assert run(spark, rows, 2) == brute_force(rows)


def test_no_rows(spark):
    assert run(spark, [], 3) == []


def test_a_witness_grows_with_its_tree():
    tree = merkle.WitnessTree()
    leaves = [merkle.digest(str(i)) for i in range(11)]
    for number, leaf in enumerate(leaves, start=1):
        tree.append(leaf)
        # A leaf's witness reaches the root of the open subtree that holds it.
        for (_, first, root), after in zip(tree.open, [x[1] for x in tree.open[1:]] + [number]):
            for i in range(first, after):
                assert merkle.fold(leaves[i], tree.witnesses[i]) == root
    root = tree.close()
    assert root == levels_of(leaves)[-1][0]
    assert [merkle.fold(x, w) for x, w in zip(leaves, tree.witnesses)] == [root] * 11
    assert tree.witnesses == [path_of(levels_of(leaves), i) for i in range(11)]


def test_a_changed_row_fails(spark):
    rows = [row(i, lang="en" if i % 3 else "fr") for i in range(40)]
    found = run(spark, rows, 3)
    failed = {r[0] for r in found if not r[-1]}
    assert failed == {i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0} != set()
