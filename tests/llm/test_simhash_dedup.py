import numpy as np
import xxhash

from assayframe.llm import simhash_dedup
from assayframe.llm.simhash_dedup import as_hex, classes, components, fingerprints


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """Smallest id reachable over links of at most three bits; prints: id to bits."""
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints(spark):
    texts = [None, "", "  \n", "One", "one TWO", "a b c", "a b c d a b c d", "É é x\u00a0y z", "w " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["hex"] for r in fingerprints(docs).select("doc_id", as_hex(simhash_dedup.F.col("fingerprint")).alias("hex")).collect()}
    assert got == {i: f"{plain_fingerprint(t):016x}" for i, t in enumerate(texts)}


def test_classes_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in classes(fingerprints(docs)).collect()}
    plain = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.collect()}
    assert got == plain_classes(plain)


def check_classes(spark, prints):
    rows = spark.createDataFrame([(i, signed(p)) for i, p in prints.items()], "doc_id long, fingerprint long")
    got = {r["doc_id"]: r["component_id"] for r in classes(rows).collect()}
    assert got == plain_classes(prints)


def near_group(n, centre=0x0123456789ABCDEF):
    random = np.random.default_rng(8)
    prints = {}
    for i in range(n):
        value = centre
        for bit in random.integers(0, 64, random.integers(0, 5)):
            value ^= 1 << int(bit)
        prints[i * 7 % 1009] = value
    return prints


def test_classes_of_a_dense_group_and_chains(spark):
    prints = near_group(300)
    chain = 0
    for i in range(20):
        chain ^= 0b111 << (3 * i)
        prints[5000 - i] = chain
    check_classes(spark, prints)


def test_classes_with_split_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CELL_ROWS", 5)
    check_classes(spark, near_group(200))


def test_nulls_repeats_and_none(spark):
    rows = spark.createDataFrame([(None, 5), (None, 9 << 40), (3, 5), (3, 5)], "doc_id long, fingerprint long")
    got = sorted((r["fingerprint"], r["doc_id"] or -1, r["component_id"]) for r in classes(rows).collect())
    # 5 and 9 << 40 differ in four bits.
    assert got == [(5, -1, 3), (5, 3, 3), (5, 3, 3), (9 << 40, -1, None)]
    assert classes(rows.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}
