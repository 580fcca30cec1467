from collections import Counter

from assayframe.llm import decontamination
from assayframe.llm.decontamination import contaminated


def words_of(text):
    return (text or "").lower().split()


def shingles(words):
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def plain(docs, items):
    """Every window at every place against every item."""
    found = {}
    for d, text in docs:
        words = words_of(text)
        for i, item in items:
            own = words_of(item)
            if len(own) < 5:
                continue
            wanted, n = shingles(own), len(own)
            for at in range(max(1, len(words) - 4)):
                window = shingles(words[at : at + n])
                shared = sum((window & wanted).values())
                union = sum((window | wanted).values())
                if shared and shared / union >= 0.8 and shared / union > found.get((d, i), (0, 0))[0]:
                    found[d, i] = (shared / union, at)
    return found


def run(spark, docs, items):
    rows = contaminated(
        spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, size int, window int"),
        spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, shingle int"),
    ).collect()
    return {(r["doc_id"], r["item_id"]): (r["similarity"], r["first_word"]) for r in rows}


BASE = [f"w{i}" for i in range(60)]
ITEMS = [
    (1, " ".join(BASE[10:50])),
    (2, "one two three four"),
    (3, None),
    (4, ""),
    (5, "a b c d e"),
    (6, " ".join(["x y"] * 20)),
]


def changed(at):
    words = list(BASE[10:50])
    words[at] = "other"
    return words


def test_cases(spark):
    filler = [f"f{i}" for i in range(30)]
    join = lambda *parts: " ".join(w for p in parts for w in p)
    docs = [
        (1, join(filler, BASE[10:50], filler)),
        (2, join(filler, BASE[10:50]).upper()),
        (3, join(filler, changed(1), filler)),
        (4, join(filler, BASE[10:12], ["new"], BASE[12:50], filler)),
        (5, join(filler, changed(20), filler)),
        (6, "one two three four"),
        (7, None),
        (8, ""),
        (9, "z a b c d e z"),
        (10, join(filler, ["x", "y"] * 20)),
        (11, join(BASE)),
        (None, join(BASE)),
        (1, join(filler, BASE[10:50], filler)),
    ]
    got = run(spark, docs, ITEMS)
    assert got == plain(docs, ITEMS)
    assert {d for d, _ in got} == {1, 2, 3, 4, 9, 10, 11, None}


def test_documents_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    # More near ones than the table has.
    for n, (i, text) in enumerate(items):
        words = text.split()
        words[n % len(words)] = "other"
        docs.append((10_000 + n, " ".join([*docs[n][1].split()[:20], *words, *docs[n][1].split()[20:60]])))
    got, wanted = run(spark, docs, items), {}
    flagged = {d for d, _ in got}
    candidates = [(d, t) for d, t in docs if d in flagged or d >= 10_000 or d % 10 == 0]
    wanted = plain(candidates, items)
    assert got.keys() == wanted.keys()
    assert all(abs(got[k][0] - wanted[k][0]) < 1e-12 for k in wanted)


def test_blocks_find_every_fingerprint_within_the_radius(spark):
    import random

    r = random.Random(3)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    items = [r.getrandbits(64) for _ in range(4)]
    windows = []
    for i in range(300):
        value = items[i % 4]
        for bit in r.sample(range(64), i % 20):
            value ^= 1 << bit
        windows.append(value)
    got = decontamination.near_fingerprints(
        spark.createDataFrame([(str(n), 9, signed(v)) for n, v in enumerate(windows)], "window string, size int, fingerprint long"),
        spark.createDataFrame([(n, 9, signed(v)) for n, v in enumerate(items)], "item_id long, size int, fingerprint long"),
    )
    wanted = {(str(n), i) for n, v in enumerate(windows) for i, w in enumerate(items) if (v ^ w).bit_count() <= 16}
    assert {(x["window"], x["item_id"]) for x in got.collect()} == wanted


def test_nothing(spark):
    assert run(spark, [], ITEMS) == {}
    assert run(spark, [(1, " ".join(BASE))], []) == {}
