import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assayframe.llm import packing, token_files, tokens
from assayframe.llm.queries import TOKENIZER

TEXTS = [
    None,
    "",
    " \n\t",
    "Hello, world. it's we'll don't",
    "a<|endoftext|>b <|ENDOFTEXT|> x.",
    "Émile café naïve x é ́x İSTANBUL ΣΑΣ ß ﬁ",
    "12.5 3,4. ... ,,, a., b,.",
    "漢字 and 😀😀 ‍\x00\x1f\x1c\x85 z",
    "word " * 3000 + "tail",
    "x" * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordEncoder(tokens.read_definition(TOKENIZER))


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), encoder.dtype).tolist()


def plain(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_like_the_library(library, encoder):
    for text in TEXTS * 2:
        assert ids_of(encoder, text) == plain(library, text), text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60).filter(lambda s: not any(0xD800 <= ord(c) < 0xE000 for c in s)))
def test_like_the_library_on_any_text(library, encoder, text):
    assert ids_of(encoder, text) == plain(library, text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    encoder = tokens.WordEncoder(tokens.read_definition(TOKENIZER))
    for text in TEXTS * 3:
        assert ids_of(encoder, text) == plain(library, text)


def test_marks_at_the_end_of_words(library, encoder):
    heads = ["word", "ΑΣ", "Émile", "x1", "don't", "a<|endoftext", "é", "漢", ""]
    tails = [".", "...", "!!", "***", ",&&&", "|>", "'", "'s", "_", "<|", "\u0301", "´."]
    for text in [h + t for h in heads for t in tails]:
        assert ids_of(encoder, text) == plain(library, text), text


def test_words_of_letters_are_encoded_without_the_patterns(library):
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.words = tokenizer, []

        def encode_batch_fast(self, texts, **settings):
            self.words += texts
            return self.tokenizer.encode_batch_fast(texts, **settings)

    encoder = tokens.WordEncoder(tokens.read_definition(TOKENIZER))
    encoder.tokenizer = Counted(encoder.tokenizer)
    text = "Straße façade*** über!! word, end. 12.5 word"
    assert ids_of(encoder, text * 2) == plain(library, text * 2)
    # Only what isn't letters, once; not the words before the marks.
    assert sorted(encoder.tokenizer.words) == ["!!", "***", ",", ".", "12.5"]


def test_columns_with_nulls_and_slices(library, encoder):
    import pyarrow as pa

    column = pa.array(["cut off", *TEXTS, "cut off"], pa.string()).slice(1, len(TEXTS))
    for part in (column, column.cast(pa.large_string())):
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.encode_all(part)]
        assert got == [plain(library, t) for t in TEXTS]
    assert encoder.encode_all([]) == [] and encoder.encode_all([None, ""]) == [b"", b""]


def rows_of(spark, extra=()):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(5, TEXTS[3]), (5, TEXTS[3]), (None, "null id"), *extra]
    return spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, ids int")


def test_files_read_back(spark, library):
    docs = rows_of(spark)
    folder = token_files.new_folder(spark)
    manifest = token_files.write(docs.repartition(4), folder, TOKENIZER, end_id=1)
    got = token_files.read(manifest, folder).collect()
    wanted = {}
    for r in docs.collect():
        wanted.setdefault(r["doc_id"], []).append(plain(library, r["text"]) + [1])
    at, flat = {}, []
    for r in sorted(got, key=lambda r: r["start"]):
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert r["start"] == len(flat) and r["n_tokens"] == len(ids)
        flat += ids
        at.setdefault(r["doc_id"], []).append(ids)
    assert {k: sorted(v) for k, v in at.items()} == {k: sorted(v) for k, v in wanted.items()}
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)


def test_no_files_of_no_rows(spark):
    folder = token_files.new_folder(spark)
    manifest = token_files.write(rows_of(spark).limit(0), folder, TOKENIZER, end_id=1)
    assert token_files.read(manifest, folder).count() == 0


@pytest.mark.parametrize("length", [7, 4096])
def test_pieces_cover_every_id_once(spark, library, length):
    docs = rows_of(spark).where("doc_id IS NULL OR doc_id <> 5")
    pieces = packing.pack(docs.repartition(3), TOKENIZER, 2, length).collect()
    ids = {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        own = ids.setdefault(r["doc_id"], [])
        assert r["start"] == len(own)
        piece = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(piece) == r["length"] > 0
        own += piece
    assert ids == {r["doc_id"]: plain(library, r["text"]) + [2] for r in docs.collect()}
    assert all(r["doc_tokens"] == len(ids[r["doc_id"]]) for r in pieces)
    filled = {}
    for r in sorted(pieces, key=lambda r: r["offset"]):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(filled) == list(range(len(filled)))
    assert all(filled[s] == length for s in range(len(filled) - 1))
    assert filled[len(filled) - 1] <= length


def test_packing_copies_and_nothing(spark):
    docs = spark.createDataFrame([(i, "same text") for i in range(50)], "doc_id long, text string")
    pieces = packing.pack(docs, TOKENIZER, 2, 16).collect()
    assert sum(r["length"] for r in pieces) == 50 * pieces[0]["doc_tokens"]
    assert packing.pack(docs.limit(0), TOKENIZER, 2).count() == 0


def test_blocks_of_batches_keep_all_rows():
    import pyarrow as pa

    from assayframe.llm.common import in_blocks

    batches = [pa.record_batch({"x": pa.array(range(i, i + 5), pa.int64())}) for i in range(0, 35, 5)]
    blocks = list(in_blocks(iter(batches), 100))
    assert [b.num_rows for b in blocks] == [15, 15, 5]
    assert [x for b in blocks for x in b["x"].to_pylist()] == list(range(35))
    assert list(in_blocks(iter([]), 100)) == []


def test_curve_keys_do_not_depend_on_the_width_of_ids():
    documents = [np.array(ids, "<u2") for ids in ([1, 2, 3, 2], [49407], [5] * 300)]
    projection = packing._projection()
    wide = packing.curve_keys([ids.astype("<u4") for ids in documents], projection)
    assert (packing.curve_keys(documents, projection) == wide).all()


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_crc_in_sql_is_that_of_python(spark):
    from pyspark.sql import functions as F

    data = np.array([1, 49407], "<u4").tobytes()
    frame = spark.createDataFrame([(bytearray(data),)], "ids binary")
    assert frame.select(F.crc32("ids")).first()[0] == zlib.crc32(data)
