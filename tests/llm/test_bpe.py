import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from corpus import SF, prose
from pyspark.sql import functions as F

from starmill.llm import bpe
from starmill.llm.queries import QUERIES

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding(
    "whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_whole_table_matches_the_library(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op12_bpe"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == sha(",".join(map(str, ids)).encode())
        assert r.decoded_sha256 == sha(texts[r.doc_id].encode())


@pytest.fixture
def unclean():
    draw = random.Random(5)
    odd = [chr(c) for c in [*range(0, 256), 0x1680, 0x2028, 0x202F, 0x3000, 0xFEFF, 0x200B, 0x1F600,
                            0x4E00, 0x660, 0xBD, 0x2160, 0x300, 0x10FFFF]]
    wild = ["".join(draw.choices([*odd, " ", "'s", "'ll", "ab"], k=draw.randint(0, 40)))
            for _ in range(300)]
    texts = [None, "", " ", "\n\n  x  \n", "a" * 200_000, "ab " * 50_000, "<|endoftext|>", *wild,
             prose(1, 400), prose(1, 400), "It's we'll  don't ''s", " " * 5000 + "end"]
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(texts)]
    return rows + rows[:5]


def test_packed_numbers_come_back():
    values = np.array([0, 1, 255, 256, 1 << 24, (1 << 32) - 1])
    assert (bpe.unpacked(bpe.packed(values[:2], values[2:])) == values).all()
    assert bpe.unpacked(bpe.packed(values[:0])).size == 0


@pytest.mark.parametrize("chunk_bytes", [1, 3000, 1 << 25])
def test_unclean_rows_in_chunks_of_any_size(spark, unclean, chunk_bytes):
    rows = [(k, t, "x", 1, [1], b"") for k, t in unclean]
    schema = "doc_id long, text string, word string, chunk int, ids array<int>, keys binary"
    docs = spark.createDataFrame(rows, schema)
    found = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk_bytes=chunk_bytes)
    assert found.columns == ["doc_id", "ids"]
    back = bpe.with_decoded(found, RANKS).collect()
    expected = [(k, tuple(LIBRARY.encode_ordinary(t or "")), (t or "").encode()) for k, t in unclean]
    assert sorted([(r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in back], key=repr) == sorted(
        expected, key=repr
    )


def test_long_texts_are_cut_in_portions(monkeypatch):
    text = prose(2, 3000)
    pattern = bpe.regex.compile(public_tokenizers.PATTERN)
    whole = pattern.findall(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    monkeypatch.setattr(bpe, "PORTION", 7)
    portions = list(bpe.pre_tokens(pattern, text))
    assert max(map(len, portions)) == 7 and [w for p in portions for w in p] == whole


def test_empty_table_and_other_keys(spark):
    docs = spark.createDataFrame([("k1", "one two"), ("k1", "one two")], "name string, body string")
    rows = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, "name", "body").collect()
    assert [(r.name, r.ids) for r in rows] == [("k1", LIBRARY.encode_ordinary("one two"))] * 2
    assert bpe.encode(docs.limit(0), RANKS, public_tokenizers.PATTERN, "name", "body").count() == 0


def test_unknown_and_missing_ids_decode_to_null(spark):
    lists = [None, [], [1, 2], [len(RANKS) + 5], [-1, 3], [4, None]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, ids array<int>")
    rows = {r.i: r.decoded for r in bpe.with_decoded(df, RANKS).collect()}
    by_id = {v: k for k, v in RANKS.items()}
    assert {k: None if v is None else bytes(v) for k, v in rows.items()} == {
        0: None, 1: b"", 2: by_id[1] + by_id[2], 3: None, 4: None, 5: None
    }


def test_sequences_stay_where_they_are_stored(spark):
    docs = spark.createDataFrame([(i, prose(i, 50)) for i in range(40)], "doc_id long, text string")
    text = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, chunk_bytes=500)
    plan = text._sc._jvm.PythonSQLUtils.explainString(text._jdf.queryExecution(), "simple")
    moved = [line for line in plan.split("\n") if "Exchange" in line]
    assert len(moved) == 2 and not any("numbers" in line for line in moved)


def test_words_and_ids_are_taken_in_portions(monkeypatch):
    found = bpe._Found()
    found.chunks, found.numbers = [np.array([7, 3, 7])], [np.array([5, 0, 2])]
    found.ids = [[9, 8], [1], []]
    rows = found.batch().to_pylist()
    assert [(r["chunk"], r["count"], bpe.unpacked(r["found"]).tolist()) for r in rows] == [
        (3, 1, [0, 1, 1]), (7, 2, [2, 3, 0, 2, 9, 8])
    ]
    table = bpe.pa.array([b"a", None, b"bc", None], bpe.pa.large_binary())
    lists = bpe.pa.array([[0, 2, 2, 0, 0], [], None, [2, 0, 1]], bpe.pa.list_(bpe.pa.int32()))
    monkeypatch.setattr(bpe, "IDS", 2)
    assert bpe.look_up(lists, table).to_pylist() == [b"abcbcaa", b"", None, None]


def test_a_vocabulary_beyond_the_bound_is_refused(spark, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY", 10)
    with pytest.raises(ValueError):
        bpe.decoded(spark.range(1), RANKS, F.array(F.lit(1)))
