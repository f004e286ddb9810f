"""Byte-level BPE: token ids of whole texts, and back.

Encoding is a global shuffle of distinct words:

1. The pattern cuts each text into pre-tokens. Texts are taken together in chunks of about
   ``CHUNK_BYTES``; a chunk numbers its distinct pre-tokens, the frequent ones first, so its texts
   are sequences of numbers (the positions) and its words stand in the shuffle once, however often
   they occur. The chunks are stored, hashed into buckets by their id.
2. The chunks' words are exploded with their numbers and dealt out by word. Equal words meet there:
   each distinct word is encoded once and its ids are joined to all its rows in one sorted pass. A
   task packs what it found for the same chunk into one row (at most ``PACK`` words at a time).
3. The ids go back to the chunk's bucket, where every text is put together by position. The
   sequences themselves never move: the bucketed table is read in place.

A word is in at most one row per chunk, so the most frequent word is no hot key, and no step holds
more than a chunk. Decoding looks every id up in the token-byte table, whose size is the
vocabulary's (at most ``MAX_VOCABULARY``, checked); that table alone is broadcast.

Defined results: a null text is an empty text (no ids); null, repeated and equal keys are carried, one
result per row; extra columns are ignored by ``encode`` and kept by ``with_decoded``; an empty table
gives an empty result. Null ids decode to null, and so do ids with one that the table lacks. A text
longer than a chunk is a chunk of its own, cut into pre-tokens portion by portion. The merges are
the ``tiktoken`` library's, word by word.
"""

from __future__ import annotations

import base64
import itertools
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starmill.llm.words import WordNumbers
from starmill.sources.workdir import fresh_path

CHUNK_BYTES = 32 << 20
MAX_VOCABULARY = 2_000_000
LONG_TEXT = 1 << 20  # characters; a longer text's pre-tokens are listed in portions
PORTION = 1 << 16
PACK = 1 << 20
IDS = 1 << 20  # ids that are put together or looked up at a time

_encodings: dict[str, tiktoken.Encoding] = {}
_tables: dict[str, pa.Array] = {}


@dataclass(frozen=True)
class Vocabulary:
    """Ranks that all tasks share; workers keep what they derive from them by ``name``."""

    name: str
    ranks: Broadcast


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of base64 bytes and a number. A vocabulary, read by the driver."""
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines)
        return {base64.b64decode(p[0]): int(p[1]) for p in pairs if p}


def _shared(df: DataFrame, ranks: Mapping[bytes, int]) -> Vocabulary:
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {len(ranks)} tokens is beyond {MAX_VOCABULARY}")
    return Vocabulary(uuid.uuid4().hex, df.sparkSession.sparkContext.broadcast(dict(ranks)))


def pre_tokens(pattern: regex.Pattern, text: str) -> Iterator[list[str]]:
    """The matches in order, a portion at a time."""
    if len(text) <= LONG_TEXT:
        yield pattern.findall(text)
        return
    matches = (m.group() for m in pattern.finditer(text))
    while portion := list(itertools.islice(matches, PORTION)):
        yield portion


def packed(*values: np.ndarray) -> bytes:
    """Whole numbers in compressed planes: all lowest bytes first, all highest last."""
    flat = np.concatenate(values).astype("<u4")
    return zstandard.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


class _Chunk:
    """Texts that share one numbering of their pre-tokens."""

    def __init__(self) -> None:
        self.numbers, self.texts, self.bytes = WordNumbers(), [], 0
        self.keys: list[pa.Array] = []

    def add(self, pattern: regex.Pattern, text: str) -> None:
        parts = [self.numbers.of(p).astype(np.int32) for p in pre_tokens(pattern, text)]
        self.texts.append(np.concatenate(parts) if parts else np.empty(0, np.int32))
        self.bytes += len(text.encode())

    def row(self, number: int) -> pa.RecordBatch:
        flat = np.concatenate(self.texts)
        order = np.argsort(-np.bincount(flat, minlength=len(self.numbers)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        words = list(self.numbers)
        keys = pa.concat_arrays(self.keys)
        columns = [
            pa.array([number], pa.int64()),
            pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
            pa.array([[len(t) for t in self.texts]], pa.list_(pa.int32())),
            pa.array([packed(rank[flat])], pa.binary()),
            pa.array([[words[i] for i in order.tolist()]], pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "keys", "sizes", "numbers", "words"])


def chunks(docs: DataFrame, pattern: str, limit: int) -> DataFrame:
    """``docs(key, text)`` as chunks: ``chunk``, ``keys``, ``sizes`` (pre-tokens of each text),
    ``numbers`` (all pre-tokens of all its texts, packed) and ``words`` (by number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        ids = itertools.count(TaskContext.get().partitionId() << 32)
        chunk = _Chunk()
        for batch in batches:
            keys, first = batch.column(0), 0
            for i, text in enumerate(batch.column(1)):
                chunk.add(compiled, text.as_py() or "")
                if chunk.bytes >= limit:
                    chunk.keys.append(keys.slice(first, i + 1 - first))
                    yield chunk.row(next(ids))
                    chunk, first = _Chunk(), i + 1
            if first < batch.num_rows:
                chunk.keys.append(keys.slice(first))
        if chunk.texts:
            yield chunk.row(next(ids))

    key = docs.schema["key"].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()),
        T.StructField("keys", T.ArrayType(key)),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("numbers", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.StringType())),
    ])
    return docs.mapInArrow(run, schema)


def in_buckets(df: DataFrame, by: str, label: str) -> DataFrame:
    """Write ``df`` into the shared work folder, hashed into buckets by the column ``by``, and
    return a scan of it. A join or cogroup on that column moves only the other side. The catalog
    knows the table only until the scan is planned; its files stay."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = df.write.option("path", fresh_path(spark, label)).option("compression", "zstd")
    writer.bucketBy(buckets, by).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return stored


def _encoding(vocabulary: Vocabulary) -> tiktoken.Encoding:
    """One per worker and vocabulary; its pattern takes any word as a whole."""
    if vocabulary.name not in _encodings:
        _encodings[vocabulary.name] = tiktoken.Encoding(
            "words", pat_str="(?s:.+)", mergeable_ranks=vocabulary.ranks.value, special_tokens={}
        )
    return _encodings[vocabulary.name]


class _Found:
    """Ids of words, gathered for their chunks."""

    def __init__(self) -> None:
        self.chunks: list[np.ndarray] = []
        self.numbers: list[np.ndarray] = []
        self.ids: list[list[int]] = []

    def batch(self) -> pa.RecordBatch:
        """A row per chunk; the ids are in the order of the words' numbers."""
        chunk, number = np.concatenate(self.chunks), np.concatenate(self.numbers)
        order = np.lexsort((number, chunk))
        chunk, number = chunk[order], number[order]
        bounds = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
        rows = []
        for a, b in itertools.pairwise(bounds):
            own = [self.ids[i] for i in order[a:b].tolist()]
            sizes = np.fromiter(map(len, own), np.int64, b - a)
            flat = np.fromiter(itertools.chain.from_iterable(own), np.int64, sizes.sum())
            rows.append(packed(np.diff(number[a:b], prepend=0), sizes, flat))
        columns = [
            pa.array(chunk[bounds[:-1]]), pa.array(np.diff(bounds), pa.int64()),
            pa.array(rows, pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "count", "found"])


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Rows of ``chunk``, ``count`` and ``found`` (that many word numbers, as steps, then the sizes
    of their ids, then these, packed) for rows of ``chunk``, ``no`` and ``word``."""
    dealt = words.repartition("word").sortWithinPartitions("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(vocabulary)
        last, ids, found = None, [], _Found()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, ids = word, encoding.encode_ordinary(word)
                found.ids.append(ids)
            found.chunks.append(np.asarray(batch.column("chunk")))
            found.numbers.append(np.asarray(batch.column("no")).astype(np.int64))
            if len(found.ids) >= PACK:
                yield found.batch()
                found = _Found()
        if found.ids:
            yield found.batch()

    return dealt.mapInArrow(run, "chunk long, count long, found binary")


def assemble(chunk: pa.Table, encoded: pa.Table) -> pa.Table:
    """The texts' ids, from one chunk and the ids of its words."""
    numbers, sizes, ids = [], [], []
    for count, blob in zip(encoded["count"].to_pylist(), encoded["found"].to_pylist()):
        steps, own, rest = np.split(unpacked(blob), [count, 2 * count])
        numbers.append(np.cumsum(steps, dtype=np.int64))
        sizes.append(own.astype(np.int64))
        ids.append(rest.astype(np.int32))
    order = np.argsort(np.concatenate([*numbers, np.empty(0, np.int64)]))
    sizes = np.concatenate([*sizes, np.empty(0, np.int64)])
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes, ids = sizes[order], np.concatenate([*ids, np.empty(0, np.int32)])
    sequence = unpacked(chunk["numbers"][0].as_py())
    keys = chunk["keys"].combine_chunks().flatten()
    texts, held, at, batches, done = [], 0, 0, [], 0
    counts = chunk["sizes"][0].as_py()
    for i, count in enumerate(counts, 1):
        own = sequence[at : at + count]
        at += count
        each = sizes[own]
        ends = np.cumsum(each)
        within = np.arange(ends[-1] if count else 0) - np.repeat(ends - each, each)
        texts.append(ids[np.repeat(starts[own], each) + within])
        held += len(within)
        if held >= IDS or i == len(counts):  # small batches for the way back
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            lists = pa.ListArray.from_arrays(
                pa.array(offsets, pa.int32()), pa.array(np.concatenate(texts), pa.int32())
            )
            batches.append(pa.record_batch([keys.slice(done, i - done), lists], ["key", "ids"]))
            texts, held, done = [], 0, i
    pa.default_memory_pool().release_unused()
    return pa.Table.from_batches(batches)


def encode(
    docs: DataFrame,
    ranks: Mapping[bytes, int],
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each whole text, one row per document."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    shared = _shared(docs, ranks)
    stored = in_buckets(chunks(narrow, pattern, chunk_bytes), "chunk", "chunks")
    words = stored.select("chunk", F.posexplode("words").alias("no", "word"))
    encoded = encode_words(words, shared)
    kind = T.StructType([
        T.StructField("key", narrow.schema["key"].dataType),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
    ])
    sequences = stored.select("chunk", "keys", "sizes", "numbers")
    texts = sequences.groupBy("chunk").cogroup(encoded.groupBy("chunk")).applyInArrow(assemble, kind)
    return texts.select(F.col("key").alias(key), "ids")


def _table(vocabulary: Vocabulary) -> pa.Array:
    """Bytes by id; null where there is no such id, and at the end for all others."""
    if vocabulary.name not in _tables:
        ranks = vocabulary.ranks.value
        table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 2)
        for token, number in ranks.items():
            table[number] = token
        _tables[vocabulary.name] = pa.array(table, pa.large_binary())
    return _tables[vocabulary.name]


def look_up(lists: pa.Array, table: pa.Array) -> pa.Array:
    """The bytes of each list of ids, joined from the table by position."""
    ids = np.asarray(lists.flatten().fill_null(-1))
    out, at = [], 0
    for count in pc.list_value_length(lists).to_pylist():
        if count is None:
            out.append(None)
            continue
        parts: list[bytes] | None = []
        for start in range(at, at + count, IDS):
            own = ids[start : min(start + IDS, at + count)]
            known = np.where((own < 0) | (own >= len(table)), len(table) - 1, own)
            found = table.take(pa.array(known))
            if found.null_count:
                parts = None
                break
            end = np.frombuffer(found.buffers()[1], np.int64)[len(found)]
            parts.append(bytes(memoryview(found.buffers()[2])[:end]))
        at += count
        out.append(None if parts is None else b"".join(parts))
    return pa.array(out, pa.binary())


def decoded(df: DataFrame, ranks: Mapping[bytes, int], ids: Column) -> Column:
    """The bytes that the ids of ``df`` stand for, as a column."""
    shared = _shared(df, ranks)

    def evaluate(lists: pa.Array) -> pa.Array:
        found = look_up(lists, _table(shared))
        pa.default_memory_pool().release_unused()
        return found

    return F.arrow_udf(evaluate, "binary")(ids)


def with_decoded(
    df: DataFrame, ranks: Mapping[bytes, int], ids: str = "ids", name: str = "decoded"
) -> DataFrame:
    """``df`` with the bytes of its ids."""
    return df.withColumn(name, decoded(df, ranks, F.col(ids)))
