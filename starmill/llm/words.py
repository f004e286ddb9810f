"""Words, word numbers and Arrow columns, shared by the text operators.

A word is a run of bytes other than the ASCII white space ``[\\x20\\x09-\\x0D]``, which is what
``bytes.split()`` splits on. Working on UTF-8 bytes saves decoding whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = b" \t\n\x0b\x0c\r"
MEMO_WORDS = 200_000  # a worker forgets its word numbers beyond this; they are rebuilt, not lost


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    return [b"" if t is None else t for t in texts.cast(pa.binary()).to_pylist()]


def as_text(texts: pa.Array) -> list[str]:
    return ["" if t is None else t for t in texts.to_pylist()]


class WordNumbers(dict):
    """Word -> consecutive number, exact within one text (``fresh`` is called between texts)."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number

    def fresh(self) -> WordNumbers:
        if len(self) > MEMO_WORDS:
            self.clear()
        return self

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class WordHashes(dict):
    """Word -> 64-bit hash of ``normal(word)``; 0 for a word that ``normal`` empties."""

    def __init__(self, normal: Callable[[bytes], bytes]):
        super().__init__()
        self.normal = normal

    def __missing__(self, word: bytes) -> int:
        kept = self.normal(word)
        self[word] = value = (xxhash.xxh64_intdigest(kept) | 1) if kept else 0
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MEMO_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every bit depends on every bit."""
    with np.errstate(over="ignore"):
        x = values ^ (values >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` consecutive values, in order."""
    runs = len(values) - length + 1
    if runs <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(runs, np.uint64)
        for k in range(length):
            total = mixed(total + values[k : k + runs] + np.uint64(k + 1))
    return total


def map_batches(
    df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], pa.RecordBatch]
) -> DataFrame:
    """``mapInArrow`` with one output batch per input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield work(batch)

    return df.mapInArrow(run, schema)


def struct_udf(schema: str, work: Callable[[pa.Array], pa.Array]) -> Callable[[Column], Column]:
    """A column function: one text column in, one struct of ``schema`` out, batch by batch."""

    def evaluate(texts: pa.Array) -> pa.Array:
        return work(texts)

    return F.arrow_udf(evaluate, schema)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, lengthened until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
