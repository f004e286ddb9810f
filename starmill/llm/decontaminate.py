"""Benchmark decontamination by SimHash over item-sized windows.

For a benchmark item of ``m`` words every window of ``m`` consecutive words of every document is
held against it: the window's 64-bit SimHash (each five-word shingle counted as often as it
occurs) must lie within ``radius`` bits of the item's, and then the exact weighted similarity of
the two bags of shingles (sum of minima over sum of maxima of the counts) must reach
``similarity``. A document with fewer words than the item is one window as a whole, so that an item
cut short is found as well.

* Multi-index: fingerprints are cut into 8 blocks of 8 bits. Of two that differ in at most
  ``radius`` bits, some block differs in at most ``radius // 8``; the index lists, for each block
  and each of its 256 values, the items within that many bits. No fingerprint within the radius is
  missed.
* The radius of 20 is over three standard deviations above the mean distance of a pair of
  windows at a similarity of 0.8 (9.7 bits, deviation 2.9).
* A window is fingerprinted only if enough of its shingles occur in items of its size at all; with
  fewer it cannot reach the similarity with any of them, so this drops no answer.

The index is broadcast: it has at most ``ITEMS_AT_ONCE`` items, whatever the benchmark's size; a
larger benchmark is taken in blocks of that many items, each against all documents.

Words are compared in lower case without punctuation at their ends. An item of fewer than five
words is one shingle of all its words; an item without words matches nothing.

Defined results: a null text is an empty text and is never contaminated; null keys are carried;
repeated rows are judged row by row; extra columns are ignored by ``contamination`` and kept by
``drop_contaminated``; an empty table gives an empty result, an empty benchmark rejects nothing.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.llm.simhash import bit_counts
from starmill.llm.words import WordHashes, as_bytes, free_name, map_batches, run_hashes, struct_udf

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 20
BLOCKS = 8
ITEMS_AT_ONCE = 20_000
WINDOWS_AT_ONCE = 4096  # bounds the bit counters held at a time
BYTES_AT_ONCE = 4 << 20  # texts are screened in portions of this size
SCREEN_BITS = 22

EDGES = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


EDGE_BYTES = EDGES.encode()


def normal(word: bytes) -> bytes:
    if word.isascii():
        return word.lower().strip(EDGE_BYTES)
    return word.decode("utf-8", "replace").lower().strip(EDGES).encode()


_hashes = WordHashes(normal)


def words_of(raw: bytes) -> np.ndarray:
    """A hash for each word that has more than punctuation, in order."""
    found = _hashes.of(raw.split())
    return found[found != 0]


def portions(raws: list[bytes], size: int = BYTES_AT_ONCE) -> Iterator[tuple[int, list[bytes]]]:
    """``(number of the first, texts)`` in portions of about ``size`` bytes, at least one text."""
    start, held = 0, 0
    for at, raw in enumerate(raws):
        if held and held + len(raw) > size:
            yield start, raws[start:at]
            start, held = at, 0
        held += len(raw)
    if start < len(raws):
        yield start, raws[start:]


@dataclass
class Item:
    number: int
    shingles: np.ndarray
    counts: Counter


def simhash(sums: np.ndarray, weight: int) -> np.ndarray:
    """Fingerprints, as rows of 8 bytes, from rows of 64 bit counts out of ``weight``."""
    return np.packbits(sums * 2 > weight, axis=-1)


class Known:
    """The items' shingles of one length, and in items of which window sizes each occurs."""

    def __init__(self, sized: list[tuple[int, list[Item]]]):
        sizes = np.concatenate([np.full(size * len(items), size) for size, items in sized])
        values = np.concatenate([i.shingles for _, items in sized for i in items])
        self.values, at = np.unique(values, return_inverse=True)
        pairs = np.unique(np.stack([at, sizes], axis=1), axis=0)
        self.sizes = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.values) + 1))
        self.table = np.zeros(1 << SCREEN_BITS, bool)
        self.table[self._slots(self.values)] = True

    @staticmethod
    def _slots(shingles: np.ndarray) -> np.ndarray:
        return (shingles >> np.uint64(64 - SCREEN_BITS)).astype(np.int64)

    def _find(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose shingle is known, and its number."""
        at = np.flatnonzero(self.table[self._slots(shingles)])
        number = np.minimum(np.searchsorted(self.values, shingles[at]), len(self.values) - 1)
        exact = self.values[number] == shingles[at]
        return at[exact], number[exact]

    def screen(self, shingles: np.ndarray) -> np.ndarray:
        return self._find(shingles)[0]

    def places(self, shingles: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(size, places)`` of the shingles that occur in items of that size."""
        at, number = self._find(shingles)
        counts = self.starts[number + 1] - self.starts[number]
        at = np.repeat(at, counts)
        within = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        sizes = self.sizes[np.repeat(self.starts[number], counts) + within]
        for size in np.unique(sizes).tolist():
            yield size, at[sizes == size]


class Index:
    """Fingerprints of the items of one word length and shingle length, by blocks."""

    def __init__(self, items: list[Item], radius: int):
        self.items, self.radius = items, radius
        self.prints = np.stack([simhash(bit_counts(i.shingles), len(i.shingles)) for i in items])
        near = np.bitwise_count(
            np.arange(256, dtype=np.uint8)[:, None, None] ^ self.prints[None]
        ) <= radius // BLOCKS  # value, item, block
        self.lists = [
            [np.flatnonzero(near[value, :, block]) for value in range(256)]
            for block in range(BLOCKS)
        ]

    def candidates(self, print_: np.ndarray) -> np.ndarray:
        """Items within the radius of a fingerprint."""
        hits = [self.lists[block][value] for block, value in enumerate(print_)]
        found = np.unique(np.concatenate(hits))
        far = np.bitwise_count(self.prints[found] ^ print_).sum(axis=1)
        return found[far <= self.radius]


class Benchmark:
    """Items grouped by window size, with the set of all their shingles."""

    def __init__(self, texts: list[bytes], radius: int, similarity: float):
        self.similarity = similarity
        sized = defaultdict(list)
        for number, raw in enumerate(texts):
            words = words_of(raw)
            if len(words):
                shingle = min(SHINGLE, len(words))
                shingles = run_hashes(words, shingle)
                item = Item(number, shingles, Counter(shingles.tolist()))
                sized[shingle, len(shingles)].append(item)
        self.indexes = {
            size: Index(items, radius) for size, items in sized.items()
        }
        self.known = {
            shingle: Known([(size, i) for (s, size), i in sized.items() if s == shingle])
            for shingle in {s for s, _ in sized}
        }

    def search(self, raws: list[bytes]) -> Iterator[tuple[int, dict[int, tuple[float, int]]]]:
        """``(row, best)`` of every text that holds an item. The texts of a portion are screened
        together for shingles of the items; only those with one are looked at."""
        for first, portion in portions(raws):
            lists = [raw.split() for raw in portion]
            owners = np.repeat(np.arange(len(lists)), [len(words) for words in lists])
            words = _hashes.of(list(chain.from_iterable(lists)))
            owners, words = owners[words != 0], words[words != 0]
            chosen = set()
            for shingle, known in self.known.items():
                runs = run_hashes(words, shingle)
                if len(runs):
                    at = known.screen(runs)
                    at = at[owners[at] == owners[at + shingle - 1]]
                    chosen.update(owners[at].tolist())
            for row in sorted(chosen):
                start, end = np.searchsorted(owners, [row, row + 1])
                found = self.best(words[start:end])
                if found:
                    yield first + row, found

    def best(self, words: np.ndarray) -> dict[int, tuple[float, int]]:
        """Item number -> highest similarity of a window and the window's first word."""
        best: dict[int, tuple[float, int]] = {}
        for shingle, known in self.known.items():
            shingles = run_hashes(words, shingle)
            if not len(shingles):
                continue
            for size, places in known.places(shingles):
                # the sum of minima is at most the shared shingles; with the sum of maxima it
                # makes the item's size and the window's, which is the text's if that is shorter
                width = min(size, len(shingles))
                least = (size + width) * self.similarity / (1 + self.similarity) - 1e-9
                if len(places) < least:
                    continue
                shared = np.zeros(len(shingles) + 1, np.int32)
                shared[places + 1] = 1
                sums = np.cumsum(shared)
                enough = np.flatnonzero(sums[width:] - sums[:-width] >= least)
                index = self.indexes[shingle, size]
                for at in range(0, len(enough), WINDOWS_AT_ONCE):
                    starts = enough[at : at + WINDOWS_AT_ONCE]
                    self.check(shingles, starts, width, index, best)
        return best

    def check(self, shingles, starts, width, index, best) -> None:
        """Hold the windows of ``width`` shingles at ``starts`` against the items of the index."""
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):
            first = run[0]
            part = shingles[first : run[-1] + width].astype(">u8")
            bits = np.unpackbits(part.view(np.uint8)).reshape(-1, 64)
            sums = np.zeros((len(part) + 1, 64), np.int32)
            np.cumsum(bits, axis=0, out=sums[1:])
            counted = sums[run - first + width] - sums[run - first]
            for start, print_ in zip(run.tolist(), simhash(counted, width)):
                for k in index.candidates(print_).tolist():
                    item = index.items[k]
                    window = Counter(shingles[start : start + width].tolist())
                    common = sum(min(n, window[x]) for x, n in item.counts.items())
                    alike = common / (len(item.shingles) + width - common)
                    if alike >= self.similarity:
                        old = best.get(item.number)
                        if old is None or alike > old[0]:
                            best[item.number] = (alike, start)


def _blocks(benchmark: DataFrame, key: str, text: str, size: int) -> Iterator[list]:
    """The benchmark's rows in blocks of ``size``; the driver holds one block at a time."""
    block: list = []
    rows = benchmark.select(F.col(key), F.col(text).cast("binary"))
    for row in rows.toLocalIterator():
        block.append((row[0], bytes(row[1] or b"")))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    items_at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """``key``, ``item_id``, ``similarity`` and ``first_word`` (place of the best window among the
    document's words with letters or digits) for each item found in each document."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType
    schema = f"key {kinds[0]}, item long, similarity double, first_word long"
    found = None
    for block in _blocks(benchmark, item, item_text, items_at_once):
        index = spark.sparkContext.broadcast(
            Benchmark([raw for _, raw in block], radius, similarity)
        )

        def work(batch: pa.RecordBatch, index=index) -> pa.RecordBatch:
            rows, items, values, firsts = [], [], [], []
            for row, best in index.value.search(as_bytes(batch.column(1))):
                for number, (alike, first) in best.items():
                    rows.append(row)
                    items.append(number)
                    values.append(alike)
                    firsts.append(first)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(items, pa.int64()),
                    pa.array(values, pa.float64()),
                    pa.array(firsts, pa.int64()),
                ],
                names=["key", "item", "similarity", "first_word"],
            )

        ids = spark.createDataFrame(
            [(n, i) for n, (i, _) in enumerate(block)], f"item long, id {kinds[1].simpleString()}"
        )
        part = map_batches(narrow, schema, work).join(F.broadcast(ids), "item")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], f"{schema}, id {kinds[1].simpleString()}")
    return found.select(
        F.col("key").alias(key), F.col("id").alias("item_id"), "similarity", "first_word"
    )


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    radius: int = RADIUS,
    items_at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """The rows of ``docs`` without a window like any item, with the columns of ``docs``."""
    spark, clean = docs.sparkSession, docs
    flag = free_name(docs, "_clean")
    for block in _blocks(benchmark, item, item_text, items_at_once):
        index = spark.sparkContext.broadcast(
            Benchmark([raw for _, raw in block], radius, similarity)
        )

        def work(texts: pa.Array, index=index) -> pa.Array:
            clean = np.ones(len(texts), bool)
            clean[[row for row, _ in index.value.search(as_bytes(texts))]] = False
            return pa.array(clean)

        clean = clean.withColumn(flag, struct_udf("boolean", work)(F.col(text))).where(flag)
        clean = clean.select(*docs.columns)
    return clean
