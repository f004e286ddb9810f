"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

1. Every text becomes a vector of statistics (lengths, shares of symbols, capitals, digits and
   marks, repetition). Neither labels, language, source nor key are among them.
2. Random Fourier features ``sqrt(2 / D) cos(W x + b)`` of the standardised statistics approximate
   a Gaussian kernel; ``W`` and ``b`` come from a fixed seed.
3. Ridge regression: each partition of the training rows sums its own normal equations per fold,
   and the sums are added. Leaving a fold out is a subtraction, so every training row gets a score
   from a model that has not seen it.
4. Isotonic regression (pooled adjacent violators) on those scores turns a score into a
   probability. Between the pooled blocks the curve is linear, with a slight slope everywhere, so
   that the order of scores is kept.

Training uses at most ``TRAIN_ROWS`` labelled rows, drawn by hash; rows are held out where the
CRC-32 of the key's text, modulo 5, is 0. Statistics and scores cover all documents. The driver
holds sums and bins of fixed size only.

Defined results: a null text is an empty text and gets a score; a null key is held out (it has no
CRC) and never learnt from; repeated rows are scored each, repeated labels count each time; labels
with a null are ignored; extra columns are ignored; an empty table gives an empty result; without
any label to learn from every score is 0.5.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.llm.quality_rules import SYMBOLS, UPPER, duplicate_lines, repeated_words
from starmill.llm.words import WHITE, as_bytes, map_batches, struct_udf
from starmill.sources.workdir import materialize

TRAIN_ROWS = 40_000
TRAIN_TASKS = 8
FOLDS = 5
FEATURES = 128  # D
WIDTH = 3.0  # of the Gaussian kernel, in standard deviations of the statistics
RIDGE = 1e-3  # per training row
SEED = 20_240_501
BINS = 400  # of the calibration, per unit of score
LEAST, MOST = -2.0, 3.0
SLOPE = 0.01  # share of the plain score in a calibrated one
THRESHOLD = 0.3

STATISTICS = (
    "words", "bytes", "word_length", "symbols", "capitals", "digits", "stops", "shouts", "pipes",
    "lines", "kinds", "repeats", "same_lines", "foreign", "sentence", "short_words", "packed",
)
DIGITS, STOPS = b"0123456789", b".,;:"
PACKED_BYTES = 1 << 16  # texts are compressed in pieces of this size, all of them


def share(raw: bytes, of: bytes) -> float:
    return (len(raw) - len(raw.translate(None, of))) / (len(raw) + 1)


def packed_share(raw: bytes) -> float:
    size = sum(
        len(zlib.compress(raw[at : at + PACKED_BYTES], 1)) for at in range(0, len(raw), PACKED_BYTES)
    )
    return size / (len(raw) + 20)


def statistics(raw: bytes) -> tuple[float, ...]:
    words = raw.split()
    count = len(words) + 1
    lines, same = duplicate_lines(raw)
    ends = sum(raw.count(c) for c in (b".", b"!", b"?"))
    letters = len(raw.translate(None, WHITE))
    return (
        math.log(count), math.log(len(raw) + 1), min(letters / count, 30.0),
        min((len(raw) - len(raw.translate(None, SYMBOLS))) / count, 5.0),
        share(raw, UPPER), share(raw, DIGITS), share(raw, STOPS),
        min(raw.count(b"!") / count, 2.0), min(raw.count(b"|") / count, 2.0),
        math.log((lines + 1) / count + 0.01), len(set(words)) / count,
        repeated_words(words) / count, same / (lines + 1),
        sum(raw.count(bytes([lead])) for lead in range(0xC3, 0xC6)) / (len(raw) + 1),
        math.log(count / (ends + 1)), sum(len(w) <= 3 for w in words) / count, packed_share(raw),
    )


def _measure(texts: pa.Array) -> pa.Array:
    rows = np.array([statistics(raw) for raw in as_bytes(texts)], np.float32)
    flat = pa.array(rows.reshape(-1))
    ends = pa.array(np.arange(0, rows.size + 1, len(STATISTICS), dtype=np.int32))
    return pa.ListArray.from_arrays(ends, flat)


def with_statistics(text: Column) -> Column:
    return struct_udf("array<float>", _measure)(text)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


@dataclass
class Kernel:
    """Standardisation and the random features."""

    mean: np.ndarray
    spread: np.ndarray

    def __post_init__(self):
        draw = np.random.default_rng(SEED)
        self.weights = draw.normal(0, 1 / WIDTH, (len(STATISTICS), FEATURES))
        self.phases = draw.uniform(0, 2 * np.pi, FEATURES)

    def features(self, values: np.ndarray) -> np.ndarray:
        scaled = np.clip((values - self.mean) / self.spread, -6, 6)
        waves = math.sqrt(2 / FEATURES) * np.cos(scaled @ self.weights + self.phases)
        return np.hstack([waves, np.ones((len(values), 1))])


SIDE = FEATURES + 1


def _normal_sums(rows: DataFrame, kernel: Kernel) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """``fold -> (rows, X'X, X'y)``: one sum per partition and fold, added on the driver. There
    are at most ``TRAIN_TASKS`` partitions, so the size of what arrives is fixed."""

    def work(batches):
        sums = {}
        for batch in batches:
            values = kernel.features(matrix(batch.column(0)))
            labels = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            folds = batch.column(2).to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                x, y = values[folds == fold], labels[folds == fold]
                n, a, b = sums.get(fold, (0, 0.0, 0.0))
                sums[fold] = n + len(y), a + x.T @ x, b + x.T @ y
        for fold, (n, a, b) in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(fold)]), pa.array([n]), pa.array([a.tobytes()]),
                 pa.array([b.tobytes()])],
                names=["fold", "n", "a", "b"],
            )

    schema = "fold long, n long, a binary, b binary"
    found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    for row in rows.select("values", "label", "fold").mapInArrow(work, schema).collect():
        n, a, b = found.get(row.fold, (0, 0.0, 0.0))
        found[row.fold] = (
            n + row.n,
            a + np.frombuffer(row.a).reshape(SIDE, SIDE),
            b + np.frombuffer(row.b),
        )
    return found


def ridge(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    penalty = np.full(SIDE, RIDGE * max(n, 1))
    penalty[-1] = 1e-9 * max(n, 1)
    return np.linalg.solve(a + np.diag(penalty), b)


def pooled(bins: list[tuple[float, float, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of ``(score, weight, mean label)`` by pooled adjacent violators:
    the blocks' mean scores and their values, both rising."""
    blocks: list[list[float]] = []  # weight, sum of scores, sum of labels
    for score, weight, label in sorted(bins):
        blocks.append([weight, weight * score, weight * label])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][0] >= blocks[-1][2] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    return (
        np.array([s / w for w, s, _ in blocks]), np.array([y / w for w, _, y in blocks])
    )


@dataclass
class Model:
    kernel: Kernel
    weights: np.ndarray
    scores: np.ndarray
    values: np.ndarray

    def plain(self, values: np.ndarray) -> np.ndarray:
        return self.kernel.features(values) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        plain = self.plain(values)
        calibrated = np.interp(plain, self.scores, self.values)
        smooth = 1 / (1 + np.exp(-4 * (plain - 0.5)))
        return np.clip((1 - SLOPE) * calibrated + SLOPE * smooth, 0, 1)


def fit(measured: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model | None:
    """The model for a stored frame of ``key`` and ``values``; None without labels to learn from."""
    known = labels.select(
        F.col("doc_id").alias("key"), F.col("quality").cast("double").alias("label")
    ).where(F.col("label").isin(0.0, 1.0) & ~held_out(F.col("key")))
    drawn = materialize(known.orderBy(F.xxhash64("key"), "key", "label").limit(train_rows), "drawn")
    fold = F.pmod(F.xxhash64("key"), F.lit(FOLDS)).alias("fold")
    rows = measured.join(F.broadcast(drawn), "key").select("values", "label", fold)
    rows = materialize(rows.repartition(TRAIN_TASKS), "train")
    each = [F.col("values")[k].cast("double") for k in range(len(STATISTICS))]
    row = rows.agg(
        F.count("*"), F.array(*[F.avg(c) for c in each]), F.array(*[F.stddev_pop(c) for c in each])
    ).first()
    if not row[0]:
        return None
    kernel = Kernel(np.array(row[1]), np.maximum(np.array(row[2]), 1e-6))
    sums = _normal_sums(rows, kernel)
    total = tuple(sum(part[k] for part in sums.values()) for k in range(3))
    weights = ridge(*total)
    others = {
        f: ridge(*(total[k] - part[k] for k in range(3))) if len(sums) > 1 else weights
        for f, part in sums.items()
    }

    def out_of_fold(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = kernel.features(matrix(batch.column(0)))
        folds = batch.column(2).to_numpy(zero_copy_only=False)
        plain = np.zeros(len(folds))
        for f, own in others.items():
            plain[folds == f] = values[folds == f] @ own
        return pa.RecordBatch.from_arrays(
            [pa.array(np.clip(plain, LEAST, MOST)), batch.column(1)], names=["plain", "label"]
        )

    scored = map_batches(
        rows.select("values", "label", "fold"), "plain double, label double", out_of_fold
    )
    binned = scored.groupBy(F.round(F.col("plain") * BINS)).agg(
        F.avg("plain"), F.count("*").cast("double"), F.avg("label")
    )
    bins = [(r[1], r[2], r[3]) for r in binned.collect()]  # at most (MOST - LEAST) * BINS + 1
    return Model(kernel, weights, *pooled(bins))


def quality_scores(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``key``, ``held_out``, ``score`` and ``predicted`` for every row."""
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    measured = narrow.select("key", with_statistics(F.col("text")).alias("values"))
    measured = materialize(measured, "statistics")
    model = fit(measured, labels)

    def work(values: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(values)))

    scores = struct_udf("double", work)(F.col("values")) if model else F.lit(0.5)
    scored = measured.select("key", scores.alias("score"))
    return scored.select(
        F.col("key").alias(key),
        held_out(F.col("key")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )
