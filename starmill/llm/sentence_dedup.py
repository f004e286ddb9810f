"""Substring deduplication by sliding sentence spans.

A sentence ends at ``.``, ``!``, ``?`` or a line end. Every pair and every run of ``RUN``
consecutive sentences with at least ``MIN_WORDS`` words is hashed (lower case, white space as
single spaces), and a single sentence with at least ``SINGLE_WORDS``. Where ``RUN`` sentences hold
fewer than ``MIN_WORDS`` words, the run goes on, from its first sentence forwards and from its last
one backwards, until it holds them: each sentence of a repeated passage of that many words in two
or more whole sentences is in a run within the passage. A passage that begins and ends inside
sentences is found by the whole sentences between; one that holds no such run stays. Runs are joined
over the whole corpus: of all places of a run the first (least key, then text, then position) is
kept, and every sentence covered by a non-first run is removed from its document.

Plan: one pass over the texts writes the run table (hash, document, position). One aggregate with
partial aggregation finds the repeated hashes and their first places, and a join that splits hot
hashes brings them back to the runs; a passage that a third of all documents share is one row on
the right side. Removed positions are grouped per document, and only then are the texts of the
affected documents joined and cut.

Defined results: a null text has no sentences; a null key is a document like any other and sorts
first; rows that repeat a key and its text are the same document, treated alike, and come back
once per row; rows of one key with other texts are documents of their own; extra columns are
ignored; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starmill.llm.words import as_text, map_batches, run_hashes
from starmill.operators.lookup import lookup_join
from starmill.sources.workdir import materialize

RUN = 3
MIN_WORDS = 10
SINGLE_WORDS = 20

PIECE = re.compile(r"[^\n.!?]+[.!?]*")


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """``(start, end, words)`` of each sentence that has a word; white space around it left out."""
    found = []
    for match in PIECE.finditer(text):
        piece = match.group()
        words = piece.lower().split()
        if words:
            start = match.start() + len(piece) - len(piece.lstrip())
            found.append((start, match.start() + len(piece.rstrip()), words))
    return found


def longer_runs(sums: np.ndarray) -> np.ndarray:
    """``(first, end)`` of each run of more than ``RUN`` sentences that holds ``MIN_WORDS`` words
    but would not without its last or without its first sentence; ``sums`` are the words before
    each sentence."""
    at = np.arange(len(sums))
    until = np.searchsorted(sums, sums + MIN_WORDS)
    since = np.searchsorted(sums, sums - MIN_WORDS, "right") - 1
    spans = np.concatenate([
        np.stack([at, until], axis=1)[until < len(sums)],
        np.stack([since, at], axis=1)[since >= 0],
    ])
    return np.unique(spans[spans[:, 1] - spans[:, 0] > RUN], axis=0)


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first sentence, number of sentences, hash)`` of each run."""
    found = sentences(text)
    if not found:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(" ".join(w).encode()) for _, _, w in found], np.uint64)
    sums = np.concatenate([[0], np.cumsum([len(w) for _, _, w in found])])
    places, widths, values = [], [], []
    for width in range(1, RUN + 1):
        if len(found) < width:
            break
        words = sums[width:] - sums[:-width]
        chosen = np.flatnonzero(words >= (SINGLE_WORDS if width == 1 else MIN_WORDS))
        places.append(chosen)
        widths.append(np.full(len(chosen), width, np.int64))
        values.append(run_hashes(hashes, width)[chosen] + np.uint64(width))
        if width == RUN and len(chosen) < len(words):
            spans = longer_runs(sums)
            places.append(spans[:, 0])
            widths.append(spans[:, 1] - spans[:, 0])
            longer = [digest(hashes[a:b].tobytes()) for a, b in spans.tolist()]
            values.append(np.array(longer, np.uint64))
    return np.concatenate(places), np.concatenate(widths), np.concatenate(values)


def _run_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    every = [runs(text) for text in as_text(batch.column(2))]
    counts = [len(places) for places, _, _ in every]
    rows = pa.array(np.repeat(np.arange(len(every)), counts))

    def joined(k: int, kind: type) -> np.ndarray:
        return np.concatenate([r[k].astype(kind) for r in every])

    return pa.RecordBatch.from_arrays(
        [
            batch.column(0).take(rows),
            batch.column(1).take(rows),
            pa.array(joined(0, np.int64).astype(np.int32)),
            pa.array(joined(1, np.int64).astype(np.int8)),
            pa.array(joined(2, np.uint64).view(np.int64)),
        ],
        names=["key", "body", "place", "width", "run"],
    )


def cut(text: str, removed: set[int]) -> tuple[str, str, int]:
    """The text without the sentences of those numbers, the spans cut out (code points, adjoining
    sentences as one), and the number of sentences. A cut takes the white space after it."""
    found = sentences(text)
    spans: list[list[int]] = []
    for number, (start, end, _) in enumerate(found):
        if number in removed:
            if spans and number - 1 in removed:
                spans[-1][1] = end
            else:
                spans.append([start, end])
    parts, at = [], 0
    for start, end in spans:
        parts.append(text[at:start])
        at = end
        while at < len(text) and text[at].isspace():
            at += 1
    parts.append(text[at:])
    return "".join(parts), ",".join(f"{s}:{e}" for s, e in spans), len(found)


def _cut_rows(texts: pa.Array, numbers: pa.Array) -> pa.Array:
    kept, spans, counts = [], [], []
    for text, gone in zip(as_text(texts), numbers.to_pylist()):
        left, removed, count = cut(text, set(gone))
        kept.append(left)
        spans.append(removed)
        counts.append(count)
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.string()), pa.array(spans, pa.string()), pa.array(counts, pa.int64())],
        names=["text", "spans", "n_sentences"],
    )


def repeated_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``body`` (the text's hash), ``removed`` (sentence numbers) and ``first_in`` (keys
    of the documents that keep the first places) for each document that loses a sentence."""
    kind = df.schema[key].dataType.simpleString()
    narrow = df.select(
        F.col(key).alias("key"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text")
    )
    schema = f"key {kind}, body long, place int, width tinyint, run long"
    stored = materialize(map_batches(narrow, schema, _run_rows), "runs")
    here = F.struct("key", "body", "place")
    found = stored.groupBy("run").agg(F.min(here).alias("first"), F.count("*").alias("n"))
    found = materialize(found.where("n > 1").select("run", "first"), "repeated")
    joined = lookup_join(stored, found, ["run"], found.count())
    again = joined.where(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(here))
    covered = F.flatten(
        F.collect_set(
            F.transform(
                F.sequence(F.lit(0), F.col("width").cast("int") - 1),
                lambda k: F.col("place") + k,
            )
        )
    )
    return again.groupBy("key", "body").agg(
        F.array_sort(F.array_distinct(covered)).alias("removed"),
        F.array_sort(F.collect_set("first.key")).alias("first_in"),
    )


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row that loses a sentence: ``key``, ``first_in``, ``n_sentences``, ``n_removed``,
    ``spans`` (``start:end`` in code points) and ``text``, what is left."""
    gone = materialize(repeated_spans(df, key, text), "removed")
    texts = df.select(
        F.col(key).alias("own"), F.xxhash64(F.col(text)).alias("own_body"),
        F.col(text).alias("whole"),
    )
    same = F.col("own").eqNullSafe(F.col("key")) & (F.col("own_body") == F.col("body"))
    affected = texts.join(gone, same)
    udf = F.arrow_udf(
        lambda t, n: _cut_rows(t, n), "text string, spans string, n_sentences bigint"
    )
    left = affected.withColumn("cut", udf("whole", "removed"))
    return left.select(
        F.col("own").alias(key), "first_in", "cut.n_sentences",
        F.size("removed").cast("long").alias("n_removed"), "cut.spans", "cut.text",
    )
