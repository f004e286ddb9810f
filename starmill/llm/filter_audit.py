"""Audit of interacting filters: what each filter removes, in every order of application.

Each document has a mask with one bit per failed filter. The documents are summed per part and mask
(a *cell*), so all further work is on at most ``2 ** filters`` cells a part.

A Gray-code walk visits every set of active filters, toggling one filter at a time. Each cell
counts its active failures; when the count leaves or reaches zero the cell is taken from or given
back to the running survivors. The survivors of every set are stored: 32 states for five filters.
A step of an order is the difference of two states: before and after its filter joins those
that ran earlier. So all orders come from the stored states, and no document is judged again.

Defined results: a null text is an empty text, a null part the empty string; a document without an
id equals no *smaller* id's text and is no smaller id itself; rows that share the smallest id of a text
are all first; repeated rows count each time; a document is good (toxic) if any of its labels says 1,
labels without an id say nothing; extra columns are ignored; an empty table gives an empty result.
Nothing is cut: texts are measured and compared whole, whatever their length.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.llm.quality_rules import UPPER
from starmill.llm.words import as_bytes, struct_udf
from starmill.operators.lookup import lookup_join
from starmill.sources.workdir import materialize

MARKS = b"#$%&*|"
FILTERS = ("A", "B", "C", "D", "E")
MEASURES = ("n_words", "n_distinct", "n_upper", "n_points", "n_marks")
TALLIES = ("n", "good", "toxic")


def measure(texts: pa.Array) -> pa.Array:
    rows = []
    for raw, points in zip(as_bytes(texts), pc.utf8_length(texts).to_pylist()):
        words = raw.split()
        rows.append((
            len(words), len(set(words)), len(raw) - len(raw.translate(None, UPPER)),
            points or 0, len(raw) - len(raw.translate(None, MARKS)),
        ))
    columns = np.array(rows, np.int64).reshape(-1, len(MEASURES))
    return pa.StructArray.from_arrays(
        [pa.array(columns[:, k]) for k in range(len(MEASURES))], names=list(MEASURES)
    )


def text_failures(measured: str) -> list[Column]:
    """Failure conditions of the four filters that need only the text, in the order of FILTERS."""
    m = {name: F.col(f"{measured}.{name}") for name in MEASURES}
    return [
        m["n_words"] < 100,
        m["n_distinct"] * 100 < m["n_words"] * 80,
        m["n_upper"] * 100 > m["n_points"] * 10,
        m["n_marks"] > 0,
    ]


def failure_masks(
    docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang"
) -> DataFrame:
    """``key``, ``part``, ``mask`` (bits of the first four filters) and ``digest`` of the text, one
    row per document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = ", ".join(f"{m} bigint" for m in MEASURES)
    rows = docs.select(
        F.col(key).alias("key"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
        struct_udf(kinds, measure)(F.col(text)).alias("measured"),
    )
    mask = F.lit(0)
    for bit, fails in enumerate(text_failures("measured")):
        mask = mask + F.when(fails, 1 << bit).otherwise(0)
    return rows.select("key", "part", mask.alias("mask"), "digest")


def with_labels(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``masks`` with ``good`` and ``toxic``, 1 if any label of the document says so, else 0."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    known = materialize(known.select(F.col("key").cast(masks.schema["key"].dataType), "good", "toxic"),
                        "labels")
    joined = lookup_join(masks, known, ["key"], known.count())
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def cells(judged: DataFrame, copy_bit: int = 4) -> DataFrame:
    """``part``, ``mask`` and the tallies ``n``, ``good``, ``toxic``; ``judged`` has ``key``,
    ``part``, ``mask`` (of the text alone), ``digest``, ``good`` and ``toxic``.

    A row is a copy unless it holds its text's smallest key. Repeated rows are summed first, and the
    join is on text and key together, so a text with a third of all rows is not one hot key.
    """
    rows = judged.groupBy("digest", "key", "part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")
    )
    rows = materialize(rows, "judged")
    first = rows.where(F.col("key").isNotNull()).groupBy("digest").agg(F.min("key").alias("key"))
    marked = rows.join(first.withColumn("first", F.lit(True)), ["digest", "key"], "left")
    copy = F.col("first").isNull() & F.col("key").isNotNull()
    bit = F.when(copy, 1 << copy_bit).otherwise(0)
    return marked.groupBy("part", (F.col("mask") + bit).alias("mask")).agg(
        *[F.sum(t).alias(t) for t in TALLIES]
    )


def gray_code(bits: int) -> Iterator[int]:
    """The bit to toggle at each step of a walk through all subsets, from the empty one on."""
    for k in range(1, 1 << bits):
        yield (k & -k).bit_length() - 1


def walk(tallies: np.ndarray, bits: int) -> np.ndarray:
    """Survivors of every set of active filters: ``[..., cell, tally]`` to ``[..., set, tally]``."""
    states = np.zeros_like(tallies)
    survivors = tallies.sum(axis=-2)
    active, failures = 0, [0] * (1 << bits)
    states[..., active, :] = survivors
    for toggled in gray_code(bits):
        active ^= 1 << toggled
        change = 1 if active >> toggled & 1 else -1
        for cell in range(1 << bits):
            if cell >> toggled & 1:
                failures[cell] += change
                if failures[cell] == (1 if change > 0 else 0):
                    survivors = survivors - change * tallies[..., cell, :]
        states[..., active, :] = survivors
    return states


def removals(states: np.ndarray, bits: int) -> np.ndarray:
    """What each filter removes, summed over all orders: ``[..., set, tally]`` to ``[..., filter]``.
    A set of active filters stands before a filter in ``|set|! (rest)!`` of the orders."""
    shares = np.zeros((*states.shape[:-2], bits), np.int64)
    for k in range(bits):
        for active in range(1 << bits):
            if not active >> k & 1:
                ran = active.bit_count()
                ways = math.factorial(ran) * math.factorial(bits - 1 - ran)
                lost = states[..., active, 0] - states[..., active | 1 << k, 0]
                shares[..., k] += ways * lost
    return shares


def survivor_states(summed: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """Per part an array for each tally: how many documents survive each set of active filters
    (bit k of the position: filter k is active), and ``shares``: each filter's removals summed over
    all orders. ``summed`` has at most ``2 ** filters`` cells per part."""
    size = 1 << filters
    entries = F.collect_list(F.struct("mask", *TALLIES)).alias("cells")
    listed = summed.groupBy("part").agg(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = batch.column("cells")
            row = np.repeat(np.arange(len(found)), np.diff(np.asarray(found.offsets)))
            given = found.flatten()
            mask = np.asarray(given.field("mask"))
            tallies = np.zeros((len(found), size, len(TALLIES)), np.int64)
            for k, t in enumerate(TALLIES):
                tallies[row, mask, k] = np.asarray(given.field(t))
            states = walk(tallies, filters)
            lists = [states[..., k] for k in range(len(TALLIES))] + [removals(states, filters)]
            columns = [pa.array(list(x), pa.list_(pa.int64())) for x in lists]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), *columns], ["part", *TALLIES, "shares"]
            )

    kinds = ", ".join(f"{t} array<bigint>" for t in (*TALLIES, "shares"))
    return listed.mapInArrow(run, f"part string, {kinds}")


def order_steps(filters: Sequence[str]) -> list[tuple]:
    """For each step of each order: the order's name, the step's number and filter, the set of
    filters active before it, and the filter's bit."""
    steps = []
    for order in itertools.permutations(range(len(filters))):
        before = 0
        for step, k in enumerate(order, 1):
            steps.append(("".join(filters[i] for i in order), step, k, before, 1 << k))
            before |= 1 << k
    return steps


def steps_of_orders(states: DataFrame, filters: Sequence[str] = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the stored states alone."""
    count = len(filters)
    every = (1 << count) - 1

    def lost(tally: str, before: Column, bit: Column) -> Column:
        return F.get(tally, before) - F.get(tally, before.bitwiseOR(bit))

    names = ("filter_order", "step", "k", "before", "bit")
    table = json.dumps([dict(zip(names, row)) for row in order_steps(filters)])
    kind = "array<struct<filter_order: string, step: int, k: int, before: int, bit: int>>"
    rows = states.withColumn("at", F.explode(F.from_json(F.lit(table), kind))).select("*", "at.*")
    bit = F.col("bit")
    removed = lost("n", F.col("before"), bit)
    rest = F.lit(every).bitwiseXOR(bit)
    return rows.select(
        "part",
        "filter_order",
        "step",
        F.get("n", F.col("before").bitwiseOR(bit)).alias("kept"),
        removed.alias("removed"),
        (lost("n", F.lit(0), bit) - removed).alias("redundant"),
        lost("n", rest, bit).alias("unique_fails"),
        lost("good", F.col("before"), bit).alias("good_lost"),
        lost("toxic", F.col("before"), bit).alias("toxic_lost"),
        F.get("shares", F.col("k")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The steps of all orders of the five filters, per language."""
    judged = with_labels(failure_masks(docs), labels)
    states = materialize(survivor_states(cells(judged)), "states")
    return steps_of_orders(states)
