"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

Two 64-bit fingerprints that differ in at most ``distance`` bits agree on all but ``distance`` of
``distance + 3`` blocks, so for some choice of 3 blocks they agree on all three. Equal
fingerprints are first collapsed to one row; each distinct one then goes to one bucket per choice
of 3 blocks (20 buckets of about 32 bits for a distance of 3), and only rows of a bucket are
compared. A crowded bucket is dealt out once more by the same principle over the bits its members
do not share, in so many small blocks that a sub-bucket leaves ``4 * distance`` bits open: it can
hold at most 4,096 distinct fingerprints for a distance of 3, whatever the data looks like.
Within a bucket only a spanning forest of the links is emitted, never all pairs, and components
are found over those links.

Words are lower-cased (A-Z) runs of ``[^\\x20\\x09-\\x0D]``; shingles are ``shingle`` consecutive
words joined by a space, repeats included; a shorter text is one shingle; a text without words has
fingerprint 0. A bit is set if it is set in over half of the shingles' XXH64 (seed 42).

Defined results: a null text is an empty text; a null key has a fingerprint and a component (the
least key of its group, null if there is none); repeated rows come back once per row; extra columns
are ignored by ``near_duplicates`` and kept by ``keep_one``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.llm.graph import components
from starmill.llm.words import as_bytes, free_name, map_batches, struct_udf
from starmill.operators.lookup import lookup_join
from starmill.sources.workdir import materialize

SEED = 42
BITS = 64
CROWDED = 1024  # a bucket with more distinct fingerprints is dealt out again
LANES = 255  # byte counters overflow beyond this many additions
CHUNK = LANES * 256  # shingles whose bits are unpacked at a time


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set (index 0: the highest bit)."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype(">u8")
        bits = np.unpackbits(part.view(np.uint8)).reshape(-1, BITS)
        # eight byte counters are added at a time, as one 64-bit number
        lanes = np.ascontiguousarray(bits).view(np.uint64)
        sums = np.add.reduceat(lanes, np.arange(0, len(lanes), LANES), axis=0)
        total += sums.view(np.uint8).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return total


def fingerprint(raw: bytes, shingle: int) -> int:
    words = raw.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    set_bits = bit_counts(hashes) * 2 > len(hashes)
    return int.from_bytes(np.packbits(set_bits).tobytes(), "big")


def fingerprints(text: Column, shingle: int) -> Column:
    """The fingerprint as a signed 64-bit number."""

    def work(texts: pa.Array) -> pa.Array:
        values = [fingerprint(raw, shingle) for raw in as_bytes(texts)]
        return pa.array(np.array(values, np.uint64).view(np.int64))

    return struct_udf("bigint", work)(text)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(width: int, blocks: int, agree: int, within: int) -> list[int]:
    """One mask per choice of ``agree`` of ``blocks`` even blocks of the set bits of ``within``."""
    places = [i for i in range(BITS) if within >> i & 1]
    assert len(places) == width
    edges = [round(width * k / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << p for p in places[s:e]) for s, e in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(parts, agree)]


def forest(values: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """Star links ``(root, other)`` of the components of distinct values."""
    rest = values
    while rest.size > 1:
        root, rest = rest[0], rest[1:]
        frontier = [root]
        while frontier and rest.size:
            near = np.bitwise_count(rest ^ frontier.pop()) <= distance
            if near.any():
                reached = rest[near]
                rest = rest[~near]
                frontier.extend(reached)
                yield from ((root, other) for other in reached)


def _links(buckets: DataFrame, distance: int) -> DataFrame:
    """Links ``(a, b)`` inside the arrays of column ``members``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(0)
        values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        starts = ends - lists.value_lengths().to_numpy(zero_copy_only=False)
        pairs = ends - starts == 2
        a, b = values[starts[pairs]], values[starts[pairs] + 1]
        near = np.bitwise_count(a ^ b) <= distance
        left, right = [a[near]], [b[near]]
        more = [
            link
            for s, e in zip(starts[~pairs], ends[~pairs])
            for link in forest(values[s:e], distance)
        ]
        if more:
            linked = np.array(more, np.uint64)
            left.append(linked[:, 0])
            right.append(linked[:, 1])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["a", "b"]
        )

    return map_batches(buckets.select("members"), "a bigint, b bigint", work)


def _array(masks: list[int]) -> Column:
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def _bucketed(rows: DataFrame, masks: Column, choice: str) -> DataFrame:
    """Each row once per mask, with the mask's number and the masked bits."""
    dealt = rows.select("*", F.posexplode(masks).alias(choice, "mask"))
    return dealt.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")


def _members(rows: DataFrame, *keys: str) -> DataFrame:
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_set("fp")).alias("members"))
    return grouped.where(F.size("members") > 1).select("members").distinct()


def links(distinct: DataFrame, distance: int, crowded: int = CROWDED) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within ``distance`` bits, for a
    stored frame of distinct fingerprints ``fp``."""
    everything = (1 << BITS) - 1
    masks = block_masks(BITS, distance + 3, 3, everything)
    dealt = _bucketed(distinct.select("fp"), _array(masks), "choice")
    sizes = dealt.groupBy("choice", "bits").agg(F.count(F.lit(1)).alias("size"))
    sizes = materialize(sizes.where(F.col("size") > 1), "bucket-sizes")
    shared = dealt.join(sizes, ["choice", "bits"])
    found = _links(_members(shared.where(F.col("size") <= crowded), "choice", "bits"), distance)
    if sizes.where(F.col("size") > crowded).isEmpty():
        return found
    full = shared.where(F.col("size") > crowded).select("fp", "choice")
    again = F.array(*[_array(_finer_masks(mask, distance)) for mask in masks])
    dealt = _bucketed(full, again[F.col("choice")], "part")
    return found.unionByName(_links(_members(dealt, "choice", "part", "bits"), distance))


def _finer_masks(mask: int, distance: int) -> list[int]:
    """Masks for rows that agree on ``mask``: blocks of about 4 of the other bits, of which
    ``distance`` stay open."""
    other = (1 << BITS) - 1 & ~mask
    width = other.bit_count()
    blocks = max(distance + 1, width // 4)
    return [mask | m for m in block_masks(width, blocks, blocks - distance, other)]


def groups(prints: DataFrame, key: str, distance: int) -> DataFrame:
    """A stored frame with ``key`` and ``fp``, and for each row ``root`` (a fingerprint that
    stands for the group) and ``component`` (the least key reachable)."""
    distinct = materialize(prints.groupBy("fp").agg(F.min(key).alias("least")), "fingerprints")
    linked = materialize(links(distinct, distance), "near")
    roots = materialize(components(linked).withColumnRenamed("node", "fp"), "roots")
    best = roots.join(distinct, "fp").groupBy("root").agg(F.min("least").alias("component"))
    reached = roots.join(best, "root").select("fp", "root", "component")
    named = distinct.join(reached, "fp", "left").select(
        "fp",
        F.coalesce("root", "fp").alias("root"),
        F.coalesce("component", "least").alias("component"),
    )
    named = materialize(named, "components")
    return lookup_join(prints, named, ["fp"], named.count())


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits) and ``component_id`` for every row."""
    prints = df.select(F.col(key).alias("key"), fingerprints(F.col(text), shingle).alias("fp"))
    found = groups(materialize(prints, "prints"), "key", distance)
    return found.select(
        F.col("key").alias(key),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_one(
    df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """One row of each group, with the columns of ``df``: the one with the least key. Of rows that
    repeat that key one stays, and of a group without any key one row stays."""
    prints, place = free_name(df, "_fp"), free_name(df, "_place")
    numbered = df.withColumn(prints, fingerprints(F.col(text), shingle))
    stored = materialize(numbered.withColumn(place, F.monotonically_increasing_id()), "printed")
    narrow = stored.select(
        F.col(key).alias("key"), F.col(prints).alias("fp"), F.col(place).alias("place")
    )
    first = F.min_by("place", F.struct(F.col("key").isNull(), "key", "place"))
    kept = groups(narrow, "key", distance).groupBy("root").agg(first.alias(place))
    chosen = materialize(kept.select(place), "kept")
    # about as many rows as documents: joined by sorting at every size, never broadcast
    return stored.join(chosen.hint("merge"), place, "left_semi").select(*df.columns)
