"""Trie of conversation prefixes, with what sharing them saves.

A conversation is cut into blocks of ``WIDTH`` turns, a row each, with one column per position that
holds the turn's id (a digest of role and text) and its words. ``GROUP BY`` the block's key and a
``ROLLUP`` over the position columns aggregates all prefixes together; ``grouping_id`` tells a
prefix's depth. Long conversations go on in further blocks, keyed by the node that the block
before ended in. That key is a digest of all earlier turns, found in a tree of at most ``FAN``
digests a step, so no task reads a conversation as a whole, however long it is.

Subtree sums need no walk through the tree either. A node is told to its smallest member, who owns a
suffix of the path below it: from the depth where it first is the smallest, to its end. So the nodes
of a subtree are the suffixes of its members, and a second ``ROLLUP`` adds these up beside the
member counts:

* words over a subtree's nodes, once for each member: all members' words less those before the node;
* words over a subtree's nodes, once: the members' suffixes, the smallest member's from the node on;
* leaves: members that own a leaf; children: members that are first smallest one step below.

Skew: counts and sums are aggregated before they move, so a prefix that a third of all conversations
share is one row a task. The ids that end in a node are joined and hashed in order: at most ``ENDS``
ids at a time become a piece of text, and the pieces of a node pass through one incremental
SHA-256, which is sequential by its nature but holds one piece only.

Defined results: a null role or text is an empty one; turns without a conversation's id belong to none
and are left out; null turn numbers come first; turns with the same number are ordered by their id;
repeated rows are turns like others; extra columns are ignored; an empty table has no trie. Texts
are digested whole, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starmill.operators.keys import surrogate_key
from starmill.operators.lookup import lookup_join
from starmill.sources.workdir import materialize

WIDTH = 8  # turns of a block
FAN = 64  # digests that are joined in one step towards a block's key
ENDS = 4096  # conversation ids are joined in ranges of this width
ROOT = b"\x00" * 16
EMPTY = hashlib.sha256(b"").hexdigest()
SLOTS = [f"t{i}" for i in range(1, WIDTH + 1)]


def digest(value: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv``, ``place`` (from 1 on), ``id`` and ``words`` of every turn.

    Turns are numbered over all conversations at once by sorted ranges, so that one conversation
    may be as long as it likes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        # the length in front keeps role and text apart
        digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("id"),
        F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"),
    )
    # stored, as the numbering reads them three times: for a sketch, for the ranges, to sort
    numbered = surrogate_key(materialize(turns, "turns"), ["conv", "turn", "id"], "number")
    starts = materialize(numbered.groupBy("conv").agg(F.min("number").alias("start")), "starts")
    placed = lookup_join(numbered, starts, ["conv"], starts.count())
    return placed.select("conv", (F.col("number") - F.col("start") + 1).alias("place"), "id", "words")


def rebuilt_turns(
    turns: DataFrame, family: int = 20, openings: int = 4
) -> tuple[DataFrame, DataFrame]:
    """``(turns, conversations)`` with shared openings: conversation c begins with the first h turns of
    ``c - c % family`` (as many as that has), then come its own turns after its first h, where
    h = crc32(c) % ``openings``. Turns have ``conv``, ``depth``, ``id``, ``words``; every
    conversation is in the second frame, those left without turns included."""
    turns = materialize(turns, "turns")
    first = turns.where(F.col("place") < openings).groupBy(F.col("conv").alias("base")).agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "words"))).alias("opening")
    )
    shared = F.crc32(F.col("conv").cast("string")) % openings
    convs = turns.select("conv").distinct().select(
        "conv", shared.cast("int").alias("h"), (F.col("conv") - F.col("conv") % family).alias("base")
    )
    none = F.array().cast(first.schema["opening"].dataType)
    opening = F.slice(F.coalesce("opening", none), F.lit(1), F.col("h"))
    convs = convs.join(first, "base", "left").select("conv", "h", opening.alias("opening"))
    convs = materialize(convs, "openings")
    sizes = convs.select("conv", "h", F.size("opening").alias("n"))
    own = lookup_join(turns, sizes, ["conv"], convs.count()).where(F.col("place") > F.col("h"))
    own = own.select(
        "conv", (F.col("place") - F.col("h") + F.col("n")).alias("depth"), "id", "words"
    )
    opened = convs.select("conv", F.posexplode("opening").alias("pos", "turn")).select(
        "conv", (F.col("pos") + 1).cast("long").alias("depth"), "turn.id", "turn.words"
    )
    return own.unionByName(opened), convs.select("conv")


def blocks_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Rows of at most ``WIDTH`` turns: ``conv``, ``at`` (the block's number), ``turns`` in order,
    ``digest`` and ``words``. A conversation without turns has one row without turns."""
    none = F.lit(None)
    marks = convs.select(
        "conv", none.cast("long").alias("depth"), none.cast("binary").alias("id"),
        none.cast("long").alias("words"),
    )
    at = F.coalesce(((F.col("depth") - 1) / WIDTH).cast("long"), F.lit(0))
    turn = F.when(F.col("depth").isNotNull(), F.struct("depth", "id", "words"))
    rows = turns.unionByName(marks).groupBy("conv", at.alias("at")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns")
    )
    whole = F.aggregate("turns", F.lit(b""), lambda ids, t: F.concat(ids, t["id"]))
    words = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["words"])
    return rows.select("conv", "at", "turns", digest(whole).alias("digest"), words.alias("words"))


def with_keys(blocks: DataFrame, *carried: str) -> DataFrame:
    """``blocks`` with ``before`` and ``after``, the digests of all turns before the block and up to
    its end, and ``ahead``, the words before it.

    Up to ``FAN`` blocks are joined to one larger block, these again, and so on; a block's key
    joins, level by level, the key of the larger block and the digests between its start and the
    block. Equal prefixes have equal keys, as the levels are the same for all conversations.
    """
    group = (F.col("at") / FAN).cast("long").alias("group")
    groups = blocks.groupBy("conv", group).agg(
        F.sort_array(F.collect_list(F.struct("at", "digest", "words", *carried))).alias("run")
    )
    groups = materialize(groups, "runs")
    if (groups.agg(F.max("group")).first()[0] or 0) > 0:
        whole = F.aggregate("run", F.lit(b""), lambda ids, b: F.concat(ids, b["digest"]))
        words = F.aggregate("run", F.lit(0).cast("long"), lambda n, b: n + b["words"])
        larger = with_keys(
            groups.select("conv", F.col("group").alias("at"), digest(whole).alias("digest"),
                          words.alias("words"))
        ).select("conv", F.col("at").alias("group"), "before", "after", "ahead")
        groups = groups.join(larger, ["conv", "group"])
    else:
        nothing = {"before": F.lit(ROOT), "after": F.lit(None).cast("binary"),
                   "ahead": F.lit(0).cast("long")}
        groups = groups.withColumns(nothing)

    def up_to(count: Column) -> Column:
        some = F.slice("run", F.lit(1), count)
        return F.aggregate(some, F.col("before"), lambda ids, b: F.concat(ids, b["digest"]))

    def keyed(block: Column, i: Column) -> Column:
        some = F.slice("run", F.lit(1), i)
        ahead = F.aggregate(some, F.col("ahead"), lambda n, b: n + b["words"])
        # the last block of a full group ends where the group ends
        last = (i == FAN - 1) & F.col("after").isNotNull()
        return F.struct(
            block.alias("block"),
            F.when(i == 0, F.col("before")).otherwise(digest(up_to(i))).alias("before"),
            F.when(last, F.col("after")).otherwise(digest(up_to(i + 1))).alias("after"),
            ahead.alias("ahead"),
        )

    rows = groups.select("conv", F.explode(F.transform("run", keyed)).alias("row"))
    return rows.select("conv", "row.block.*", "row.before", "row.after", "row.ahead")


def prefix_key(depth: int) -> Column:
    """Key of the prefix that ends ``depth`` turns into the block."""
    if depth == 0:
        return F.col("before")
    if depth == WIDTH:
        return F.col(f"{SLOTS[-1]}.id")
    return digest(F.concat("before", *[F.col(f"{t}.id") for t in SLOTS[:depth]]))


def chosen(depth: Column, options: list[Column]) -> Column:
    """The option whose position is ``depth``; only that one is evaluated."""
    found = F.when(depth == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        found = found.when(depth == i, option)
    return found


def rollup(blocks: DataFrame, sums: str) -> DataFrame:
    """All prefixes: ``key``, ``parent`` (key), ``depth``, ``passed`` (words before its last turn),
    ``step`` (depth within the block), and the aggregates ``sums``."""
    slots = ", ".join(SLOTS)
    nodes = blocks.sparkSession.sql(
        f"""SELECT at, before, ahead, {slots}, {WIDTH} - bit_count(grouping_id()) AS step, {sums}
        FROM {{blocks}} GROUP BY at, before, ahead, ROLLUP ({slots})""",
        blocks=blocks,
    )
    step = F.col("step")
    # absent turns are null: such a group repeats a shorter prefix, as does a later block's start
    there = chosen(step, [F.col("at") == 0, *[F.col(t).isNotNull() for t in SLOTS]])
    words, passed = [F.lit(0).cast("long")], F.lit(0).cast("long")
    for t in SLOTS:
        words.append(passed)
        passed = passed + F.col(f"{t}.words")
    kept = nodes.where(there)
    return kept.select(
        chosen(step, [prefix_key(i) for i in range(WIDTH + 1)]).alias("key"),
        chosen(step, [F.lit(None).cast("binary"), *[prefix_key(i) for i in range(WIDTH)]]).alias("parent"),
        (F.col("at") * WIDTH + step).alias("depth"),
        (F.col("ahead") + chosen(step, words)).alias("passed"),
        *[c for c in nodes.columns if c not in {"at", "before", "ahead", *SLOTS}],
    )


def end_hashes(ends: DataFrame) -> DataFrame:
    """``key`` and the SHA-256 of its comma-joined ``conv`` ids in ascending order."""
    piece = F.floor(F.col("conv") / ENDS).alias("piece")
    ids = F.sort_array(F.collect_list("conv")).cast("array<string>")
    pieces = ends.groupBy("key", piece).agg(F.array_join(ids, ",").alias("ids"))
    dealt = pieces.repartition("key").sortWithinPartitions("key", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            keys, hashes = [], []
            for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if key == last:
                    state.update(b"," + ids.encode())
                    continue
                if last is not None:
                    keys.append(last)
                    hashes.append(state.hexdigest())
                last, state = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], ["key", "ends_sha256"]
            )
        if last is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([last], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"]
            )

    return dealt.mapInArrow(run, "key binary, ends_sha256 string")


def owners(nodes: DataFrame) -> DataFrame:
    """Per conversation that is some node's smallest member: ``top`` (the least depth of those nodes),
    ``spent`` (words before that node's last turn), ``over`` (the smallest member of the node
    above) and ``leaf`` (1 if it owns a childless node)."""
    own = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("depth").alias("top"),
        F.min_by(F.struct("parent", "passed"), "depth").alias("first"),
        F.max((F.col("longest") == F.col("depth")).cast("int")).alias("leaf"),
    )
    own = own.select("conv", "top", F.col("first.passed").alias("spent"), "leaf", "first.parent")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("over"))
    own = materialize(own, "owners")
    return lookup_join(own, above, ["parent"], nodes.count()).drop("parent")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix. ``turns`` has ``conv``, ``depth`` (1, 2, ...), ``id``, ``words``;
    ``convs`` lists all conversations (``conv``), those without turns included."""
    turns = materialize(turns, "rebuilt")
    totals = convs.join(
        turns.groupBy("conv").agg(F.max("depth").alias("length"), F.sum("words").alias("total")),
        "conv", "left",
    ).select("conv", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("length", "total")])
    totals = materialize(totals, "totals")
    size = totals.count()
    blocks = with_keys(blocks_of(turns, convs), "turns")
    blocks = lookup_join(blocks, totals, ["conv"], size)
    slots = [F.get("turns", F.lit(i)) for i in range(WIDTH)]
    last = F.when(slots[-1].isNotNull(), F.struct(F.col("after").alias("id"), slots[-1]["words"]))
    slots = [F.when(s.isNotNull(), F.struct(s["id"], s["words"])) for s in slots[:-1]] + [last]
    blocks = materialize(
        blocks.select(
            "conv", "at", "before", "ahead", "length", "total",
            F.size("turns").alias("held"), *[s.alias(t) for s, t in zip(slots, SLOTS)],
        ),
        "blocks",
    )
    nodes = materialize(rollup(blocks, "min(conv) AS conv_id, max(length) AS longest"), "nodes")
    owned = materialize(owners(nodes), "owned")
    facts = lookup_join(totals, owned, ["conv"], owned.count())
    facts = materialize(
        facts.select(
            "*", F.coalesce(F.col("total") - F.col("spent"), F.lit(0).cast("long")).alias("suffix")
        ),
        "facts",
    )
    marked = lookup_join(blocks, facts.select("conv", "top", "leaf", "suffix"), ["conv"], size)
    below = ", ".join(
        f"count_if(top = at * {WIDTH} + {i + 1}) AS below{i}" for i in range(WIDTH + 1)
    )
    summed = rollup(
        marked,
        "min(conv) AS conv_id, count(*) AS n_convs, sum(total) AS words, sum(suffix) AS suffixes,"
        f" coalesce(sum(leaf), 0) AS n_leaves, {below}",
    )
    ends = marked.where(F.greatest(F.col("length") - 1, F.lit(0)).cast("long") - F.col("at") * WIDTH < WIDTH)
    ends = ends.select(
        chosen(F.col("held"), [prefix_key(i) for i in range(WIDTH + 1)]).alias("key"), "conv"
    )
    own = facts.select(
        F.col("conv").alias("conv_id"), "length", "total", "top", "over", "suffix"
    )
    rows = lookup_join(summed, own, ["conv_id"], size).join(end_hashes(ends), "key", "left")
    each = F.col("words") - F.col("n_convs") * F.col("passed")
    once = F.col("suffixes") - F.col("suffix") + F.col("total") - F.col("passed")
    goes_on = (F.col("length") > F.col("depth")).cast("long")
    begun = chosen(F.col("step"), [F.col(f"below{i}") for i in range(WIDTH + 1)])
    return rows.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("top") < F.col("depth"), F.col("conv_id")).otherwise(F.col("over"))
        .alias("parent_conv_id"),
        "n_convs",
        (begun + goes_on).alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        (each - once).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are."""
    turns = materialize(ordered_turns(conversations), "turns")
    return trie(turns.withColumnRenamed("place", "depth"), turns.select("conv").distinct())


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations rebuilt with shared openings."""
    return trie(*rebuilt_turns(ordered_turns(conversations)))
