import random

import numpy as np
import xxhash
from corpus import SF, docs  # noqa: F401

from starmill.llm import simhash
from starmill.llm.graph import components
from starmill.llm.queries import QUERIES


def brute_print(text, k=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )


def brute_groups(prints):
    """Least index reachable over pairs of at most 3 bits."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    values = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 3) + i + 1:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check(rows, texts):
    ids = sorted(texts)
    prints = [brute_print(texts[i]) for i in ids]
    groups = brute_groups(prints)
    expected = {i: (f"{p:016x}", ids[g]) for i, p, g in zip(ids, prints, groups)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == expected


def test_whole_table_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(QUERIES["op10_simhash"](spark, SF).collect(), texts)


def test_edges(spark, docs):
    texts = [None, "", "one", "ONE", "one two", "É é", "a b c " * 50_000, "a b c " * 50_000]
    check(simhash.near_duplicates(docs(texts)).collect(), dict(enumerate(texts)))
    assert simhash.near_duplicates(docs([])).count() == 0


def test_null_and_repeated_keys(docs):
    frame = docs([(None, "x y z"), (7, "x y z"), (7, "x y z"), (None, "q r s"), (None, "u v w t")])
    rows = simhash.near_duplicates(frame).collect()
    assert sorted(r.component_id or -1 for r in rows) == [-1, -1, 7, 7, 7]
    kept = simhash.keep_one(frame.withColumnRenamed("lang", "_fp"))
    assert sorted(((r.doc_id or -1), r.text) for r in kept.collect()) == [
        (-1, "q r s"), (-1, "u v w t"), (7, "x y z")]
    assert simhash.keep_one(docs([])).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    """Random clouds of fingerprints around a few centres, with buckets dealt out again."""
    draw = random.Random(3)
    prints = []
    for _ in range(4):
        centre = draw.getrandbits(64)
        for _ in range(150):
            flips = draw.sample(range(64), draw.randint(0, 5))
            prints.append(centre ^ sum(1 << f for f in flips))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    distinct = spark.createDataFrame([(p,) for p in signed], "fp long")
    for crowded in (1024, 4):
        links = simhash.links(distinct, 3, crowded)
        root = {r.node: r.root for r in components(links).collect()}
        mine = [root.get(p, p) for p in signed]
        brute = brute_groups(prints)
        assert len(set(mine)) == len(set(brute))
        assert len(set(zip(mine, brute))) == len(set(brute))


def test_masks_leave_the_promised_bits_open():
    masks = simhash.block_masks(64, 6, 3, (1 << 64) - 1)
    assert len(masks) == 20 and all(30 <= m.bit_count() <= 34 for m in masks)
    for mask in masks:
        assert all((~f & (1 << 64) - 1).bit_count() <= 15 for f in simhash._finer_masks(mask, 3))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 40)]
    edges = spark.createDataFrame([*path, *star, (5, 5), (2000, 2000)], "a long, b long")
    root = {r.node: r.root for r in components(edges).collect()}
    assert {root[i] for i in range(61)} == {0}
    assert {root[1000 + i] for i in range(40)} == {1000}
    assert 2000 not in root
