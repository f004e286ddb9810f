import random
from collections import Counter

from corpus import SF, docs, prose  # noqa: F401

from starmill.llm import decontaminate as d
from starmill.llm.queries import QUERIES


def normal(text):
    words = [w.lower().strip(d.EDGES) for w in (text or "").split()]
    return [w for w in words if w]


def shingles(words, k):
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute(texts, items):
    """Best similarity of every window of every document with every item."""
    found = {}
    for i, item in items.items():
        words = normal(item)
        if not words:
            continue
        k = min(5, len(words))
        bag = Counter(shingles(words, k))
        for n, text in texts.items():
            every = shingles(normal(text), k)
            size = sum(bag.values())
            for at in range(len(every) - size + 1):
                window = Counter(every[at : at + size])
                alike = sum((window & bag).values()) / sum((window | bag).values())
                if alike >= 0.8:
                    found[n, i] = max(alike, found.get((n, i), 0))
    return found


def edited(words, changes, seed):
    draw = random.Random(seed)
    words = list(words)
    for _ in range(changes):
        words[draw.randrange(len(words))] = "changed"
    return words


def test_exact_and_near_copies_match_brute_force(spark, docs):
    items = {i: prose(900 + i, 20 + 5 * i) for i in range(8)} | {8: "two words", 9: "", 10: None}
    texts = {}
    for n in range(40):
        item = items[n % 8].split()
        middle = edited(item, n // 16, n) if n % 3 else [w.upper() + "!" for w in item]
        texts[n] = prose(n, 60) + " " + " ".join(middle) + " " + prose(n + 500, 40)
    texts |= {100: prose(100, 3000), 101: None, 102: "", 103: "just two words here", 104: "Two words"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    expected = brute(texts, items)
    for at_once in (20_000, 3):
        rows = d.contamination(docs(list(texts.items())), bench, items_at_once=at_once).collect()
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == {
            k: round(v, 9) for k, v in expected.items()}
    left = d.drop_contaminated(docs(list(texts.items())), bench, items_at_once=5)
    assert {r.doc_id for r in left.collect()} == set(texts) - {n for n, _ in expected}


def test_whole_table_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    close = {n: t for n, t in texts.items() if len(t) < 4000}
    expected = brute(close, items)
    rows = QUERIES["op3_decontaminate"](spark, SF).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.doc_id in close} == set(expected)
    assert expected


def test_index_misses_nothing_within_the_radius():
    draw = random.Random(1)
    items = [d.Item(i, d.words_of(prose(i, 30).encode()), Counter()) for i in range(50)]
    index = d.Index(items, d.RADIUS)
    for print_ in list(index.prints[:10]):
        for flips in range(0, d.RADIUS + 1, 4):
            moved = print_.copy()
            for bit in draw.sample(range(64), flips):
                moved[bit // 8] ^= 1 << bit % 8
            near = [
                k for k, p in enumerate(index.prints)
                if sum(int(x).bit_count() for x in p ^ moved) <= d.RADIUS
            ]
            assert index.candidates(moved).tolist() == near


def test_empty_tables_and_clashing_columns(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    frame = docs(["a b c d e f g", None]).withColumnRenamed("lang", "_clean")
    assert d.contamination(frame, bench).count() == 0
    assert d.drop_contaminated(frame, bench).count() == 2
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert d.drop_contaminated(frame, some).columns == frame.columns
    assert [r.doc_id for r in d.drop_contaminated(frame, some).collect()] == [1]
    assert d.contamination(docs([]), some).count() == 0


def brute_of_short(texts, items):
    """Similarity of every document of fewer shingles than an item, as a whole, with the item."""
    found = {}
    for i, item in items.items():
        words = normal(item)
        k = min(5, len(words))
        bag = Counter(shingles(words, k))
        for n, text in texts.items():
            whole = Counter(shingles(normal(text), k))
            if words and sum(whole.values()) < sum(bag.values()):
                alike = sum((whole & bag).values()) / sum((whole | bag).values())
                if alike >= 0.8:
                    found[n, i] = alike
    return found


def test_items_cut_short_match_brute_force(spark, docs):
    """A document of an item without its first or last words, some of them edited."""
    items = {i: prose(700 + i, n) for i, n in enumerate((8, 20, 59, 120, 500))}
    items |= {5: "one two three four", 6: " ".join([prose(5, 12)] * 5)}
    texts = {}
    for i, item in items.items():
        words = item.split()
        for part in (0.99, 0.95, 0.92, 0.85, 0.8, 0.7, 0.3):
            left = max(1, min(len(words) - 1, round(part * len(words))))
            for cut in (words[:left], words[-left:], edited(words[:left], 1, i)):
                texts[len(texts)] = " ".join(cut).upper()
    texts |= {1000: None, 1001: "", 1002: "one", 1003: prose(3, 30)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    expected = brute_of_short(texts, items)
    assert {i for _, i in expected} >= {1, 2, 3, 4, 6} and len(expected) > 40
    expected = brute(texts, items) | expected
    rows = d.contamination(docs(list(texts.items())), bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows} == {
        k: round(v, 9) for k, v in expected.items()}
    left = d.drop_contaminated(docs(list(texts.items())), bench, items_at_once=3)
    assert {r.doc_id for r in left.collect()} == set(texts) - {n for n, _ in expected}


def test_named_cuts_of_items_are_found(spark, docs):
    """56 of 59 words, 110 of 120 and 460 of 500."""
    items = {n: prose(n, n) for n in (59, 120, 500)}
    cuts = [" ".join(items[n].split()[:k]) for n, k in ((59, 56), (120, 110), (500, 460))]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = sorted(d.contamination(docs(cuts), bench).collect())
    assert [(r.doc_id, r.item_id, round(r.similarity, 2), r.first_word) for r in rows] == [
        (0, 59, 0.95, 0), (1, 120, 0.91, 0), (2, 500, 0.92, 0)]
