import re
from collections import Counter

from corpus import SF, docs  # noqa: F401

from starmill.llm import quality_rules as q
from starmill.llm.queries import QUERIES

SPACE = "[^\x20\x09-\x0d]+"


def brute(text):
    text = text or ""
    words = re.findall(SPACE, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(SPACE, x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines),
        len(lines) - len(set(lines)), len(covered), len(re.findall("[A-Z]", text)),
    )


EDGES = [
    None, "", " \n\t", "one", "a b c", "a b c a b c", "a b c d a b c", "x x x x", "é ü\nß\n\né ü",
    "same line\nsame line\nsame line", "a b c", "A# *b* |", "w " * 30_000,
    " ".join(f"w{i}" for i in range(20_000)),
]


def test_measurements_match_brute_force(docs):
    rows = q.ledger(docs(EDGES)).orderBy("doc_id").collect()
    assert [tuple(r[m] for m in q.MEASURES) for r in rows] == [brute(t) for t in EDGES]


def test_whole_table_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in QUERIES["op5_quality_rules"](spark, SF).collect():
        words, chars, symbols, lines, dup, repeats, upper = brute(texts[row.doc_id])
        assert (row.n_words, row.word_chars, row.n_symbols) == (words, chars, symbols)
        assert (row.n_dup_lines, row.n_repeat_words) == (dup, repeats)
        failed = words < 50 or 100 * repeats > 50 * words
        assert row.base_failed == failed
        more = 10 * symbols > words or 10 * upper > 3 * chars or not 3 * words <= chars <= 10 * words
        assert row.kept == (not (failed or more or 10 * dup > 3 * lines))


def test_policies_and_ablation(docs):
    good = " ".join(f"word{i}" for i in range(60))
    stored = q.ledger(docs([good, "few words", good + " ###" * 10, "few ### ###"])).cache()
    kept = {r.doc_id: r.kept for r in q.apply_policy(stored, "v1").collect()}
    assert kept == {0: True, 1: False, 2: False, 3: False}
    report = {r.rule: r for r in q.ablation(stored, "v1").collect()}
    assert (report["few_words"].failed, report["few_words"].failed_alone) == (2, 1)
    assert (report["symbols"].failed, report["symbols"].kept_without) == (2, 2)


def test_many_different_words_stay_exact():
    q._numbers.clear()
    for i in range(1 << q.NUMBER_BITS):
        q._numbers[b"%d" % i] = i
    q_limit, q.WordNumbers.fresh = q.WordNumbers.fresh, lambda self: self
    try:
        assert q.repeated_words(b"p q r s p q r".split()) == 6
    finally:
        q.WordNumbers.fresh = q_limit
        q._numbers.clear()


def test_clashing_columns_and_empty(docs):
    named = docs(["w " * 5, " ".join(map(str, range(100, 160)))]).withColumnRenamed("lang", "_failed")
    assert q.apply_rules(named).columns == named.columns
    assert [r.doc_id for r in q.apply_rules(named).collect()] == [1]
    assert q.apply_rules(docs([]), text="text").count() == 0
    assert q.ledger(docs([])).count() == 0


def test_labelled_good_documents_are_kept(spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    judged = QUERIES["op5_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    good = judged.where("quality = 1 AND NOT base_failed")
    assert good.where("NOT kept").count() <= 0.01 * good.count()
