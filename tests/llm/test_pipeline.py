"""The pipeline against its stages' brute-force versions."""

import corpus_pipeline
import test_decontaminate
import test_quality_rules
import test_simhash
from corpus import SF, docs, prose  # noqa: F401

from starmill.llm import pii


def kept_by_quality(text):
    words, chars, symbols, lines, dup, repeats, upper = test_quality_rules.brute(text)
    return not (
        words < 50 or 100 * repeats > 50 * words or 10 * symbols > words or 10 * upper > 3 * chars
        or not 3 * words <= chars <= 10 * words or 10 * dup > 3 * lines
    )


def test_whole_pipeline_matches_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    left = sorted(k for k, t in texts.items() if kept_by_quality(t))
    groups = test_simhash.brute_groups([test_simhash.brute_print(texts[k]) for k in left])
    left = [left[i] for i in sorted(set(groups))]
    short = {k: texts[k] for k in left if len(texts[k]) < 6000}
    leaked = {k for k, _ in test_decontaminate.brute(short, items)}
    found = {r.doc_id: r for r in rows}
    assert set(found) & set(short) == set(short) - leaked
    assert set(found) <= set(left)
    for r in rows:
        assert r.text == pii.redacted(texts[r.doc_id]) and r.n_chars == len(r.text) and r.rate >= 0


def test_stages_keep_the_columns_and_take_edge_cases(spark, docs):
    frame = docs([None, "", (None, prose(1, 80)), (5, prose(2, 80)), (5, prose(2, 80)), "x " * 70])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.schema.simpleString() == frame.schema.simpleString()
        out.collect()
        assert stage(spark, frame.where("false"), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, frame, SF)
    assert last.columns == [*frame.columns, "rate", "unmet"]
    assert last.count() == frame.count()
