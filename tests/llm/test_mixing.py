import numpy as np
from corpus import docs, prose  # noqa: F401

from starmill.llm import mixing as m
from starmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
P = [f"p_{d}" for d in m.DOMAINS]


def test_whole_table_meets_the_targets(spark):
    rows = QUERIES["op9_mixing"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count() and (rows.rate >= 0).all()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert (rows.n_tokens == rows.doc_id.map(words)).all()
    assert np.allclose(rows[P].sum(axis=1), 1, atol=3 / m.GRID)
    totals = (rows[P].T * rows.rate * rows.n_tokens).sum(axis=1)
    wanted = np.array([m.TARGETS[d] for d in m.DOMAINS]) * rows.n_tokens.sum()
    assert np.allclose(totals, wanted, rtol=1e-6)
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().merge(rows, on="doc_id")
    truth = np.where(labels.toxic == 1, 2, np.where(labels.quality == 1, 0, 1))
    assert (labels[P].to_numpy().argmax(axis=1) == truth).mean() > 0.9


def test_rates_match_plain_projected_gradient(spark):
    """Least change of the rates that meets the targets, against a slow solver."""
    draw = np.random.default_rng(2)
    p = np.round(draw.dirichlet([0.5] * 3, 60) * m.GRID) / m.GRID
    tokens = draw.integers(1, 400, 60).astype(float)
    frame = spark.createDataFrame(
        [(int(t), q.tolist()) for t, q in zip(tokens, p)], "tokens long, posterior array<double>")
    targets = {"good": 0.75, "poor": 0.05, "toxic": 0.2}
    step = m.fit_step(frame, targets)
    rate = np.maximum(0, 1 + p @ np.array(step))
    wanted = tokens.sum() * np.array([0.75, 0.05, 0.2])
    slow, size = np.zeros(3), 0.2 / tokens.sum()
    for _ in range(60_000):
        slow -= size * (p.T @ (tokens * np.maximum(0, 1 + p @ slow)) - wanted)
    assert np.allclose(p.T @ (tokens * rate), wanted, rtol=1e-6)
    assert np.allclose(rate, np.maximum(0, 1 + p @ slow), atol=1e-3)


def test_targets_out_of_reach_end(spark):
    frame = spark.createDataFrame([(10, [1.0, 0.0, 0.0])], "tokens long, posterior array<double>")
    step = m.fit_step(frame, {"good": 0.5, "poor": 0.25, "toxic": 0.25})
    assert abs(max(0, 1 + step[0]) - 0.5) < 1e-6
    assert m.fit_step(frame.where("false"), m.TARGETS) == [0.0] * 3


def test_main_path_is_native(spark):
    explained = QUERIES["op9_mixing"](spark, SF)
    text = explained._sc._jvm.PythonSQLUtils.explainString(explained._jdf.queryExecution(), "simple")
    assert "Python" not in text and "Arrow" not in text


def test_edges(spark, docs):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 1), (2, 1, None)],
                                   "doc_id long, quality int, toxic int")
    frame = docs([None, "", " \n", prose(1, 40), (None, "x y")]).withColumnRenamed("lang", "_tokens")
    rows = m.mixing_rates(frame, labels).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 0, 2, 40]
    some = spark.createDataFrame([(0, 0, 0), (3, 1, 0), (3, 1, 0), (2, 1, 1)], labels.schema)
    mixed = m.mix(frame.withColumnRenamed("source", "rate"), some)
    assert mixed.columns == [*frame.columns[:3], "rate", "n_chars", "rate_", "unmet"]
    assert mixed.count() == 5
    assert m.mixing_rates(docs([]), labels).count() == 0 and m.mix(docs([]), some).count() == 0


def test_posteriors_are_not_rounded(spark, docs):
    """Thirds and posteriors far below 1 / GRID, against a plain softmax."""
    single = docs(["x"])
    even = m.Classifier([0.0] * 3, {}).with_posterior(single, m.words_of(single.text), "p")
    assert np.allclose(even.first().p, [1 / 3] * 3, rtol=1e-12)
    bias, weights = [0.0, -1.0, -9.0], {"rare": [0.0, 0.5, 2.0], "good": [1.5, 0.0, -3.0]}
    texts = ["rare", "good", "rare good", "none"]
    frame = docs(texts)
    rows = m.Classifier(bias, weights).with_posterior(frame, m.words_of(frame.text), "p").collect()
    for r in rows:
        score = np.array(bias) + sum((np.array(weights[w]) for w in r.text.split() if w in weights),
                                     np.zeros(3))
        assert np.allclose(r.p, np.exp(score) / np.exp(score).sum(), rtol=1e-12)
        assert 0 < r.p[2] < 1 / (2 * m.GRID) and abs(sum(r.p) - 1) < 1e-12


def test_whole_table_meets_the_targets_unrounded(spark):
    rows = QUERIES["op9_mixing"](spark, SF).toPandas()
    p, tokens = rows[P].to_numpy(), rows.n_tokens.to_numpy()
    assert np.allclose(p.sum(axis=1), 1, atol=1e-12) and (p > 0).all()
    assert not np.allclose(p * m.GRID, np.round(p * m.GRID), atol=1e-6)
    wanted = np.array([m.TARGETS[d] for d in m.DOMAINS]) * tokens.sum()
    assert np.abs(p.T @ (tokens * rows.rate) - wanted).max() <= 2 * m.TOLERANCE * tokens.sum()


def test_targets_beyond_the_documents_are_lowered():
    present = {"good": 0.9, "poor": 0.001, "toxic": 0.099}
    goal = m.attainable(m.TARGETS, present)
    assert goal["poor"] == m.REPEAT * 0.001 and abs(sum(goal.values()) - 1) < 1e-12
    assert abs(goal["good"] / goal["toxic"] - 93) < 1e-9
    assert m.attainable({"good": 3, "poor": 1, "toxic": 0}, dict.fromkeys(m.DOMAINS, 0.3)) == {
        "good": 0.75, "poor": 0.25, "toxic": 0.0}
    assert m.attainable(m.TARGETS, dict.fromkeys(m.DOMAINS, 0.0)) == m.TARGETS


def test_mixture_keeps_every_row_and_tells_what_is_unmet(spark):
    """With no poor documents left, the rest still meets the targets it can meet."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    p = m.mixing_rates(docs, labels).where("p_poor < 0.001").select("doc_id")
    some = docs.join(p, "doc_id").select(*docs.columns)
    rows = m.mix(some, labels).toPandas()
    assert len(rows) == p.count() and rows.doc_id.is_unique and (rows.rate == 0).any()
    assert rows.unmet.nunique() == 1 and 0.05 < rows.unmet[0] < 0.061
    whole = m.mix(docs, labels).toPandas()
    assert len(whole) == docs.count() and whole.unmet[0] < 1e-6
    posteriors = m.mixing_rates(some, labels).toPandas().set_index("doc_id")
    own = posteriors.loc[rows.doc_id]
    totals = own[P].to_numpy().T @ (own.n_tokens.to_numpy() * rows.rate.to_numpy())
    shares = totals / own.n_tokens.sum()
    present = own[P].to_numpy().T @ own.n_tokens.to_numpy() / own.n_tokens.sum()
    goal = m.attainable(m.TARGETS, dict(zip(m.DOMAINS, present)))
    assert np.allclose(shares, [goal[d] for d in m.DOMAINS], atol=1e-6)
