import zlib

import numpy as np
from corpus import docs, prose  # noqa: F401

from starmill.llm import quality_model as q
from starmill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    good = labels == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    rows = QUERIES["op8_quality_model"](spark, SF)
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    known = rows.join(labels, "doc_id").toPandas()
    assert (known.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in known.doc_id]).all()
    held = known[known.held_out]
    assert auc(held.score.to_numpy(), held.quality.to_numpy()) > 0.9
    right = held.predicted == held.quality
    assert right.mean() > 0.9 and held[held.quality == 1].predicted.mean() > 0.97
    assert known.score.between(0, 1).all() and (known.predicted == (known.score >= 0.3)).all()


def test_normal_equations_and_folds_match_numpy(spark):
    draw = np.random.default_rng(0)
    values = draw.normal(size=(500, len(q.STATISTICS))).astype(np.float32)
    labels, folds = draw.integers(0, 2, 500), draw.integers(0, q.FOLDS, 500)
    rows = spark.createDataFrame(
        [(v.tolist(), float(y), int(f)) for v, y, f in zip(values, labels, folds)],
        "values array<float>, label double, fold long").repartition(3)
    kernel = q.Kernel(np.zeros(len(q.STATISTICS)), np.ones(len(q.STATISTICS)))
    sums = q._normal_sums(rows, kernel)
    for f in range(q.FOLDS):
        x = kernel.features(values[folds == f])
        assert sums[f][0] == (folds == f).sum()
        assert np.allclose(sums[f][1], x.T @ x) and np.allclose(sums[f][2], x.T @ labels[folds == f])


def test_features_approximate_the_gaussian_kernel():
    draw = np.random.default_rng(1)
    values = draw.normal(size=(40, len(q.STATISTICS)))
    kernel = q.Kernel(np.zeros(len(q.STATISTICS)), np.ones(len(q.STATISTICS)))
    waves = kernel.features(values)[:, :-1]
    far = ((values[:, None] - values[None]) ** 2).sum(-1)
    assert np.abs(waves @ waves.T - np.exp(-far / (2 * q.WIDTH**2))).mean() < 0.1


def test_isotonic_fit_is_the_best_rising_one():
    bins = [(0.1, 2, 0.5), (0.2, 1, 0.2), (0.3, 1, 0.45), (0.5, 3, 0.9), (0.7, 1, 0.6)]
    scores, values = q.pooled(bins)
    assert (np.diff(values) > 0).all() and (np.diff(scores) > 0).all()
    assert np.allclose(values, [0.4, 0.45, 0.825])


def test_edges(spark, docs):
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0)],
                                   "doc_id long, quality int, toxic int")
    frame = docs([None, "", prose(1, 30), (None, "x")]).withColumnRenamed("lang", "values")
    rows = q.quality_scores(frame, labels).collect()
    assert {r.score for r in rows} == {0.5} and len(rows) == 4
    assert [r.held_out for r in rows if r.doc_id is None] == [True]
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)], labels.schema)
    assert all(r.score > 0.5 for r in q.quality_scores(frame, one).collect())
    assert q.quality_scores(docs([]), labels).count() == 0
    assert len(q.statistics(b"word " * 300_000)) == len(q.STATISTICS)
