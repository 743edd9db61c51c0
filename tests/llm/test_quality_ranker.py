"""The quality classifier: held-out accuracy, thresholds and odd input."""

import zlib

import numpy as np
import pytest
from conftest import SF

from gavelstat.llm import quality_ranker as qr
from gavelstat.llm.frames import table

SF_001 = SF.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = table(spark, SF_001, "documents"), table(spark, SF_001, "labels")
    ranker = qr.fit(docs, labels)
    return docs, {r.doc_id: r for r in qr.score(docs, ranker).collect()}, {r.doc_id: r.quality for r in labels.collect()}, ranker


def test_held_out_accuracy(scored):
    docs, got, labels, _ = scored
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(labels[d], got[d]) for d in labels if d in got and got[d].held_out]
    assert np.mean([r.predicted == q for q, r in held]) > 0.95
    bad, good = ([r.score for q, r in held if q == k] for k in (0, 1))
    assert np.mean([b < g for b in bad for g in good]) > 0.97


def test_the_cut_is_a_quantile(scored):
    _, got, labels, _ = scored
    train = [(labels[d], got[d].predicted) for d in labels if d in got and not got[d].held_out]
    assert abs(sum(1 - p for _, p in train) - sum(1 - q for q, _ in train)) <= 1


def test_scores_do_not_depend_on_partitions(spark, scored):
    docs, got, _, ranker = scored
    again = qr.fit(docs.repartition(5), table(spark, SF_001, "labels").repartition(3))
    assert np.array_equal(again.weights, ranker.weights) and again.cut == ranker.cut


def test_preferences_are_learned():
    rng = np.random.default_rng(1)
    x, true = rng.normal(size=(400, 5)), np.asarray([2.0, -1, 0, 0, 0.5])
    better = x @ true > 0
    weights = qr.bradley_terry(x[better], x[~better])
    assert np.corrcoef(weights, true)[0, 1] > 0.95


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "GOOD " * 5), (None, "x"), (4, "word " * 40_000), (4, "\n"), (5, "🙂" * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS score", "'x' AS predicted", "1 AS _quality")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = qr.score(docs, qr.fit(docs, none)).collect()
    assert len(got) == len(rows) and {r.score for r in got} == {0.5}
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    some = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1), (4, 1), (9, 1), (6, None), (None, 1)], "doc_id bigint, quality int")
    ranker = qr.fit(docs, some)
    assert np.isfinite(ranker.weights).all()
    kept = qr.keep_good(docs, ranker)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in qr.score(docs, ranker).collect())
    assert qr.score(docs.limit(0), ranker).count() == 0


def test_the_sample_is_bounded(spark):
    docs, labels = table(spark, SF_001, "documents"), table(spark, SF_001, "labels")
    sample, counts = qr.labelled_sample(docs, labels, 10)
    assert sample.count() <= 20 and sum(counts.values()) > 100
