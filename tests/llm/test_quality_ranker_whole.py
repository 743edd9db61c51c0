"""The quality classifier learns from every labelled text that is not held out."""

import numpy as np
import pytest
from conftest import SF

from gavelstat.llm import quality_ranker as qr
from gavelstat.llm.frames import table

SF_001 = SF.replace("0.001", "0.01")


def _tables(spark):
    return [table(spark, SF_001, t) for t in ("documents", "labels")]


def _many(spark):
    """Short texts, more than 10,000 of a class."""
    rows = spark.range(30_000).selectExpr(
        "id AS doc_id", "cast(id % 2 AS int) AS quality",
        "concat(repeat(concat('Plain words ', id % 97, '. '), cast(1 + id % 7 AS int)), if(id % 3 = id % 2, '!!! 12 $', ' end')) AS text",
    )
    return rows.select("doc_id", "text"), rows.select("doc_id", "quality")


@pytest.mark.parametrize("tables", [_tables, _many])
def test_every_labelled_text_counts(spark, tables):
    """Labels of a class beyond 10,000 were left out."""
    docs, labels = tables(spark)
    known = labels.filter("quality in (0, 1)").filter(~qr.held_out(labels.doc_id)).join(docs, "doc_id").count()
    rows = qr.labelled_features(docs, labels)
    got = sorted(map(tuple, rows.collect()))
    assert len(got) == known and (tables is _tables or known > 20_000)
    assert sorted(map(tuple, qr.labelled_features(docs, labels, broadcast=0).collect())) == got
    ranker = qr.fit(docs, labels)
    scores = np.sort([np.asarray(x) @ ranker.weights for *_, x in got])
    bad = sum(q == 0 for q, *_ in got)
    assert abs(ranker.cut - (scores[bad - 1] + scores[bad]) / 2) < 1e-9


def test_weights_are_those_of_all_pairs_at_hand(spark, monkeypatch):
    docs, labels = _tables(spark)
    rows = sorted((r.q, r["at"], r.x) for r in qr.labelled_features(docs, labels).collect())
    bad, good = (np.asarray([x for q, _, x in rows if q == k]) for k in (0, 1))
    monkeypatch.setattr(qr, "BLOCK_TEXTS", 50)  # blocks and ranges of many tasks
    monkeypatch.setattr(qr, "RANGE_TEXTS", 64)
    monkeypatch.setattr(qr, "BROADCAST_TEXTS", 0)
    assert np.allclose(qr.fit(docs, labels).weights, qr.bradley_terry(good, bad), atol=1e-8)
