"""The pipeline stage by stage on the smallest tables, and odd rows through all of it."""

from collections import Counter

import numpy as np
import pytest
from conftest import SF
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as cp
from gavelstat.llm import mixing, quality_ranker, registry
from gavelstat.llm.digest_index import LOWER, UPPER
from gavelstat.llm.frames import table
from gavelstat.workspace import materialize

NORMAL = str.maketrans(UPPER, LOWER)


@pytest.fixture(scope="module")
def stages(spark):
    docs = [table(spark, SF, "documents")]
    for name, stage in cp.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF), name))
    return docs


def test_columns(stages):
    for frame in stages[1:-1]:
        assert frame.dtypes == stages[0].dtypes


def test_stages_decide_as_their_operators_do(spark, stages):
    raw, good, exact, near, mixed, coded = stages
    ranker = quality_ranker.fit(raw, table(spark, SF, "labels"))
    passed = {r.doc_id for r in quality_ranker.score(raw, ranker).filter("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == passed and good.count() == len(passed) < raw.count()
    groups = {}
    for r in good.collect():
        groups.setdefault(r.text.translate(NORMAL), []).append(r.doc_id)
    assert {r.doc_id for r in exact.collect()} == {max(ids) for ids in groups.values()}
    classes = {r.doc_id: r.class_id for r in cp.dart_minhash.classes(exact).collect()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(classes.values()))
    taken = {r.doc_id: r.taken for r in mixing.taken(mixing.plan(near)).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.encode().split())
    assert +words == +Counter(taken)
    library = Tokenizer.from_file(cp.VOCABULARY)
    rows = coded.collect()
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    texts = Counter((r.doc_id, library.decode(np.frombuffer(r.ids, "<u4").tolist(), skip_special_tokens=False)) for r in rows)
    assert texts == Counter((r.doc_id, r.text) for r in mixed.collect())


def test_run(spark, stages):
    got = Counter(map(str, cp.run(spark, SF).collect()))
    assert got == Counter(map(str, stages[-1].collect()))


@pytest.mark.parametrize("nth", range(5))
def test_odd_rows(spark, nth):
    rows = [
        (None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "good words " * 60, None, "a", 660),
        (2, "good words " * 60, "en", "a", 660), (3, "Good Words " * 60, "en", None, 1), (4, "x" * 90_000, "en", "b", 1),
    ]
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, digest int"
    docs = spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], ddl)
    name, stage = cp.STAGES[nth]
    out = stage(spark, docs, SF)
    assert out.count() <= 2 * len(rows)
    if nth < 4:
        assert out.columns == docs.columns
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names and set(registry.SQL) <= set(registry.QUERIES)
