"""Phrases against a search word by word, notices against planted changes."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gavelstat.llm import license_scan as ls

UPPER = str.maketrans(ls._UPPER, ls._LOWER)


def brute(doc_id, text):
    words = re.findall(ls.WORD, (text or "").translate(UPPER))
    found = [
        (i, label) for phrase, label in ls.PHRASES.items() for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return doc_id, len(words), len(found), min(starts, default=None), max(starts, default=None), labels


def test_hash_is_that_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("gnu"), F.lit("é"), F.lit(""))).first()
    assert row[0] == ls.run_hash(("gnu", "é", ""))


def test_phrases_equal_brute_force(spark):
    rng = random.Random(4)
    parts = ["gnu", "GENERAL", "public", "license", "apache", "MIT", "cc", "by", "x", "É", "é", "the", "K", "ſ", "K"]
    rows = [(i, rng.choice([" ", "-", "\n", ", ", ".  "]).join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \t.,"), (403, "cc"), (404, "cc by " * 50_000), (405, "mit license " + "a " * 200_000 + "apache license")]
    rows += [(None, "MIT License"), (None, "gnu general public license"), (None, "MIT License"), (7, "other text"), rows[3]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "1 AS doc", "'x' AS found", "2 AS template", "3 AS place", "4 AS words", "5 AS copies"
    )
    got = ls.scan(df.repartition(4)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute(*r) for r in rows), key=str)


def labels(spark, text):
    row = ls.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    return row["labels"], row["score"]


@pytest.mark.parametrize("label,notice", ls.NOTICES)
def test_notices(spark, label, notice):
    around = "some words before it " + notice + " and some more behind"
    found, score = labels(spark, around.upper())
    assert label in found.split(",") and score == 1.0


def test_changed_notices(spark):
    notice = dict(ls.NOTICES)["mit"].split()
    runs = len(ls.words_of(" ".join(notice))) - ls.RUN + 1
    inserted = notice[:20] + ["really", "and", "truly"] + notice[20:]  # two neighbouring diagonals
    found, score = labels(spark, " ".join(inserted))
    assert found == "mit" and score == (runs - 4) / runs
    missing = notice[:30] + notice[33:]
    assert labels(spark, " ".join(missing))[0] == "mit"
    half = notice[: len(notice) // 2]
    found, score = labels(spark, " ".join(half))
    assert found == "" and 0.3 < score < 0.6
    apart = notice[:25] + ["word"] * 60 + notice[25:]  # both halves, but no one span
    assert labels(spark, " ".join(apart))[0] == ""


def test_limits_and_empty_table(spark):
    with pytest.raises(ValueError):
        ls.templates({}, [("long", "word " * 80)])
    with pytest.raises(ValueError):
        ls.templates({"single": "x"}, [])
    assert ls.scan(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = ls.scan(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.replace("spark.createDataFrame", ""))
