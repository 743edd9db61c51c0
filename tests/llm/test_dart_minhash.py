"""Near duplicates against all pairs; signatures against weighted Jaccard similarity."""

import random
from collections import Counter

import numpy as np
import pytest

from gavelstat.llm import dart_minhash as dm
from gavelstat.llm.components import components
from gavelstat.llm.darts import signatures


def bag(text):
    words = (text or "").encode().split()
    n = min(dm.SHINGLE, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def jaccard(a, b):
    low = sum((a & b).values())
    return low / sum((a | b).values()) if low else 0.0


def brute(rows):
    texts = sorted({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(bags[i], bags[j]) >= dm.SIMILARITY - 1e-12:
                parent[root(i)] = root(j)
    groups = {}
    for doc_id, t in rows:
        groups.setdefault(root(texts.index(t or "")), []).append((doc_id is not None, doc_id or 0))
    out = []
    for members in groups.values():
        known, least = min(members)
        out += [(d if k else None, least if known else None, len(members)) for k, d in members]
    return sorted(out, key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [(i, " ".join(make(rng.randint(0, 60)))) for i in range(60)]
    base = make(150)
    for i in range(70):  # a chain of edits: some are alike, some are not
        copy = list(base)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = f"edit{rng.randint(0, 10**6)}"
        rows.append((100 + i, " ".join(copy)))
    rows += [(200, " ".join(base)), (201, "  ".join(base)), (202, " ".join(base)), (202, " ".join(base)), (203, None), (204, "")]
    rows += [(205, " \n"), (206, "one two"), (207, "one two"), (208, "a b c d"), (209, "a b c d e"), (None, " ".join(base) + " end")]
    rows += [(210, "same " * 300), (211, "same " * 290), (212, "same " * 100)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [512, 8])
def test_classes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(dm, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS node", "'x' AS label", "2 AS doc")
    got = dm.classes(docs.repartition(4)).collect()
    assert sorted(((r.doc_id, r.class_id, r.class_size) for r in got), key=str) == brute(rows)
    kept = Counter(r.class_id for r in got if r.kept)
    assert all(n == 1 for n in kept.values()) and set(kept) == {r.class_id for r in got}
    rest = dm.keep_first(docs)
    assert rest.columns == docs.columns
    assert Counter(r.doc_id for r in rest.collect()) == kept


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert dm.classes(docs).count() == 0 and dm.keep_first(docs).count() == 0


def test_coordinates_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(0)
    n, size, agreed, expected = 300, 64, 0.0, 0.0
    for _ in range(n):
        names = rng.integers(1, 2**63, 40, dtype=np.uint64)
        a, b = rng.exponential(3, 40) + 0.01, rng.exponential(3, 40) + 0.01
        keep = rng.random(40) < 0.8
        s = signatures(
            np.concatenate([np.zeros(40, int), np.ones(keep.sum(), int)]), np.concatenate([names, names[keep]]),
            np.concatenate([a, b[keep]]), 2, size,
        )
        b = np.where(keep, b, 0)
        agreed += (s[0] == s[1]).mean()
        expected += np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(agreed - expected) / n < 4 * (0.5 / np.sqrt(n * size))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    links += [(rng.randint(300, 340), rng.randint(300, 340)) for _ in range(25)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
