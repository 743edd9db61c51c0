"""Targets, quotas and pieces of a mix."""

import random
from collections import Counter, defaultdict

import pytest

from gavelstat.llm import mixing


def water(sizes, weights, share=1.5, copies=2):
    """Targets by sharing what is left among those that are not full, again and again."""
    goals, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > copies * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                goals[i] = left * weights[i] / total
            return goals
        for i in over:
            goals[i] = copies * sizes[i]
            left -= goals[i]
        open_ -= over
    return goals


def test_targets():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 9)
        sizes = [rng.choice([0, rng.randint(0, 50), rng.randint(0, 10**6)]) for _ in range(n)]
        weights = [mixing.WEIGHTS[i % 3] for i in range(n)]
        got = mixing.targets(sizes, weights)
        assert got == pytest.approx(water(sizes, weights), abs=1e-3)
        assert sum(got) == pytest.approx(1.5 * sum(sizes))
    assert mixing.targets([0, 0], [3, 1]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_tree_splits_quotas_exactly_and_like_a_shuffle():
    quotas = [100, 0, 7, 1, 5000]
    dealt = mixing.split_tree(quotas, 7)
    assert dealt.sum(axis=1).tolist() == quotas and (dealt >= 0).all()
    sizes = dealt.sum(axis=0)
    assert sizes.max() - sizes.min() <= 3  # shards are even
    assert (mixing.split_tree(quotas, 7) == dealt).all()
    means = sum(mixing.split_tree([40, 60], 4, seed)[0] for seed in range(400)) / 400
    assert all(abs(m - 10) < 0.6 for m in means)
    spread = [int(mixing.split_tree([40, 60], 4, seed)[0][0]) for seed in range(400)]
    # 25 draws from 100 with 40 marked: variance 25 * .4 * .6 * 75 / 99
    assert 3 < sum((x - 10) ** 2 for x in spread) / 400 < 6


def test_permutation():
    for n in (1, 2, 12, 97, 100):
        a, b = mixing.permutation(n, "s")
        assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def corpus():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        source = rng.choice(["a", "b", "Z", "é", None, "c"])
        text = rng.choice(["", None, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 80)))])
        rows.append((i, text, source))
    rows += [(500, "x\x0by\xa0z\x1c w", "only"), (501, "word " * 900, "a"), (7, "same id", "b"), (None, "no id", "a")]
    return rows + [rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id bigint, text string, source string").selectExpr(
        "*", "length(text) AS n_chars", "1 AS size", "'x' AS key", "2 AS _source"
    )


def test_plan(docs):
    planned = mixing.plan(docs, block_words=16, shards=4).cache()
    rows = planned.collect()
    assert len(rows) == len(corpus())
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        words = sum(p.words for p in r.pieces)
        taken[r.source] += words
        target[r.source] = r.target
        assert words <= 2 * r.size
        for copy in {p.copy for p in r.pieces}:
            spans = sorted((p.from_word, p.words) for p in r.pieces if p.copy == copy)
            assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    expected = water([sizes[s] for s in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))])
    assert [target[s] for s in names] == pytest.approx(expected)
    assert all(abs(taken[s] - target[s]) < 1 for s in names)
    assert sizes["only"] == 3  # only space and tab to carriage return separate words
    per_shard = defaultdict(int)
    for p in mixing.shards(planned).collect():
        per_shard[p.shard] += p.words
    assert set(per_shard) <= set(range(4)) and max(per_shard.values()) < 1.5 * min(per_shard.values())


def test_reruns_and_partitions_agree(docs):
    order = lambda rows: sorted(map(tuple, rows), key=str)
    first = order(mixing.taken(mixing.plan(docs)).collect())
    assert first == order(mixing.taken(mixing.plan(docs.repartition(7))).collect())


def test_mixture(docs):
    rows = mixing.mixture(docs).collect()
    assert rows[0].__fields__ == docs.columns
    got = Counter()
    for r in rows:
        got[r.doc_id] += len(r.text.encode().split())
    expected = Counter()
    for r in mixing.taken(mixing.plan(docs)).collect():
        expected[r.doc_id] += r.taken
    assert +got == +expected
    whole = {(r.doc_id, r.text) for r in docs.collect()}
    cut = [r for r in rows if (r.doc_id, r.text) not in whole]
    assert len(cut) <= 6 and all(r.n_chars == len(r.text) for r in cut)


def test_empty_and_wordless_tables(spark, docs):
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mixture(docs.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id bigint, text string, source string")
    assert {(r.size, r.target, r.taken) for r in mixing.taken(mixing.plan(blank)).collect()} == {(0, 0.0, 0)}
