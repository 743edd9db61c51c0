"""Counts against plain loops, limits against sorted values."""

import random
import re
from collections import Counter

from gavelstat.llm import text_rules as tr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i, t in enumerate(zip(words, words[1:], words[2:])):
        if triples[t] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(1)
    parts = ["a", "b", "cc", "é", "#", "<|>", "\n", "\n\n", " ", "\t", "\x0b", "\r", "\xa0", "\x1c", "\x85", "word", "$$"]
    yield from (None, "", " ", "\n", "a\n a\na\n\n\n", "a b c a b c", "a a a a", "a b c d")
    for _ in range(400):
        yield "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 60)))
    yield "long " * 50_000


def test_counts():
    for text in texts():
        assert tr.text_metrics(text) == counts(text), repr(text)


def test_many_distinct_words(monkeypatch):
    words = [str(i) for i in range(3000)] * 2
    assert tr.repeated_words([w.encode() for w in words]) == 6000
    assert tr.repeated_words([str(i % 2999).encode() for i in range(3000)]) == 0


def corpus():
    rng = random.Random(2)
    make = lambda n, extra: " ".join(rng.choice(["tree", "stone", "river"]) + str(rng.randint(0, 999)) + extra for _ in range(n))
    rows = [(i, make(rng.randint(60, 200), ""), rng.choice(["en", None]), rng.choice(["a", "b", None])) for i in range(300)]
    rows += [(1000 + i, make(80, "###"), "en", "a") for i in range(6)]
    rows += [(2000 + i, make(80, ""), "fr", "rare") for i in range(3)]
    return rows + [(3000, None, None, None), (3001, "few words", "en", "a"), (3002, "same words here " * 40, "en", "b"), rows[5], (None, make(90, ""), "en", "a")]


def test_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 AS n_words", "'x' AS cell")
    got = {r.doc_id: r for r in tr.judge(docs.repartition(6), group_rows=40).collect()}
    assert tr.judge(docs, group_rows=40).count() == len(rows)
    failed = lambda n: n[0] < 50 or 100 * n[5] > 50 * n[0]
    values = {
        "word_length": lambda n: 100 * n[1] // max(n[0], 1), "symbols": lambda n: 1000 * n[2] // max(n[1], 1),
        "dup_lines": lambda n: 1000 * n[4] // max(n[3], 1), "repeats": lambda n: 1000 * n[5] // max(n[0], 1),
    }
    measured = [(d, lang, source, counts(t)) for d, t, lang, source in rows]
    good = [m for m in measured if not failed(m[3])]
    cell = lambda v: v if v < 256 else v >> (v.bit_length() - 8) << (v.bit_length() - 8)

    def limits(lang, source, metric):
        own = [m for m in good if m[1:3] == (lang, source)]
        for group in (own, [m for m in good if m[1] == lang], good):
            if len(group) >= 40 or group is good:
                break
        ranked = sorted(cell(values[metric](m[3])) for m in group)
        low, high = ranked[-(-len(ranked) // 4) - 1], ranked[-(-3 * len(ranked) // 4) - 1]
        reach = max(tr.REACH * (high - low), tr.RATIOS[metric][2])
        return low - reach, high + reach

    for d, lang, source, n in measured:
        inside = all(a <= values[m](n) <= b for m in values for a, b in [limits(lang, source, m)])
        assert got[d].base_failed == failed(n)
        assert got[d].kept == (not failed(n) and inside), d
    assert not any(got[1000 + i].kept for i in range(6)) and got[2000].kept
    assert tr.judge(docs.limit(0)).count() == 0


def test_sketches_merge(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string, lang string, source string")
    measured = tr.measure(docs).cache()
    parts = [tr.sketches(measured.filter(f"coalesce(doc_id, 0) % 3 = {k}")) for k in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang", "source", "metric", "cell").sum("n")
    assert sorted(map(str, map(tuple, merged.collect()))) == sorted(map(str, map(tuple, tr.sketches(measured).collect())))
