"""Repairs against a search over all role sequences, without tables, stacks or layers."""

import hashlib
import random
import re
import zlib

import pytest

from gavelstat.llm import conversation_repair as cr
from gavelstat.llm.glr import Repair, Table

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if kind == 4:
            role = "user"
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """Least (cost, audit) and the repaired turns, by growing all edits of all prefixes in the order of rows.

    ``rows``: (role, text, must_go, truncated).  States of the role order: start, s, u, a.
    """
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    alive = {"": (0, "", ())}

    def better(found, state, value):
        if state not in found or value[:2] < found[state][:2]:
            found[state] = value

    def inserted(alive):
        alive = dict(alive)
        for _ in range(4):
            for state, (cost, audit, turns) in list(alive.items()):
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in follows[state]:
                        better(alive, r, (cost + 5, audit + "I", turns + ((name, ""),)))
        return alive

    for role, text, must_go, truncated in rows:
        new = {}
        for state, (cost, audit, turns) in inserted(alive).items():
            better(new, state, (cost + 2, audit + "D", turns))
            if must_go:
                continue
            extra = 5 * truncated
            if role[:1] and role[:1] in follows[state]:
                better(new, role[0], (cost + extra, audit + "K", turns + ((role, text),)))
            for r, name in (("u", "user"), ("a", "assistant")):
                if r in follows[state]:
                    better(new, r, (cost + extra + 1, audit + "R", turns + ((name, text),)))
        alive = new
    done = [v for state, v in inserted(alive).items() if state in ("", "a")]
    return min(done, key=lambda v: v[:2])


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        order = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=order)
        seen, marked = set(), []
        blank = duplicate = truncated = 0
        for _, _, role, text in mine:
            bare = text.rstrip(SPACE)
            is_blank, again = not bare, (role, text) in seen
            cut = not is_blank and not again and bare[-1] not in ".!?"
            seen.add((role, text))
            blank, duplicate, truncated = blank + is_blank, duplicate + (again and not is_blank), truncated + cut
            marked.append((role, text, is_blank or again, cut))
        roles = [r[2][:1] for r in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        turns = {r[1] for r in mine} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit, kept = cheapest(marked)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, gaps, blank, duplicate, truncated, illegal, cost, audit, sha))
    return sorted(out, key=str)


def corpus(n, seed, most=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "And then", "  ", "", "What?\n", "ok", None, "é.", "Yes. "]
    roles = ["user"] * 5 + ["assistant"] * 5 + ["system", "tool", "", None]
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randint(0 if conv else 1, most)):
            rows.append((conv, rng.choice([*range(12), None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}."))
    return rows + rows[:5]


@pytest.mark.parametrize("parts", [1, 7])
def test_summary_equals_search(spark, parts):
    rows = corpus(120, 3)
    schema = "conv_id bigint, turn bigint, role string, text string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS conv", "'x' AS digest", "2 AS n", "0 AS kind").repartition(parts)
    got = cr.summary(cr.damaged(df), df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_a_conversation_over_many_tasks(spark):
    """A conversation longer than a task's share, cut into stretches anywhere."""
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["a.", "b", f"c{t}."])) for t in range(3000)]
    rows += [(c, 0, "user", "Hi.") for c in range(40)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = {r[0]: r for r in brute([r for r in rows if r[0] != 7] + [r for r in rows if r[0] == 7])}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r["conv_id"]: tuple(r) for r in cr.summary(cr.damaged(df), df).collect()}
        small = cr.light(cr._plain(cr.damaged(df)))
        assert cr.stretches(small).filter("conv = 7").count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Yes?"), (1, 2, "tool", "Fine."), (2, 0, "assistant", "x" * 300_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = cr.repaired(df).orderBy("conv_id", "place").collect()
    # D (2) and then K, R (1): cheaper than any insert
    assert [(r.conv_id, r.place, r.role, r.edit) for r in got] == [(1, 0, "user", "K"), (1, 1, "assistant", "A")]
    assert got[1].text == "Fine."


def test_empty_and_lost(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cr.summary(cr.damaged(none), none).count() == 0
    lost = next(t for t in range(500) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(3, lost, "user", "Hi.")], "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in cr.summary(cr.damaged(df), df).collect()] == [
        (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ]


def test_table_of_another_grammar():
    """Any grammar that repeats on its left: here a bracketed pair, with an optional mark."""
    table = Table((("s", ("s", "pair")), ("s", ("pair",)), ("pair", ("(", "x", ")")), ("pair", ("(", ")"))))
    assert table.follow["pair"] == {"(", "$"} and sum(table.accepts) == 1
    repair = Repair((("s", ("s", "pair")), ("s", ("pair",)), ("pair", ("b", "x", "e")), ("pair", ("b", "e"))), "be")
    tokens = [(t, False, False) for t in "bxebxbe"]
    # the second pair has no end: renaming its x to e costs least
    assert repair.finish(repair.paths(tokens, repair.start)) == (1, "KKKKEKK")


def test_split_paths_equal_whole_ones():
    repair, rng = cr.repairer(), random.Random(2)
    rows = [(rng.choice("sua-"), rng.random() < 0.1, rng.random() < 0.1) for _ in range(60)]
    whole = repair.finish(repair.paths(rows, repair.start))
    first = repair.paths(rows[:23], repair.start)
    joined = [
        (cell, c + d, s + t) for enter, c, s in first for cell, d, t in repair.paths(rows[23:], enter)
    ]
    assert repair.finish(joined) == whole
