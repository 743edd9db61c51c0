"""Template language, escaping and conversations."""

import hashlib
import random
import tracemalloc

import pytest

from gavelstat.llm import chat
from gavelstat.llm.template import Const, Out, TemplateError, compile_template, render


def text(source, filters=None, **env):
    return "".join(t for t, _ in compile_template(source, filters).pieces(**env))


def test_language():
    rows = [{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]
    source = "{% for r in rows %}{{ loop.index }}{% if loop.first %}<{% elif r.a == 2 and not loop.first %}={% else %}?{% endif %}{{ r.b }}{% if loop.last %}.{% endif %}{% endfor %}"
    assert text(source, rows=rows) == "1<x2=y."
    assert text("{{ 'a' ~ 1 ~ (x or 'z') }}{{ x | up }}", {"up": str.upper}, x="q") == "a1qQ"
    assert text("{{ 'it\\'s' }}{% for r in rows %}{% endfor %}", rows=[]) == "it's"


def test_constants_fold():
    tree = compile_template("a{{ 'b' ~ 2 }}{% if 1 == 2 %}x{% else %}{{ 'c' | up }}{% endif %}d", {"up": str.upper}).tree
    assert tree == (Out(Const("ab2Cd")),)
    assert compile_template(chat.TEMPLATE, {"escape": chat.escape}).tree[0].body[0] == Out(Const("<s>"))


@pytest.mark.parametrize(
    "source", ["{% for x in %}{% endfor %}", "{% if x %}", "{{ x() }}", "{{ }}", "{% macro x %}", "{{ x | nope }}", "{{ a b }}", "{% endfor %}", "{{ x['a'] }}"]
)
def test_errors(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_sandbox():
    for source in ("{{ x.__class__ }}", "{{ y }}", "{{ x.upper }}"):
        with pytest.raises(TemplateError):
            text(source, x="text")


def test_marks():
    done, spans = render(compile_template("a{% generation %}bc{% endgeneration %}d{% generation %}{{ x }}{% endgeneration %}"), x="é")
    assert (done, [done[a:b] for a, b in spans]) == ("abcdé", ["bc", "é"])


def test_escape_is_reversible_and_breaks_control_strings():
    rng = random.Random(1)
    parts = [*chat.CONTROL, "\\", "\\\\", "[", "<", "]", ">", "/", "INST", "s", "|", "text", " ", "é", "\n", "[\\INST]"]
    for _ in range(3000):
        raw = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        done = chat.escape(raw)
        assert chat.unescape(done) == raw
        assert not any(c in done for c in chat.CONTROL)


def test_conversations(spark):
    rng = random.Random(2)
    parts = ["</s>", "[INST] ", " [/INST]", "ok", "\\", "\n", "", "<|text|>", "é🙂", "<s>assistant"]
    rows = [
        (c, t, rng.choice(["user", "assistant", "system", "", "</s>", None]), rng.choice([None, "".join(rng.choices(parts, k=4))]))
        for c in (None, 0, 1, 2, 3) for t in range(rng.randint(1, 9))
    ]
    rows += [(7, 0, "user", "a"), (7, 0, "assistant", "b"), (7, 0, "assistant", "b"), (7, None, "user", "first"), (8, 0, "assistant", "x" * 200_000)]
    expected = {}
    for c, t, role, said in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns, loss = expected.setdefault(c, ([], []))
        turns.append(f"{role or ''}\n{said or ''}\n")
        if role == "assistant":
            loss.append(said or "")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS formatted", "2 AS n_turns")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(frame).collect()}
    assert got == {c: (len(t), sha("".join(t)), len("".join(x)), sha("".join(x))) for c, (t, x) in expected.items()}
    whole = {r.conv_id: r for r in chat.formatted(frame).collect()}
    assert [f"{r}\n{t}\n" for r, t in chat.read_back(whole[7].formatted)] == expected[7][0]
    assert chat.unescape("".join(whole[7].formatted[s.start : s.end] for s in whole[7].loss_spans)) == "bb"
    assert chat.digests(frame.limit(0)).count() == 0


def test_a_template_may_leave_turns_out(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "c")], "conv_id bigint, turn bigint, role string, text string")
    got = chat.conversations(frame, lambda c, t, s: {"conv_id": c, "text": t}, "conv_id bigint, text string", "fixed").collect()
    assert sorted(map(tuple, got)) == [(1, "fixed"), (2, "fixed")]


def test_digests_hold_one_turn_at_a_time():
    def messages(n):
        return ({"role": "assistant" if i % 2 else "user", "text": f"{i}</s>\n" + "[INST]\\é" * 2000} for i in range(n))

    template = compile_template(chat.TEMPLATE, {"escape": chat.escape})
    whole, spans = render(template, messages=messages(40))
    turns, loss = chat.read_back(whole), chat.unescape("".join(whole[a:b] for a, b in spans))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert chat._digests(5, template.pieces(messages=messages(40))) == {
        "conv_id": 5, "n_turns": 40, "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(loss),
        "loss_sha256": sha(loss), "formatted_chars": len(whole),
    }
    tracemalloc.start()
    found = chat._digests(None, template.pieces(messages=messages(1000)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["formatted_chars"] > 20_000_000 and peak < 2_000_000
    with pytest.raises(ValueError):
        chat._digests(None, iter([("<s>user<|text|>cut", False)]))


def test_one_large_conversation_streams_through_a_task(spark):
    ids = spark.range(20_000).selectExpr(
        "CAST(NULL AS BIGINT) AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat('ab ', 300) AS text"
    )
    (row,) = chat.digests(ids).collect()
    assert (row.n_turns, row.loss_chars) == (20_000, 10_000 * 900)
    assert row.loss_sha256 == hashlib.sha256(("ab " * 300 * 10_000).encode()).hexdigest()
