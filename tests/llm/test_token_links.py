"""Alignment of whole texts by both libraries, without pieces, blocks or Spark."""

import bisect
import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gavelstat.llm import token_links as tl
from gavelstat.workspace import materialize

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
ALIGNER = tl.Aligner(A_PATH, B_PATH)


def ends(tokens):
    at, out = 0, []
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def whole(text):
    """Groups as text and links of a text, from its two whole encodings."""
    if not text:
        return "", []
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    a_bytes, b_bytes = [ALIGNER.a_bytes[i] for i in a], [ALIGNER.b_bytes[i] for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
        return "", []
    ends_a, ends_b = ends(a_bytes), ends(b_bytes)
    links, groups, i, j = [], [], 0, 0
    for k, end in enumerate(ends_a):
        m = bisect.bisect_left(ends_b, end)
        if m < len(ends_b) and ends_b[m] == end:
            links.append((a[k], b[m]))
            groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : m + 1])))
            i, j = k + 1, m + 1
    return ";".join(groups), links


def brute(rows):
    found = [(d, whole(t), t) for d, t in rows]
    counts = Counter(pair for _, (_, links), _ in found for pair in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for d, (groups, links), text in found:
        n_a, n_b = (sum(len(g.split("|")[i].split(",")) for g in groups.split(";")) if groups else 0 for i in (0, 1))
        out.append((
            d, n_a, n_b, groups.count(";") + 1 if groups else 0, len(links), sum(counts[p] == best[p[1]] for p in links),
            sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(8)
    words = "the cat sat on unbelievable mats, isn't it? naïve façade 日本語 résumé 12345 3.14 <s> <|endoftext|> </s> don't 😀 x́ ſtraße".split()
    glue = [" "] * 8 + ["  ", "\n", "\t", " ", "   \n ", " ", "\x1c", "　"]
    rows = []
    for i in range(120):
        rows.append((i, "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randint(0, 40)))))
    rows += [(200, None), (201, ""), (202, " "), (203, "a▁b"), (204, "  lead"), (205, "trail "), (206, "᠎ x᠎ y")]
    rows += [(207, "x" * 3000), (208, " ".join(rng.choice(words) for _ in range(20_000))), (None, "the cat"), (None, "the mat"), rows[5]]
    return rows


@pytest.mark.parametrize("block", [tl.BLOCK_BYTES, 200])
def test_summary_equals_whole_texts(spark, block):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS block", "'x' AS docs", "2 AS n", "3 AS code")
    got = tl.summary(df.repartition(3), A_PATH, B_PATH, block).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_groups(spark):
    rows = [(1, "the cat"), (2, None), (3, "résumé")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.groups for r in tl.groups(df, A_PATH, B_PATH).collect()} == {d: whole(t)[0] for d, t in rows}


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" ab.'st1é日\n\t ▁　\x1c᠎😀́<>|")), max_size=30))
def test_pieces_equal_whole_texts(text):
    groups, links, _, _ = ALIGNER.texts([text])[0]
    want, want_links = whole(text)
    assert groups == want
    assert len(links) // 8 == len(want_links)


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(tl, "MEMO_PIECES", 2)
    for _ in range(3):
        assert [g for g, *_ in ALIGNER.texts(["the cat sat", "on the mat"])] == [whole("the cat sat")[0], whole("on the mat")[0]]


def test_empty_table(spark):
    assert tl.summary(spark.createDataFrame([], "doc_id bigint, text string"), A_PATH, B_PATH).count() == 0


def test_align():
    ends, a, b = tl.align(np.asarray([2, 1, 3]), np.asarray([1, 1, 4]))
    assert (ends.tolist(), a.tolist(), b.tolist()) == ([2, 6], [0, 2], [1, 2])


def test_pieces_asked_for_together_equal_single_ones():
    texts = ["the cat", "a\u2581b", "x  y", "naïve ˈstress", "日本 語", "z" * 600, "don't 3.14"]
    pieces = [p for t in texts for p in tl._CUT.split(t)]
    together = tl.Aligner(A_PATH, B_PATH).learn(pieces)
    for p in pieces:
        found = together[p]
        assert ("" if found is None else found[0]) == whole(p)[0]


def test_tables_of_blocks_are_written_in_small_groups(spark, monkeypatch):
    """A writer collected 100 rows of blocks, and a reader took all of a file's into its vectors."""
    stored = []
    monkeypatch.setattr(tl, "materialize", lambda *a, **b: stored.append(b) or materialize(*a, **b))
    tl.summary(spark.createDataFrame([(1, "the cat")], "doc_id bigint, text string"), A_PATH, B_PATH)
    assert stored == [{"large_rows": True}]
    rows = spark.createDataFrame([(i, random.Random(i).randbytes(1_000_000)) for i in range(40)], "id int, places binary")
    large = materialize(rows.coalesce(1), "large", **stored[0])
    (file,) = Path(large.stored_at.removeprefix("file:")).glob("*.parquet")
    groups = pq.ParquetFile(file).metadata
    assert groups.num_rows == 40 and max(groups.row_group(i).num_rows for i in range(groups.num_row_groups)) <= 16


@pytest.mark.parametrize("codes", [1, 1 << 16, (1 << 16) + 1])
def test_places_take_the_bytes_that_they_need(codes):
    links = np.concatenate([np.arange(codes), [codes - 1]]).astype("<i8")
    docs = [{"n_links": codes}, {"n_links": 1}]
    block = tl._block(0, docs, [links.tobytes()])
    assert len(block["places"][0]) == (codes + 1) * (2 if codes <= 1 << 16 else 4)
    first, second = tl._rated(docs, block["places"][0], np.arange(codes), np.ones(codes, np.int64))
    assert (first["count_sum"], second["count_sum"], second["n_best"]) == (codes * (codes - 1) // 2, codes - 1, 1)
