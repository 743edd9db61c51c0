"""The encoder against the installed tokenizers library, and the lexicon automaton against a dictionary."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gavelstat.llm import bpe
from gavelstat.llm.lexicon import Lexicon, compile_words

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Merges.of(json.load(file))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def texts():
    rng = random.Random(5)
    parts = [
        " ", "  ", "   ", "\n", "\n\n", "\n\n\n", "\t", "\r\n", "\xa0", "　", "\x1c", "\x85", "a", "the", "The", "'s", "'ll", "don't",
        "12", "3.14", "été", "ß", "漢字", "🙂", "é", "!!", "...", "<|endoftext|>", "<|endof", "word", "x" * 60,
        "abcdefgh" * 20, "\\", "​", "½", "Ⅷ", "ا", "٣",
    ]
    yield from ("", " ", "  ", "\n", " \n", "\n ", "a ", "a  ", " a", "  a", "a\n\n", "a \nb", "a\n b", "a  b", "a\n\nb")
    for _ in range(1500):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
    for code in range(128):
        yield f"a{chr(code)}b {chr(code)}{chr(code)}1 {chr(code)}"
    yield "a" * 5000 + " " * 700 + "".join(rng.choice("abcdefghij") for _ in range(3000))


def test_ids_and_text_equal_the_library(merges, library, tmp_path):
    some = [w.encode() for w in (" the", "The", "the", " word", "word", " été")]
    words = {w: numbers(ids) for w, ids in zip(some, merges.merge_all(some))}
    path = tmp_path / "lexicon"
    path.write_bytes(compile_words(words))
    encoder = bpe.Encoder(merges, Lexicon(str(path)))
    for text, ids in zip(texts(), encoder.encode_all(list(texts()))):
        expected = library.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert np.frombuffer(ids, "<u4").tolist() == expected, repr(text)
        assert encoder.decode(ids) == library.decode(expected, skip_special_tokens=False), repr(text)


def test_model_files_read_back(merges, tmp_path):
    path = tmp_path / "model"
    path.write_bytes(merges.to_bytes() + compile_words({b"a": [7], b" the": [1, 2]}))
    read, rest = bpe.Merges.mapped(str(path))
    assert read.tokens() == merges.tokens() and read.special == merges.special
    words = [b"hello", b" world", b"\xf0\x9f\x99\x82", b"x" * 3000]
    assert read.merge_all(words) == merges.merge_all(words)
    assert [numbers(i) for i in Lexicon(str(path), rest).get_all([b"a", b" the"])] == [[7], [1, 2]]


def test_lexicon_is_exact_and_shares_suffixes(tmp_path):
    rng = random.Random(3)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 7))): [i, i + 1] for i in range(400)}
    words |= {b"": [7], b"walking": [1], b"talking": [2]}
    path = tmp_path / "words"
    path.write_bytes(b"head" + compile_words(words))
    lexicon = Lexicon(str(path), 4)
    assert [numbers(i) for i in lexicon.get_all(list(words))] == list(words.values())
    assert lexicon.numbers(sorted(words)).tolist() == list(range(len(words)))
    unknown = [w for w in (b"walk", b"walkings", b"x", b"abcabcabc") if w not in words]
    assert lexicon.get_all(unknown) == [None] * len(unknown)
    path.write_bytes(compile_words({w + b"ing": [1] for w in (b"walk", b"talk", b"jump")}))
    # three stems of four letters and one shared ending
    assert len(Lexicon(str(path)).parts["finals"]) <= 3 * 4 + 3


def test_long_words_merge_alike(merges, monkeypatch):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeth ") for _ in range(rng.randint(1, 90))).encode() for _ in range(200)]
    words += [b"a" * n for n in range(1, 40)] + [b""]
    expected = merges.merge_all(words)
    monkeypatch.setattr(bpe, "_LONG", 0)
    assert merges.merge_all(words) == expected


def test_summary_keeps_heavy_words():
    counts = bpe.Counter({"a": 50, "b": 40, **{f"w{i}": 1 for i in range(100)}})
    kept = bpe.reduced(counts, 10)
    assert len(kept) <= 10 and {"a", "b"} <= set(kept)
    assert kept["a"] >= 50 - sum(counts.values()) // 10


def test_the_lexicon_is_of_frequent_words(spark):
    rows = [("a",)] * 0 + [(f"{'often ' * 50}rare{i} seldom seldom",) for i in range(30)]
    docs = spark.createDataFrame(rows, "text string")
    found = bpe.most_frequent(bpe.count_words(docs, 100), 4)
    assert " often" in found and len(found) <= 4 and not any("rare" in w for w in found)
    assert bpe.most_frequent(bpe.count_words(docs.limit(0), 100), 4) == []


def test_round_trip_of_a_table(spark, library):
    rows = [(1, "the cat  sat\n"), (2, None), (3, ""), (4, "the cat  sat\n"), (None, "x" * 50_000 + " the"), (5, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS ids", "'x' AS n_tokens")
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH, 5).collect())
    expected = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        expected.append((doc_id or 0, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(expected)
    name = bpe.build(docs, PATH, 5)
    coded = bpe.encode(docs, name)
    assert {r.text for r in bpe.decode(coded, name).collect()} == {t or "" for _, t in rows}
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
