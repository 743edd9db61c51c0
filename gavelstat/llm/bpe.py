"""Byte-level BPE with a lexicon of frequent words.

Words are counted over the whole corpus with mergeable heavy-hitter summaries.  The most frequent ones are
encoded once and compiled, with their ids, into a minimal automaton (``lexicon``), which goes to the executors
as a file and is mapped into memory there.  A word that the lexicon lacks is merged exactly, pair by pair in
rank order.  Results do not depend on which words are in the lexicon.

Defined results: a null text is empty and has no ids; special tokens written out in a text become their ids;
texts of any length are encoded whole; repeated rows give repeated results; an empty table gives none.  Columns
other than doc_id and text are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import mmap
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelstat.llm.frames import bound_batches, map_batches, small, steps
from gavelstat.llm.lexicon import Lexicon, compile_words
from gavelstat.workspace import drop_at_exit, new_path, release

#: Words in the lexicon, and counters in a task's summary.
LEXICON_WORDS = 1 << 16
#: Encoded words that a worker remembers from step to step.
MEMO_WORDS = 1 << 17
# Fixed value: the vocabulary's own pattern of words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII alone, which the standard library splits faster.
_ASCII_PATTERN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
#: Bytes of a word from which a heap finds the next pair.
_LONG = 1024
_NO_RANK = 1 << 40
_NOTHING = np.zeros(0, np.int64)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pairs:
    """Ranks of many pairs at once: a hash table with linear probing, in flat arrays."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        """``keys`` and ``ranks`` by slot, ``merged`` (the pair's new id) by rank."""
        self.keys, self.ranks, self.merged = keys, ranks, merged
        self.bits = len(keys).bit_length() - 1

    @classmethod
    def of(cls, pairs: np.ndarray, new: np.ndarray) -> Pairs:
        """From pairs of ids in the order of their ranks."""
        size = 1 << (max(len(pairs), 1).bit_length() + 2)
        out = cls(np.full(size, -1, np.int64), np.full(size, _NO_RANK, np.int64), new.astype(np.int64))
        keys = cls._key(*pairs.T)
        for rank, (slot, key) in enumerate(zip(out._slot(keys).tolist(), keys.tolist())):
            while out.keys[slot] >= 0:
                slot = (slot + 1) % size
            out.keys[slot], out.ranks[slot] = key, rank
        return out

    @staticmethod
    def _key(a, b):
        return (a << 32) + b

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = self._key(a, b)
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.ranks[slot], _NO_RANK)
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            there = self.keys[slot[left]]
            same = there == keys[left]
            out[left[same]] = self.ranks[slot[left[same]]]
            left = left[~same & (there >= 0)]
        return out


class Merges:
    """Ids of single bytes, ranked merges of ids, and the bytes of every id; flat arrays that a file can hold."""

    def __init__(self, special: dict[str, int], single: np.ndarray, ends: np.ndarray, blob: bytes, pairs: Pairs):
        self.special, self.single, self.ends, self.blob, self.pairs = special, single, ends, blob, pairs
        self.pattern = regex.compile(PATTERN)

    @classmethod
    def of(cls, vocabulary: dict) -> Merges:
        """From the content of a vocabulary file."""
        symbols, model = byte_symbols(), vocabulary["model"]
        ids = model["vocab"]
        special = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
        token = [b""] * (1 + max([*ids.values(), *special.values()]))
        for text, i in ids.items():
            token[i] = bytes(symbols[c] for c in text)
        for text, i in special.items():
            token[i] = text.encode()
        single = np.zeros(256, np.int64)
        for c, b in symbols.items():
            single[b] = ids[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.asarray([(ids[a], ids[b]) for a, b in merges], np.int64).reshape(-1, 2)
        new = np.asarray([ids[a + b] for a, b in merges], np.int64)
        return cls(special, single, np.cumsum([len(t) for t in token]), b"".join(token), Pairs.of(pairs, new))

    def to_bytes(self) -> bytes:
        """The arrays one after the other, behind a head that tells their sizes."""
        arrays = [self.single, self.ends, self.pairs.keys, self.pairs.ranks, self.pairs.merged]
        head = json.dumps({"special": self.special, "sizes": [*map(len, arrays)], "blob": len(self.blob)}).encode()
        head += b" " * (-len(head) % 8)
        blob = self.blob + bytes(-len(self.blob) % 8)
        return len(head).to_bytes(8, "little") + head + b"".join(a.astype("<i8").tobytes() for a in arrays) + blob

    @classmethod
    def mapped(cls, path: str) -> tuple[Merges, int]:
        """From the start of a file mapped into memory; and where the rest of the file begins."""
        with open(path, "rb") as file:
            raw = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        at = 8 + int.from_bytes(raw[:8], "little")
        head = json.loads(raw[8:at])
        arrays = []
        for size in head["sizes"]:
            arrays.append(np.frombuffer(raw, "<i8", size, at))
            at += 8 * size
        blob = raw[at : at + head["blob"]]
        single, ends, *pairs = arrays
        return cls(head["special"], single, ends, blob, Pairs(*pairs)), at + len(blob) + -len(blob) % 8

    def tokens(self) -> list[bytes]:
        ends = self.ends.tolist()
        return [self.blob[a:b] for a, b in zip([0, *ends], ends)]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of every word, as little-endian 32-bit integers.

        In each round every word merges its pair of least rank, wherever that occurs in the word.
        """
        out = [b""] * len(words)
        some = []
        for i, word in enumerate(words):
            if len(word) > _LONG:
                out[i] = np.asarray(self._merge_long(self.single[np.frombuffer(word, np.uint8)]), "<u4").tobytes()
            elif word:
                some.append(i)
        ids = self.single[np.frombuffer(b"".join([words[i] for i in some]), np.uint8)]
        owner = np.repeat(np.arange(len(some)), [len(words[i]) for i in some])
        done_ids, done_owner = [], []
        while len(ids):
            inside = np.append(owner[1:] == owner[:-1], False)
            rank = np.where(inside, self.pairs.rank(ids, np.append(ids[1:], 0)), _NO_RANK)
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            open_ = least < _NO_RANK
            done_ids.append(ids[~open_])
            done_owner.append(owner[~open_])
            hit = np.flatnonzero(open_ & (rank == least))
            # of pairs that overlap, as in a run of one symbol, every second one from the left
            lead = np.concatenate(([True], np.diff(hit) > 1)) if len(hit) else hit
            hit = hit[(hit - hit[lead][np.cumsum(lead) - 1]) % 2 == 0] if len(hit) else hit
            ids[hit] = self.pairs.merged[rank[hit]]
            open_[hit + 1] = False
            ids, owner = ids[open_], owner[open_]
        ids, owner = np.concatenate([*done_ids, _NOTHING]), np.concatenate([*done_owner, _NOTHING])
        flat = ids[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owner, minlength=len(some)))).tolist()
        for i, low, high in zip(some, [0, *ends], ends):
            out[i] = flat[low:high]
        return out

    def _merge_long(self, word: np.ndarray) -> list[int]:
        """The same with a heap of pairs over a linked list, for words of any length."""
        ranks = self.pairs.rank(word[:-1], word[1:])
        ids, n = word.tolist(), len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(ranks.tolist()) if r < _NO_RANK]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.pairs.merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            ends = [left for left in (before[i], i) if left >= 0 and after[left] < n]
            a, b = np.asarray([(ids[k], ids[after[k]]) for k in ends], np.int64).reshape(-1, 2).T
            for left, r in zip(ends, self.pairs.rank(a, b).tolist()):
                if r < _NO_RANK:
                    heapq.heappush(heap, (r, left, ids[left], ids[after[left]]))
        return [i for i in ids if i >= 0]


class Encoder:
    """Texts to ids, as bytes of little-endian 32-bit integers.

    Words that a step has not seen before are looked up, or merged, all together.
    """

    def __init__(self, merges: Merges, lexicon: Lexicon | None = None):
        self.merges, self.lexicon = merges, lexicon
        special = sorted(merges.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.word: dict[str, bytes] = {}
        self.token = merges.tokens()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        if len(self.word) > MEMO_WORDS:
            self.word.clear()
        # millions of strings and no cycles: looking for those would take a fifth of the time
        collecting = gc.isenabled()
        gc.disable()
        try:
            split = [self._split(t) for t in texts]
            self._learn(list(set().union(*split) - self.word.keys()))
            word = self.word
            return [b"".join([word[w] for w in words]) for words in split]
        finally:
            if collecting:
                gc.enable()

    def _split(self, text: str) -> list[str]:
        """The pattern's words, special tokens among them."""
        find = _ASCII_PATTERN.findall if text.isascii() else self.merges.pattern.findall
        if self.special is None or not self.special.search(text):
            return find(text)
        out, end = [], 0
        for match in self.special.finditer(text):
            out += [*find(text[end : match.start()]), match[0]]
            end = match.end()
        return out + find(text[end:])

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        found = self.lexicon.get_all(raw) if self.lexicon else [None] * len(raw)
        unseen = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(unseen, self.merges.merge_all([raw[i] for i in unseen])):
            found[i] = ids
        self.word.update(zip(words, found))
        # no word of the pattern reads like a special token
        self.word.update((t, i.to_bytes(4, "little")) for t, i in self.merges.special.items())

    def decode(self, ids: bytes) -> str:
        token = self.token
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", errors="replace")


# ---- Spark ----


def count_words(docs: DataFrame, most: int = LEXICON_WORDS) -> DataFrame:
    """Frequent space-separated words of all texts: word, n.

    A task keeps Misra-Gries summaries of ``most`` / 2 counters for words after a space and fewer for others.
    Summaries add up; a count is too small by at most the words of its kind divided by the counters.
    """

    def summarise(batches):
        counts = [Counter(), Counter()]  # of words at the start of a line, and after a space
        shares = [max(most // 16, 1), max(most // 2, 1)]
        for batch in batches:
            for step in steps(batch, "text"):
                for text in step.column(0).to_pylist():
                    for line in text.split("\n") if text else ():
                        first, *rest = line.split(" ")
                        counts[0][first] += 1
                        counts[1].update(rest)
                counts = [reduced(c, n) if len(c) > 8 * n else c for c, n in zip(counts, shares)]
        for space, c, n in zip(("", " "), counts, shares):
            c = reduced(c, n)
            yield pa.RecordBatch.from_pydict({"word": [space + w for w in c], "n": list(c.values())}, schema=arrow)

    bound_batches(docs.sparkSession)
    arrow = pa.schema([("word", pa.string()), ("n", pa.int64())])
    found = docs.select("text").mapInArrow(summarise, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counted: DataFrame, most: int) -> list:
    """The most frequent words, ``most`` at most: those above a count that a histogram of counts gives.

    Only the histogram and the words themselves reach the driver, however many tasks have counted.
    """
    counted = small(counted.withColumn("cell", F.floor(16 * F.log2(F.col("n").cast("double")))), "words")
    cut, total = None, 0
    for cell, words in sorted(counted.groupBy("cell").count().collect(), reverse=True):
        total += words
        if total > most:
            break
        cut = cell
    found = [] if cut is None else counted.filter(F.col("cell") >= cut).select("word").collect()
    release(counted)
    return sorted(r["word"] for r in found)


def reduced(counts: Counter, most: int) -> Counter:
    """The summary with at most ``most`` counters: all lose as much as the first that is left out has."""
    if len(counts) <= most:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    cut = int(np.partition(values, len(values) - most - 1)[len(values) - most - 1])
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


def build(docs: DataFrame, vocabulary_path: str, most: int = LEXICON_WORDS) -> str:
    """Compile vocabulary and lexicon into one file, hand it to all executors and return its name there."""
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = json.load(file)
    merges = Merges.of(vocabulary)
    top = most_frequent(count_words(docs, most), most)
    words = list({w.encode() for text in top for w in merges.pattern.findall(text)})
    lexicon = compile_words({w: np.frombuffer(ids, "<u4") for w, ids in zip(words, merges.merge_all(words))})
    path = new_path(spark, "bpe") + ".model"
    write_file(spark, path, merges.to_bytes() + lexicon)
    drop_at_exit(spark, path)
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(content))
    out.close()


@lru_cache(maxsize=1)
def encoder_of(name: str) -> Encoder:
    """This worker's encoder from the file that ``build`` handed out."""
    path = SparkFiles.get(name)
    merges, rest = Merges.mapped(path)
    return Encoder(merges, Lexicon(path, rest))


def encode(docs: DataFrame, name: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default doc_id), n_tokens and ids (binary, little-endian unsigned 32-bit)."""
    keep = ["doc_id"] if keep is None else keep
    fields = [f"`{c}` {t}" for c, t in docs.select(*keep).dtypes]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        encoder = encoder_of(name)
        for step in steps(batch, "_bpe_text"):
            ids = encoder.encode_all([t or "" for t in step.column(len(keep)).to_pylist()])
            yield {c: step.column(i) for i, c in enumerate(keep)} | {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    rows = docs.select(*keep, F.col("text").alias("_bpe_text"))
    return map_batches(rows, run, ", ".join([*fields, "n_tokens bigint", "ids binary"]), encoder_of.cache_clear)


def decode(encoded: DataFrame, name: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        encoder = encoder_of(name)
        for step in steps(batch, "ids"):
            yield {"doc_id": step.column(0), "text": [encoder.decode(x) for x in step.column(1).to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string", encoder_of.cache_clear)


def round_trip(docs: DataFrame, vocabulary_path: str, most: int = LEXICON_WORDS) -> DataFrame:
    """Encode and decode every text in one pass: doc_id, n_tokens and digests of the ids and the decoded text."""
    name = build(docs, vocabulary_path, most)

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        encoder = encoder_of(name)
        for step in steps(batch, "text"):
            ids = encoder.encode_all([t or "" for t in step.column(1).to_pylist()])
            yield {
                "doc_id": step.column(0),
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(encoder.decode(x).encode()).hexdigest() for x in ids],
            }

    ddl = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, run, ddl, encoder_of.cache_clear)
