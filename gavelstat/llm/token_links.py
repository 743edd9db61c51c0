"""Which tokens of two tokenizers end together, and how often two ids do so in the whole corpus.

Both tokenizers cut at a single space between two other characters, so a text is aligned piece by piece and pieces
are remembered.  Unseen pieces are encoded and aligned together: a dictionary per tokenizer leads from the byte at
which a token ends to its place; the ends that both have, sorted, cut both id lists into groups, and each group gives
its links.  No token is empty, so of a group only the last tokens end together.

1. A task aligns blocks of texts.  A stored row is a block: its documents, its distinct links with their numbers, and
   for every link of a document its place among those.
2. Numbers of links are added up over blocks, not documents, so that even the most frequent link is shuffled once per
   block only.  The highest number per B id is one more aggregation.
3. Corpus numbers come back to their block and from there to the documents.  Nothing is collected or broadcast.

Defined results: texts that are null, empty or not restored by both tokenizers have no tokens.  Texts of any length
are aligned whole; pieces bound the work, but text without spaces is one piece.  Repeated rows give repeated results
and count repeatedly.  An empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gavelstat.llm.bpe import PATTERN, byte_symbols
from gavelstat.llm.frames import bound_batches, map_batches, schema_of, steps
from gavelstat.workspace import materialize

#: Text bytes of a block; a task of the JVM holds several rows of blocks at once, in arrays that are larger than they.
BLOCK_BYTES = 1 << 20
#: Pieces that a worker remembers in each of two generations, and the longest one worth it.
MEMO_PIECES, MEMO_LENGTH = 1 << 15, 64
#: A link as one integer: the A id, then the B id.
B_BITS = 20
#: White space in either library.
_GAP = r"\s\u180e"
#: A space that no token of either kind holds but as its first character.
_CUT = re.compile(rf"(?<=[^{_GAP}]) (?=[^{_GAP}])")
#: Pieces that may stand side by side in one text: no gap at their ends, letters of settled kinds, no long words.
_PLAIN = re.compile(rf"(?![{_GAP}])[\x00-\u024f]{{1,500}}(?<![{_GAP}])")
_WORD_START = "\u2581"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Pieces that one call of a tokenizer gets.
_CALL = 4096
#: Groups as text, links (their A and B ids), and the numbers of A's and B's tokens; None: not restored.
Aligned = tuple[str, bytes, int, int] | None


def align(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ends that both token lists have, and the places of the tokens that end there."""
    a_ends, b_ends = ({end: i for i, end in enumerate(np.cumsum(sizes).tolist())} for sizes in (a_sizes, b_sizes))
    common = sorted(a_ends.keys() & b_ends.keys())
    return (np.asarray(common, np.int64), *(np.fromiter(map(ends.__getitem__, common), np.int64, len(common))
                                            for ends in (a_ends, b_ends)))


class Aligner:
    """Two tokenizers and the pieces that they have been asked about."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(a_path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        symbols, model = byte_symbols(), vocabulary["model"]
        ranks = {bytes(symbols[c] for c in t): i for t, i in model["vocab"].items() if set(t) <= symbols.keys()}
        special = {t["content"].encode(): t["id"] for t in vocabulary["added_tokens"]}
        ranks = {t: i for t, i in ranks.items() if i not in set(special.values())}
        # where ids are in the order of merges, as in this vocabulary, a faster library encodes the same
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ordered = [model["vocab"][a + b] for a, b in merges] == list(range(256, 256 + len(merges)))
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, i in [*special.items(), *ranks.items()]:
            self.a_bytes[i] = token
        self.b_bytes = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        if b"" in self.a_bytes or b"" in self.b_bytes:
            raise ValueError("a vocabulary has a token without bytes")
        self.a_size, self.b_size = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.young: dict[str, Aligned] = {}
        self.old: dict[str, Aligned] = {}

    def learn(self, pieces: list[str]) -> dict[str, Aligned]:
        """Alignments of different pieces; those asked for lately are remembered."""
        if len(self.young) > MEMO_PIECES:
            self.old, self.young = self.young, {}
        known, young, old = {}, self.young, self.old
        new = []
        for piece in pieces:
            if piece in young:
                known[piece] = young[piece]
            elif piece in old:
                known[piece] = young[piece] = old[piece]
            else:
                new.append(piece)
        plain = [p for p in new if self.fast and _PLAIN.fullmatch(p)]
        others = list(set(new).difference(plain)) if len(plain) < len(new) else []
        for some, encode in ((plain, self._side_by_side), (others, self._one_by_one)):
            for low in range(0, len(some), _CALL):
                part = some[low : low + _CALL]
                found = dict(zip(part, self._aligned(part, encode(part), self.b.encode(part, num_threads=1))))
                known |= found
                young |= {p: v for p, v in found.items() if len(p) <= MEMO_LENGTH}
        return known

    def _side_by_side(self, pieces: list[str]) -> list[int]:
        return self.fast.encode_ordinary(" " + " ".join(pieces))

    def _one_by_one(self, pieces: list[str]) -> list[int]:
        return [i for e in self.a.encode_batch_fast([" " + p for p in pieces], add_special_tokens=False) for i in e.ids]

    def _aligned(self, pieces: list[str], a: list[int], b: list[list[int]]) -> list[Aligned]:
        """Alignments of pieces whose A ids stand one after the other."""
        raw = [b" " + p.encode() for p in pieces]
        flat = [i for ids in b for i in ids]
        a_bytes, b_bytes = (list(map(t.__getitem__, ids)) for t, ids in ((self.a_bytes, a), (self.b_bytes, flat)))
        whole = b"".join(raw)
        if b"".join(a_bytes) != whole:
            return [x for p in pieces for x in self._aligned([p], self._one_by_one([p]), self.b.encode([p]))] if len(pieces) > 1 else [None]
        if b"".join(b_bytes) != whole:
            good = [b"".join(map(self.b_bytes.__getitem__, ids)) == r for ids, r in zip(b, raw)]
            kept = [p for p, ok in zip(pieces, good) if ok]
            found = iter(self._aligned(kept, self._one_by_one(kept), [ids for ids, ok in zip(b, good) if ok]) if kept else [])
            return [next(found) if ok else None for ok in good]
        a_ids, b_ids = np.asarray(a, np.int64), np.asarray(flat, np.int64)
        ends, last_a, last_b = align(self.a_size[a_ids], self.b_size[b_ids])
        bounds = np.searchsorted(ends, np.cumsum([len(r) for r in raw]), side="right")
        x, y = (list(map(self.names.__getitem__, ids)) for ids in (a, flat))
        groups, i, j = [], 0, 0
        for k, m in zip(last_a.tolist(), last_b.tolist()):
            if k == i and m == j:
                groups.append(x[i] + "|" + y[j])
            else:
                groups.append(",".join(x[i : k + 1]) + "|" + ",".join(y[j : m + 1]))
            i, j = k + 1, m + 1
        pairs = ((a_ids[last_a] << B_BITS) + b_ids[last_b]).astype("<i8").tobytes()
        n_a, n_b = (np.diff(last[bounds - 1] + 1, prepend=0).tolist() for last in (last_a, last_b))
        out, low = [], 0
        for high, p, q in zip(bounds.tolist(), n_a, n_b):
            out.append((";".join(groups[low:high]), pairs[8 * low : 8 * high], p, q))
            low = high
        return out

    def texts(self, texts: list[str | None]) -> list[tuple[str, bytes, int, int]]:
        """Groups, links and numbers of tokens of every text."""
        split = [_CUT.split(t) if t else [] for t in texts]
        known = self.learn(list({p for pieces in split for p in pieces}))
        out = []
        for pieces in split:
            parts = [known[p] for p in pieces]
            if not parts or None in parts:
                out.append(("", b"", 0, 0))
                continue
            groups, pairs, n_a, n_b = zip(*parts)
            out.append((";".join(groups), b"".join(pairs), sum(n_a), sum(n_b)))
        return out


def _piece_bytes(piece: str) -> bytes:
    byte = _BYTE.fullmatch(piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace(_WORD_START, " ").encode()


@lru_cache(maxsize=1)
def aligner_of(a_name: str, b_name: str) -> Aligner:
    return Aligner(SparkFiles.get(a_name), SparkFiles.get(b_name))


# ---- Spark ----

_DOC = "doc_id:bigint,n_a:bigint,n_b:bigint,n_groups:bigint,n_links:bigint,groups_sha256:string"
BLOCK_DDL = f"block bigint, docs array<struct<{_DOC}>>, codes array<bigint>, numbers array<int>, places binary"


def _block(number: int, docs: list[dict], found: list[bytes]) -> dict:
    codes, places, numbers = np.unique(np.frombuffer(b"".join(found), "<i8"), return_inverse=True, return_counts=True)
    return {"block": [number], "docs": [docs], "codes": [codes], "numbers": [numbers],
            "places": [places.astype(_place_kind(len(codes))).tobytes()]}


def _place_kind(codes: int) -> str:
    """Two bytes for a place where they are enough."""
    return "<u2" if codes <= 1 << 16 else "<u4"


def blocks(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Aligned documents, a row per block.  Block numbers are those of the task, so the table is to be stored."""
    context = docs.sparkSession.sparkContext
    for path in (a_path, b_path):
        context.addFile(path)
    names = [os.path.basename(path) for path in (a_path, b_path)]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        aligner = aligner_of(*names)
        for part in steps(batch, "text", block_bytes):
            rows, found = [], []
            for step in steps(part, "text"):
                for doc, (groups, pairs, n_a, n_b) in zip(step.column(0).to_pylist(), aligner.texts(step.column(1).to_pylist())):
                    sha, n = hashlib.sha256(groups.encode()).hexdigest() if groups else "", len(pairs) // 8
                    rows.append({"doc_id": doc, "n_a": n_a, "n_b": n_b, "n_groups": n, "n_links": n, "groups_sha256": sha})
                    found.append(pairs)
            task = TaskContext.get()
            made = vars(task).setdefault("made_blocks", 0)
            task.made_blocks = made + 1
            yield _block((task.partitionId() << 32) + made, rows, found)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, run, BLOCK_DDL, aligner_of.cache_clear)


def pair_counts(stored: DataFrame) -> DataFrame:
    """code, n and best (whether no A id is linked to the B id more often) over all blocks."""
    each = stored.select(F.inline(F.arrays_zip("codes", "numbers")))
    counted = each.groupBy(F.col("codes").alias("code")).agg(F.sum("numbers").alias("n"))
    b = F.pmod("code", F.lit(1 << B_BITS))
    return counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy(b)))


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id and ``groups``, as a1,a2|b1;a3|b2,b3 with decimal ids of A before those of B."""
    context = docs.sparkSession.sparkContext
    for path in (a_path, b_path):
        context.addFile(path)
    names = [os.path.basename(path) for path in (a_path, b_path)]

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for step in steps(batch, "text"):
            found = aligner_of(*names).texts(step.column(1).to_pylist())
            yield {"doc_id": step.column(0), "groups": [g for g, *_ in found]}

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id bigint, groups string", aligner_of.cache_clear)


def summary(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Sizes of every document's alignment, and how its links stand in the whole corpus."""
    stored = materialize(blocks(docs, a_path, b_path, block_bytes), "links", large_rows=True)
    known = stored.select("block", F.explode("codes").alias("code")).join(pair_counts(stored), "code")
    own = stored.select("block", "docs", "places")
    # the numbers of a block's links, in the order of their codes, then its documents
    stream = known.unionByName(own, allowMissingColumns=True).repartition("block").sortWithinPartitions(
        "block", F.col("code").asc_nulls_last()
    )
    ddl = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    arrow = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            code, n, best, docs, places = batch.columns
            low = 0
            for at in np.flatnonzero(code.is_null().to_numpy(zero_copy_only=False)).tolist():
                held.append(_numbers(n[low:at], best[low:at]))
                n_all, best_all = (np.concatenate(v) for v in zip(*held))
                yield pa.RecordBatch.from_pylist(_rated(docs[at].as_py(), places[at].as_py(), n_all, best_all), schema=arrow)
                held, low = [], at + 1
            held.append(_numbers(n[low:], best[low:]))

    bound_batches(docs.sparkSession)
    return stream.select("code", "n", "best", "docs", "places").mapInArrow(run, schema_of(ddl))


def _numbers(n: pa.Array, best: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return n.to_numpy(zero_copy_only=False).astype(np.int64), best.to_numpy(zero_copy_only=False).astype(np.int64)


def _rated(docs: list[dict], places: bytes, n: np.ndarray, best: np.ndarray) -> list[dict]:
    """Documents of a block with the corpus numbers of their links; ``places`` tells each link's place in ``n``."""
    at = np.frombuffer(places, _place_kind(len(n)))
    ends = np.cumsum([0, *[d["n_links"] for d in docs]])
    sums = [np.diff(np.concatenate(([0], np.cumsum(v[at])))[ends]).tolist() for v in (n, best)]
    return [d | {"n_best": b, "count_sum": c} for d, c, b in zip(docs, *sums)]
