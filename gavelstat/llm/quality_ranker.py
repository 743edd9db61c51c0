"""A quality classifier that learns from preferences.

Every pair of a good and a bad labelled text is a preference.  In the Bradley-Terry model the log odds that one
text is preferred are the difference of two scores; with scores linear in features that is logistic regression
without intercept on feature differences.  Scores are then cut at the quantile that leaves as large a share
below as bad labels have, and mapped to 0..1 with the cut at CUT.

Features are taken from the whole text alone: shares of character classes and statistics of words and lines.
The fit uses all labelled texts that are not held out.  Each is given a place in its class by a hash, places make the
pairs, and differences are stored in blocks; a Newton step adds up the blocks' sums in their order, so that weights do not
depend on partitions.  Only these sums reach the driver.  The cut is an exact quantile.  Scoring is one pass over the texts
without a shuffle.

Defined results: null and empty texts have zero features and a score like any other.  Labels without quality,
or for documents that are not there, are ignored; repeated labels count each time.  Without labels of both
classes every score is 0.5.  A null doc_id is scored and, as it has no text form, counts as held out.  Columns
with other names are ignored by ``score`` and carried along by ``keep_good``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstat.functions.codes import BROADCAST_LABELS
from gavelstat.functions.order_stats import select_ranks
from gavelstat.llm.frames import bound_batches, map_batches, steps
from gavelstat.llm.text_rules import SPACES, repeated_words
from gavelstat.workspace import materialize, release

#: Texts of a range of hashes within which one task ranks them.
RANGE_TEXTS = 65_536
#: Texts of the larger class whose differences form a block, and the most blocks.
BLOCK_TEXTS, MOST_BLOCKS = 8_192, 1_024
#: Texts of a class up to which they are broadcast to those of the other.
BROADCAST_TEXTS = 20_000
#: Preferences in which each text of the larger class takes part.
PAIRS_EACH = 4
#: Penalty on squared weights, per pair.
PENALTY = 1e-3
#: Score that the quantile becomes.
CUT = 0.3

_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = ["upper", "lower", "digit", "space", "line", "other letter", "other sign", "control"]
_TABLE_SIZE = 1 << 16


def _class_of(code: int) -> int:
    """Number of a character's class: the ASCII signs one by one, then _CLASSES."""
    c = chr(code)
    if c in _SIGNS:
        return _SIGNS.index(c)
    kind = unicodedata.category(c)
    name = (
        "line" if c == "\n" else "space" if c in SPACES or kind == "Zs" else "upper" if kind == "Lu"
        else "lower" if kind == "Ll" else "digit" if kind[0] == "N" else "other letter" if kind[0] in "LM"
        else "control" if kind[0] == "C" else "other sign"
    )
    return len(_SIGNS) + _CLASSES.index(name)


_CLASS: list[np.ndarray] = []
N_FEATURES = len(_SIGNS) + len(_CLASSES) + 8


def features(text: str | None) -> np.ndarray:
    """Numbers of moderate size; zero for an empty text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    if not _CLASS:
        _CLASS.append(np.asarray([_class_of(i) for i in range(_TABLE_SIZE)], np.uint8))
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(_CLASS[0][np.minimum(codes, _TABLE_SIZE - 1)], minlength=len(_SIGNS) + len(_CLASSES))
    out[: len(counts)] = np.sqrt(counts / len(codes))
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    if words:
        n, distinct = len(words), len(set(words))
        lengths = np.fromiter(map(len, words), np.int64, n)
        out[len(counts) :] = (
            np.log1p(n) / 10,
            np.log1p(len(codes)) / 10,
            lengths.mean() / 10,
            np.log1p(lengths.max()) / 5,
            1 - distinct / n,
            repeated_words(words) / n,
            1 - len(set(lines)) / max(len(lines), 1),
            np.log1p(n / max(len(lines), 1)) / 5,
        )
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass(frozen=True)
class Ranker:
    weights: np.ndarray
    cut: float
    slope: float

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        raw = np.asarray([features(t) @ self.weights for t in texts]) if texts else np.zeros(0)
        odds = (raw - self.cut) * self.slope + np.log(CUT / (1 - CUT)) if self.slope else np.zeros(len(raw))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def _known(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").alias("_label_id"), F.col("quality").cast("int").alias("_quality"))
    known = known.filter(F.col("_quality").isin(0, 1) & ~held_out(F.col("_label_id")))
    return known.withColumn("_order", F.xxhash64("_label_id", F.lit("quality")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """Text and quality of at most ``most`` labelled documents of each class, to look at, and the numbers of all labels."""
    known = _known(labels)
    counts = {r["_quality"]: r["count"] for r in known.groupBy("_quality").count().collect()}
    picks = [
        known.filter(F.col("_quality") == q).orderBy("_order", "_label_id").limit(most) for q in (0, 1)
    ]
    ids = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * most rows of three numbers
    return _texts(docs).join(ids, F.col("_doc_id") == F.col("_label_id")), counts


def labelled_features(docs: DataFrame, labels: DataFrame, broadcast: int = BROADCAST_LABELS) -> DataFrame:
    """q, at (a hash of the document) and x (features) of every labelled document that is not held out; stored.

    Few labels, by count, are sent to the texts.  Else features are taken from all texts and shuffled in their place.
    """
    known = _known(labels)
    texts = _texts(docs).filter(~held_out(F.col("_doc_id")))

    def measured(rows: DataFrame, keep: list[str], ddl: str) -> DataFrame:
        def measure(batch: pa.RecordBatch) -> Iterator[dict]:
            for step in steps(batch, "_text"):
                found = [features(t.as_py()) for t in step.column(0)]
                yield {name: step.column(i) for i, name in enumerate(keep, start=1)} | {"x": found}

        return map_batches(rows.select("_text", *keep), measure, ddl + ", x array<double>")

    same = F.col("_doc_id") == F.col("_label_id")
    if known.limit(broadcast + 1).count() <= broadcast:
        rows = measured(texts.join(F.broadcast(known), same), ["_quality", "_order"], "_quality int, _order bigint")
    else:
        kind = dict(texts.dtypes)["_doc_id"]
        rows = measured(texts, ["_doc_id"], f"_doc_id {kind}").join(known, same)
    return materialize(rows.select(F.col("_quality").alias("q"), F.col("_order").alias("at"), "x"), "labelled")


def fit(docs: DataFrame, labels: DataFrame) -> Ranker:
    rows = labelled_features(docs, labels)
    counts = {r["q"]: r["count"] for r in rows.groupBy("q").count().collect()}
    bad, good = (counts.get(q, 0) for q in (0, 1))
    if not bad or not good:
        release(rows)
        return Ranker(np.zeros(N_FEATURES), 0.0, 0.0)
    blocks = materialize(difference_blocks(rows, good, bad), "preferences")
    weights = _newton(N_FEATURES, PAIRS_EACH * max(good, bad), lambda w: _added(blocks, w))
    found = _cut(weights, rows, good, bad)
    release(rows, blocks)
    return found


def _placed(rows: DataFrame, n: int) -> DataFrame:
    """Adds ``place``, 0 and on in each class, in the order of hashes; texts that are alike may swap places."""
    ranges = -(-n // RANGE_TEXTS)
    number = F.floor((F.col("at").cast("double") / 2.0**64 + 0.5) * ranges).cast("int")
    ranged = rows.withColumn("range", F.least(number, F.lit(ranges - 1)))
    offsets, upto = [], {0: 0, 1: 0}
    for r in sorted(ranged.groupBy("q", "range").count().collect()):  # some 65,000 times fewer than texts
        offsets.append((r["q"], r["range"], upto[r["q"]]))
        upto[r["q"]] += r["count"]
    shift = rows.sparkSession.createDataFrame(offsets, "q int, range int, shift bigint")
    within = F.row_number().over(Window.partitionBy("q", "range").orderBy("at", "x"))
    ranked = ranged.withColumn("within", within).join(F.broadcast(shift), ["q", "range"])
    return ranked.select("q", "x", (F.col("within") - 1 + F.col("shift")).alias("place"))


def _partner(base, shift, bad: int):
    """The place of a bad text that a preference is made with; ``base`` counts through the larger class."""
    return (base * 7919 + shift * 104729) % bad


def difference_blocks(rows: DataFrame, good: int, bad: int) -> DataFrame:
    """block and d: the differences of all preferences, in the order of their texts' places."""
    n = max(good, bad)
    blocks = min(MOST_BLOCKS, -(-n // BLOCK_TEXTS))
    placed = materialize(_placed(rows, n), "placed")
    sides = {}
    for q, size in ((0, bad), (1, good)):
        side = placed.filter(F.col("q") == q).select(F.col("place").alias(f"place_{q}"), F.col("x").alias(f"x_{q}"))
        sides[q] = F.broadcast(side) if size <= BROADCAST_TEXTS else side
    base = rows.sparkSession.range(n).select(F.col("id").alias("base"), (F.col("id") % good).alias("place_1")).join(sides[1], "place_1")
    pairs = base.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(PAIRS_EACH - 1))))
    pairs = pairs.withColumn("place_0", _partner(F.col("base"), F.col("shift").cast("bigint"), bad)).join(sides[0], "place_0")
    difference = F.zip_with("x_1", "x_0", lambda a, b: a - b)
    block = F.floor(F.col("base") * blocks / n).cast("int")
    dealt = pairs.select(block.alias("block"), "base", "shift", difference.alias("d"))
    dealt = dealt.repartition("block").sortWithinPartitions("block", "base", "shift").select("block", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            d = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(numbers), -1)
            ends = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for low, high in zip(ends[:-1], ends[1:]):
                if low == high:
                    continue
                if last is not None and numbers[low] != last:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([last], pa.int32()), "d": [np.concatenate(held).tobytes()]})
                    held = []
                last = int(numbers[low])
                held.append(d[low:high].copy())
        if held:
            yield pa.RecordBatch.from_pydict({"block": pa.array([last], pa.int32()), "d": [np.concatenate(held).tobytes()]})

    bound_batches(rows.sparkSession)
    return dealt.mapInArrow(run, "block int, d binary")


def _sums(differences: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the logistic loss."""
    p = 1 / (1 + np.exp(np.clip(differences @ weights, -60, 60)))  # of the preference being the other way
    return differences.T @ p, (differences * (p * (1 - p))[:, None]).T @ differences


def _added(blocks: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_sums`` over all blocks, one after the other."""
    size = len(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                gradient, curvature = _sums(np.frombuffer(d).reshape(-1, size), weights)
                both = np.concatenate([gradient, curvature.ravel()])
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "s": [both.tobytes()]})

    rows = sorted((r["block"], r["s"]) for r in blocks.mapInArrow(run, "block int, s binary").collect())
    total = np.zeros(size + size * size)
    for _, s in rows:
        total += np.frombuffer(s)
    return total[:size], total[size:].reshape(size, size)


def bradley_terry(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Weights from the features of texts that are at hand."""
    n = max(len(good), len(bad))
    base = np.arange(n)
    differences = np.concatenate([good[base % len(good)] - bad[_partner(base, shift, len(bad))] for shift in range(PAIRS_EACH)])
    return _newton(differences.shape[1], len(differences), lambda w: _sums(differences, w))


def _newton(size: int, pairs: int, sums: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weights by Newton steps on the penalised logistic loss of feature differences."""
    weights = np.zeros(size)
    ridge = PENALTY * pairs
    for _ in range(25):
        gradient, curvature = sums(weights)
        step = np.linalg.solve(curvature + ridge * np.eye(size), gradient - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _cut(weights: np.ndarray, rows: DataFrame, good: int, bad: int) -> Ranker:
    """Cut at the quantile of all labelled scores below which lies the share that bad labels have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            yield pa.RecordBatch.from_pydict({"q": batch.column(0), "x": pa.array((x * weights).sum(axis=1))})

    scores = materialize(rows.select("q", "x").mapInArrow(run, "q int, x double"), "scores")
    each = scores.withColumn("series", F.explode(F.when(F.col("q") == 1, F.array(F.lit("all"), F.lit("good"))).otherwise(F.array(F.lit("all")))))
    last = min(bad - 1, good + bad - 2)
    middle = [(good - 1) // 2, good // 2]
    _, found = select_ranks(each.select("series", "x"), lambda series, _: [last, last + 1] if series == "all" else middle)
    release(scores)
    cut = (found["all"][last][0] + found["all"][last + 1][0]) / 2
    spread = sum(found["good"][m][0] for m in middle) / 2 - cut
    return Ranker(weights, cut, 4.0 / spread if spread > 0 else 1.0)


def score(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for step in steps(batch, "text"):
            found = ranker(step.column(2).to_pylist())
            yield {
                "doc_id": step.column(0), "held_out": step.column(1), "score": found,
                "predicted": (found >= CUT).astype(np.int32),
            }

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, run, "doc_id bigint, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, ranker: Ranker) -> DataFrame:
    """The rows, all columns, that the classifier does not reject."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for step in steps(batch, "text"):
                yield step.filter(pa.array(ranker(step.column(at).to_pylist()) >= CUT))

    return docs.mapInArrow(run, docs.schema)
