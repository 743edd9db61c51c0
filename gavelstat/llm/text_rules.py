"""Quality rules whose limits adapt to each language and source.

Metrics of whole texts are integers (counts, and ratios per thousand).  Their distributions go into quantile
sketches: cells of relative width below 1 %, counted per language, source and metric.  Sketches merge by adding
counts, so results do not depend on the order or the partitioning of rows.  Small sources take the limits of
their language, small languages those of all rows.  A document fails where a ratio is outside the fences
``q25 - REACH * spread`` and ``q75 + REACH * spread``, where spread is the distance of the quartiles, and at
least the metric's ``slack``.

Defined results: null and empty texts have no words and fail the base rules.  Null language and null source are
groups like any other.  Each row is judged by itself, so repeated rows get the same result.  An empty table
gives no rows.  Columns other than doc_id, text, lang and source are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstat.llm.frames import gathered, map_batches

SPACES = "\t\n\v\f\r "
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
DDL = "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in COUNTS)
#: Rows a group needs for limits of its own.
GROUP_ROWS = 200
#: Distance of the fences from the quartiles, in spreads.
REACH = 4


def repeated_words(words: list) -> int:
    """Words covered by a window of three words that is found twice or more."""
    if len(words) < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    pairs, size = ids[:-2] * len(number) + ids[1:-1], len(number)
    if size >= 1 << 20:  # the three numbers no longer fit one integer
        pairs = np.unique(pairs, return_inverse=True)[1]
    names, place, count = np.unique(pairs * size + ids[2:], return_inverse=True, return_counts=True)
    if len(names) == len(pairs):
        return 0
    starts = np.flatnonzero(count[place] > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[starts + shift] = True
    return int(covered.sum())


def text_metrics(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.encode().split()  # bytes split at the six ASCII spaces alone
    seen: set[str] = set()
    lines = repeated = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                repeated += 1
            seen.add(line)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        lines,
        repeated,
        repeated_words(words),
    )


def _measure(batch: pa.RecordBatch) -> Iterator[dict]:
    rows = [text_metrics(t.as_py()) for t in batch.column(3)]
    counts = zip(*rows) if rows else [[] for _ in COUNTS]
    yield {n: batch.column(i) for i, n in enumerate(("doc_id", "lang", "source"))} | dict(zip(COUNTS, counts))


def measure(docs: DataFrame) -> DataFrame:
    """One narrow row of counts per document."""
    return map_batches(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", "text"), _measure, DDL
    )


def _ratio(part: str, whole: str, scale: int) -> Column:
    return F.expr(f"{scale} * {part} div greatest({whole}, 1L)")


#: Name, value, and the least distance of a fence from its quartile.
RATIOS = {
    "word_length": (_ratio, ("word_chars", "n_words", 100), 200),
    "symbols": (_ratio, ("n_symbols", "word_chars", 1000), 50),
    "dup_lines": (_ratio, ("n_dup_lines", "n_lines", 1000), 500),
    "repeats": (_ratio, ("n_repeat_words", "n_words", 1000), 400),
}


def cell(value: Column) -> Column:
    """Lower edge of the sketch cell of a count: exact below 256, then eight leading binary digits."""
    width = F.greatest(F.length(F.bin(value)) - F.lit(8), F.lit(0))
    return F.call_function("shiftright", value, width).cast("bigint") * F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), width
    )


def sketches(measured: DataFrame) -> DataFrame:
    """Counted cells per language, source and metric; documents that fail the base rules have no part."""
    pairs = [F.struct(F.lit(n).alias("metric"), f(*a).alias("value")) for n, (f, a, _) in RATIOS.items()]
    return (
        measured.filter(~base_failed())
        .select("lang", "source", F.explode(F.array(*pairs)).alias("m"))
        .groupBy("lang", "source", F.col("m.metric").alias("metric"), cell(F.col("m.value")).alias("cell"))
        .agg(F.count("*").alias("n"))
    )


def quartiles(cells: DataFrame, by: list[str]) -> DataFrame:
    """Merge sketches up to ``by`` and read the quartiles: the first cell that reaches each share of the rows."""
    merged = cells.groupBy(*by, "metric", "cell").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*by, "metric")
    below = F.sum("n").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.select("*", below.alias("upto"), F.sum("n").over(group).alias("rows"))
    return ranked.groupBy(*by, "metric").agg(
        F.min(F.when(4 * F.col("upto") >= F.col("rows"), F.col("cell"))).alias("q25"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("rows"), F.col("cell"))).alias("q75"),
        F.max("rows").alias("rows"),
    )


def fences(cells: DataFrame, group_rows: int = GROUP_ROWS, reach: int = REACH) -> DataFrame:
    """Limits of every language and source that has rows: low_* and high_* of each metric."""
    levels = [["lang", "source"], ["lang"], []]
    metrics = F.explode(F.array(*map(F.lit, RATIOS))).alias("metric")
    out = cells.select("lang", "source").distinct().select("lang", "source", metrics)
    for depth, by in enumerate(levels):
        q = quartiles(cells, by)
        names = {c: f"{c}_{depth}" for c in ("q25", "q75", "rows")}
        q = q.select(*[F.col(c).alias(f"_{c}") for c in [*by, "metric"]], *[F.col(c).alias(n) for c, n in names.items()])
        same = (F.col("metric") == F.col("_metric"))
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(q, same, "left").drop(*[f"_{c}" for c in [*by, "metric"]])

    def own(c: str) -> Column:
        return F.when(F.col("rows_0") >= group_rows, F.col(f"{c}_0")).when(
            F.col("rows_1") >= group_rows, F.col(f"{c}_1")
        ).otherwise(F.col(f"{c}_2"))

    slack = F.lit(0)
    for n, (_, _, least) in RATIOS.items():
        slack = F.when(F.col("metric") == n, F.lit(least)).otherwise(slack)
    out = out.select("lang", "source", "metric", own("q25").alias("q25"), own("q75").alias("q75"), slack.alias("slack"))
    out = out.withColumn("reach", F.greatest(F.lit(reach) * (F.col("q75") - F.col("q25")), F.col("slack")))
    return out.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("metric") == n, F.col("q25") - F.col("reach"))).alias(f"low_{n}") for n in RATIOS],
        *[F.max(F.when(F.col("metric") == n, F.col("q75") + F.col("reach"))).alias(f"high_{n}") for n in RATIOS],
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, group_rows: int = GROUP_ROWS, reach: int = REACH) -> DataFrame:
    """Counts of every document, whether it fails the base rules, and whether it stays."""
    measured = gathered(measure(docs), "metrics")
    limits = fences(sketches(measured), group_rows, reach)
    limits = limits.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    inside = F.lit(True)
    for n, (f, a, _) in RATIOS.items():
        inside = inside & f(*a).between(F.col(f"low_{n}"), F.col(f"high_{n}"))
    joined = measured.join(
        limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left"
    )
    return joined.select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"),
        F.coalesce(~base_failed() & inside, F.lit(False)).alias("kept"),
    )
