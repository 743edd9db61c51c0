"""Small helpers that several operators share: Arrow batches in and out of Python, reading the test tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from gavelstat.workspace import materialize

#: Stands for a null doc_id, before all others.
LEAST = -(1 << 63)
#: Text bytes that one step of a Python task works on; a longer text forms a step of its own.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch, where the session does not say otherwise; texts vary too much for a limit in rows.
BATCH_BYTES = 8 << 20
BATCH_SETTING, BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fewer(df: DataFrame, share: int = 4) -> DataFrame:
    """The same rows in a ``share`` of the usual number of partitions, for fewer and larger files."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // share
    return df.coalesce(max(parts, 1))


def small(df: DataFrame, label: str) -> DataFrame:
    """Store a table of ids, far smaller than the texts it stands for, in few files."""
    return materialize(fewer(df, 8), label)


def gathered(df: DataFrame, label: str) -> DataFrame:
    """``small`` for a table that each task makes from texts: its rows are dealt out before they are written."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8
    return materialize(df.repartition(max(parts, 1)), label)


def keyed_texts(docs: DataFrame) -> DataFrame:
    """doc (the order of documents), mark (tells texts of one doc_id apart) and the text, never null.

    The mark is a 64-bit hash of the text where a doc_id has several, and 0, which takes no room, elsewhere.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST)).alias("doc"), text.alias("text"))
    hashed = rows.select("doc", F.xxhash64("text").alias("h"))
    several = hashed.groupBy("doc").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high")
    several = small(several.select("doc", F.lit(True).alias("several")), "several")
    mark = F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0))
    return rows.join(several, "doc", "left").select("doc", mark.alias("mark"), "text")


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def bound_batches(spark: SparkSession) -> None:
    """Have batches for Python limited by bytes, unless the session has a limit of its own."""
    if spark.conf.get(BATCH_SETTING) == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def map_batches(
    df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], ddl: str, done: Callable[[], None] | None = None
) -> DataFrame:
    """Run ``function`` over record batches; it yields dicts of columns, which may have any length.

    ``done`` is called at the end of a task: workers live on, and should not keep what only this job needs.
    """
    bound_batches(df.sparkSession)
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches):
        try:
            for batch in batches:
                for columns in function(batch):
                    yield pa.RecordBatch.from_arrays(
                        [_array(columns[f.name], f.type) for f in arrow], schema=arrow
                    )
        finally:
            if done:
                done()

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values.cast(kind) if values.type != kind else values
    return pa.array(values, type=kind)


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, so that memory does not follow the batch size."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)
