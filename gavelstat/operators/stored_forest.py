"""Forests that are larger than the driver: trees as rows of a table, scored where they lie.

A tree is stored in pieces of at most PIECE_NODES nodes, by the number of their first node, with the numbers of each kind as
bytes and ``base``, by which children count on.  Rows to be scored are numbered and written once; each pair of a part of the
rows and a share of the trees is a task that keeps its rows and lets the trees pass by one at a time (``TreeUnits.java``), so
that neither all trees nor all rows are ever in one place.  Sums of the shares are added up by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from gavelstat.operators.forest import GROUP_NODES, Forest, Tree
from gavelstat.operators.jvm_jobs import job, over_partitions
from gavelstat.workspace import bound_batches, materialize

#: Nodes in a row of the table; readers hold some thousands of rows.
PIECE_NODES = 1 << 8
#: Nodes up to which a forest is kept on the driver.
DRIVER_NODES = GROUP_NODES
#: Rows that a task keeps while trees pass by, rows that go down a tree side by side, and shares of the trees.
ROWS_TOGETHER, ROWS_AT_ONCE, TREE_SHARES = 1 << 20, 1 << 3, 24
ARRAYS = ("feature", "threshold", "left", "right", "value", "cover")
KINDS = (np.int16, np.float64, np.int32, np.int32, np.float64, np.float64)
FOREST_DDL = "tree int, start int, base int, " + ", ".join(f"{c} binary" for c in ARRAYS)
#: Nodes of a piece.
NODES = "octet_length(feature) div 2"


@dataclass(frozen=True)
class StoredForest:
    """A summed forest with equal weights whose trees are rows of ``table``."""

    table: DataFrame
    count: int
    combine: str = "sum"

    @classmethod
    def joined(cls, spark: SparkSession, tables: Sequence[DataFrame], count: int) -> StoredForest:
        return cls(reduce(DataFrame.unionByName, tables), count)

    def first(self, count: int) -> StoredForest:
        """The forest of its first trees."""
        return StoredForest(self.table.filter(F.col("tree") < count), count)

    def sizes(self) -> dict[int, int]:
        """Nodes of every tree."""
        return dict(self.table.groupBy("tree").agg(F.sum(F.expr(NODES))).collect())

    def trees(self, numbers: Sequence[int]) -> list[Tree]:
        """Some trees, on the driver."""
        found = self.table.filter(F.col("tree").isin(list(numbers))).toArrow()
        pieces = sorted(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), range(found.num_rows)))
        return [_tree([_numbers([found.column(c)[i] for c in range(2, 9)]) for _, _, i in parts])
                for _, parts in groupby(pieces, key=lambda r: r[0])]

    def collected(self, nodes: int | None = None) -> Forest | None:
        """The forest on the driver, if it has few nodes."""
        if sum(self.sizes().values()) > (DRIVER_NODES if nodes is None else nodes):
            return None
        return Forest(self.trees(range(self.count)), [1.0 / self.count] * self.count)

    def groups(self, nodes: int = GROUP_NODES) -> Iterator[Forest]:
        """The forest in parts of bounded size, read one after the other."""
        held, size, sizes = [], 0, self.sizes()
        for tree in range(self.count):
            if held and size + sizes[tree] > nodes:
                yield Forest(self.trees(held), [1.0 / self.count] * len(held))
                held, size = [], 0
            held.append(tree)
            size += sizes[tree]
        yield Forest(self.trees(held), [1.0 / self.count] * len(held))

    def each_tree(self, found: Callable[[int, Tree], dict], ddl: str) -> DataFrame:
        """``found(number, tree)``, a row for each tree, worked out where the tree is read."""
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for number, pieces in groupby(_rows(batches), key=lambda r: r[0].as_py()):
                yield pa.RecordBatch.from_pylist([found(number, _tree([_numbers(r[2:]) for r in pieces]))], schema=arrow)

        arrow = _schema(ddl)
        bound_batches(self.table.sparkSession)
        return self.table.repartition(min(self.count, 96), "tree").sortWithinPartitions("tree", "start").mapInArrow(run, ddl)

    def base_value(self) -> float:
        means = self.each_tree(lambda number, tree: {"tree": number, "mean": tree.mean()}, "tree int, mean double")
        return sum(r["mean"] for r in means.orderBy("tree").collect()) / self.count

    def shares(self, p: int, gains: Callable[[Tree, int], np.ndarray]) -> np.ndarray:
        """Mean over the trees of each feature's share of the gains."""
        def found(number: int, tree: Tree) -> dict:
            gain = gains(tree, p)
            return {"tree": number, "share": (gain / gain.sum() if gain.sum() > 0 else gain).tolist()}

        rows = self.each_tree(found, "tree int, share array<double>").orderBy("tree").collect()
        total = np.sum([r["share"] for r in rows], axis=0) / self.count
        return total / total.sum() if total.sum() else total

    def predict(self, df: DataFrame, features: Sequence[str], column: str) -> DataFrame:
        """``df`` with a prediction column."""
        spark, names = df.sparkSession, [f"__x{i}" for i in range(len(features))]
        bound_batches(spark)
        numbered = materialize(df.withColumn("__id", F.monotonically_increasing_id()), "scored")
        rows = numbered.select("__id", *[F.col(c).cast("double").alias(n) for c, n in zip(features, names)])
        parts = -(-max(numbered.count(), 1) // ROWS_TOGETHER)
        shares = min(self.count, max(1, -(-TREE_SHARES // parts)))

        def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                x = np.column_stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(names))])
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids, x)], names=["ids", "x"])

        blobs = rows.mapInArrow(pack, "ids binary, x binary").withColumn("__part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
        share = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("__share")
        part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("__part")
        nothing = [F.lit(None).cast("binary").alias(c) for c in ARRAYS]
        mine = blobs.select("__part", "ids", "x", share).select(
            (F.col("__part") * shares + F.col("__share")).cast("int").alias("unit"), F.lit(-1).alias("tree"), F.lit(0).alias("start"),
            F.lit(0).alias("base"), "ids", "x", *nothing)
        trees = self.table.select("*", part).select(
            (F.col("__part") * shares + F.col("tree") % shares).cast("int").alias("unit"), "tree", "start", "base",
            F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("x"), *ARRAYS)
        units = mine.unionByName(trees).drop("cover").repartitionById(parts * shares, "unit").sortWithinPartitions("unit", "tree", "start")
        score = job(spark, "Score", width=np.int32([len(names)]), at_once=np.int32([ROWS_AT_ONCE]),
                    weight=np.float64([1.0 / self.count]))
        found = over_partitions(units, score, "__id bigint, __s double").groupBy("__id").agg(F.sum("__s").alias(column))
        return numbered.join(materialize(found, "scores"), "__id", "left").select(*[c for c in df.columns if c != column], column)


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*batch.columns)


def _numbers(row: Sequence[pa.Scalar]) -> list[np.ndarray]:
    """The arrays of a piece from its base and bytes."""
    arrays = [np.frombuffer(v.as_buffer(), k) for v, k in zip(row[1:], KINDS)]
    left, right = (np.where(v >= 0, v + np.int32(row[0].as_py()), np.int32(-1)) for v in arrays[2:4])
    return [*arrays[:2], left, right, *arrays[4:]]


def _tree(pieces: list[list[np.ndarray]]) -> Tree:
    return Tree(*[np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*pieces)])
