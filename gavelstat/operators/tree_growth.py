"""Forests and boosted trees over binned rows, grown by Spark for any number of rows.

Rows are binned once, at cuts halfway between the values of a feature, or at exact quantiles of it where there are too
many.  A node with more rows than UNIT_ROWS is split by an aggregation: each task counts the cells of all open nodes of
all trees, Spark adds the cells up, and each node's cut is chosen from its own.  A node with fewer rows is a unit: its
rows are packed into blobs, dealt to one task and its whole subtree grown there (``tree_cells``).  Both choose cuts from
the same cells in the same way.  Rounds of boosting whose rows fit a unit run inside one; candidates of a search are
units beside each other.  Beyond that every round is grown by aggregations.

On the driver are the cuts of features, the splits of nodes above UNIT_ROWS rows, boosted trees, and forests of few nodes;
larger forests stay a table (``stored_forest``).
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from gavelstat.functions.columns import row_hash
from gavelstat.functions.order_stats import melt_numbers, select_ranks
from gavelstat.operators import tree_cells as C
from gavelstat.operators.forest import Forest, Tree
from gavelstat.operators.jvm_jobs import job, over_partitions
from gavelstat.operators.stored_forest import ARRAYS, FOREST_DDL, KINDS, NODES, PIECE_NODES, StoredForest
from gavelstat.workspace import materialize, release, shared_dir

#: Rows of a node from which it is split by an aggregation; below, one task grows what is under it.
UNIT_ROWS = 1 << 20
#: The same for boosting, where one task would do all rounds.
BOOST_ROWS = 1 << 19
#: Trees that share a unit while their roots are units.
TREES_TOGETHER = 4
#: Rows, counted once per tree, of small trees that are grown side by side, and tasks that chunks of groups are dealt to.
GROWN_TOGETHER, GROUP_TASKS = 1 << 16, 192
#: Trees whose upper parts are grown together.
TOPS_TOGETHER = 32
#: Nodes whose cells are counted in one pass, and cells.
SLOTS_TOGETHER, CELLS_TOGETHER = 512, 1 << 22
#: Rounds after which the rows' scores are written to the shared folder.
ROUND_CUT = 25
#: Rows of a block that passes go over, and partitions of blocks for each core.
BLOCK_ROWS, PARTS_PER_CORE = 1 << 16, 1
#: Partitions up to which the driver adds up what they have counted by itself.
FEW_TASKS = 16
#: Values of a feature up to which each is a bin.
MOST_VALUES = 4096
ROW_DDL = "h bigint, y double, x binary"
TREE_DDL = (
    "unit int, tree int, feature array<smallint>, cut array<int>, lower array<int>, upper array<int>, value array<double>, "
    "cover array<double>"
)
PIECE_DDL = "unit int, tree int, start int, " + ", ".join(f"{c} binary" for c in ARRAYS)


# ---- bins ----


@dataclass(frozen=True)
class Bins:
    """``cuts`` between the bins of every feature, and what each bin stands for."""

    features: list[str]
    cuts: list[np.ndarray]
    values: np.ndarray

    @property
    def widths(self) -> list[int]:
        return [len(c) + 1 for c in self.cuts]

    def of(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows (by row) as a row per feature."""
        return np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(self.cuts)]).astype(np.uint16)

    def tree(self, feature, cut, left, right, value, cover) -> Tree:
        threshold = np.zeros(len(feature))
        for f, cuts in enumerate(self.cuts):
            mine = feature == f
            threshold[mine] = cuts[cut[mine]]
        return Tree(feature, threshold, left, right, value, cover)


def bins_of_values(features: Sequence[str], x: np.ndarray) -> Bins:
    """One bin per value that a column of ``x`` has."""
    distinct = [np.unique(c[~np.isnan(c)]) for c in x.T]
    return _one_per_value(list(features), {f: v if len(v) else np.zeros(1) for f, v in zip(features, distinct)}, {})


def _one_per_value(features: list[str], distinct: dict[str, np.ndarray], quantile: dict[str, np.ndarray]) -> Bins:
    """Cuts halfway between neighbours of ``distinct`` values; those of ``quantile`` are cuts themselves."""
    cuts = {f: v[:-1] for f, v in quantile.items()}
    for f, v in distinct.items():
        middle = (v[:-1] + v[1:]) / 2
        cuts[f] = np.where(middle >= v[1:], v[:-1], middle)
    values = distinct | quantile
    wide = max(len(v) for v in values.values())
    table = np.stack([np.pad(values[f], (0, wide - len(values[f])), mode="edge") for f in features])
    return Bins(features, [cuts[f] for f in features], table)


def find_bins(df: DataFrame, features: Sequence[str], most: int = MOST_VALUES) -> Bins:
    """One bin per value, or ``most`` bins of about equal size for a feature with more values than that."""
    features = list(features)
    long = materialize(melt_numbers(df, features).groupBy("series", "x").agg(F.count("*").alias("n")), "values")
    sizes = {r["series"]: r["d"] for r in long.groupBy("series").agg(F.count("*").alias("d")).collect()}
    few = [f for f in features if sizes.get(f, 0) <= most]
    found: dict[str, list[float]] = {f: [] for f in features}
    for r in long.filter(F.col("series").isin(few)).select("series", "x").collect():
        found[r["series"]].append(r["x"])
    release(long)
    many = [f for f in features if f not in few]
    distinct = {f: np.unique(np.asarray(found[f] or [0.0], float)) for f in few}
    quantile = {}
    if many:
        _, picked = select_ranks(melt_numbers(df, many), lambda _, n: [n * i // most for i in range(1, most)] + [n - 1])
        quantile = {f: np.unique([value for value, _, _ in picked[f].values()]) for f in many}
    return _one_per_value(features, distinct, quantile)


def binned(df: DataFrame, bins: Bins, target: str, key: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """h (a hash of the row), y and x (bins, 16 bits each) of every row, and the columns ``keep``; stored."""
    names = bins.features
    if key is None:
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in [*names, target]])
    rows = df.select(row_hash(key, 0).alias("h"), F.col(target).cast("double").alias("y"),
                     *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)], *keep)
    kinds = dict(df.dtypes)
    ddl = ", ".join([ROW_DDL, *[f"`{c}` {kinds[c]}" for c in keep]])
    arrow = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"f{i}").to_numpy(zero_copy_only=False) for i in range(len(names))])
            raw = np.ascontiguousarray(bins.of(x).T)
            packed = pa.array([r.tobytes() for r in raw], pa.binary())
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), packed, *kept], schema=arrow)

    return materialize(rows.mapInArrow(run, ddl), "binned")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h, y and x (a row per feature) of a batch whose first columns are those."""
    x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(batch), -1).T
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.ascontiguousarray(x)


# ---- units ----


def pack(rows: DataFrame, assign: Callable | None = None) -> DataFrame:
    """Rows as blobs (unit, h, y, x), a blob for each unit and batch.

    ``assign(h, x)`` yields (unit, indices of its rows); without it all rows are one unit, 0.
    """
    arrow = pa.schema([("unit", pa.int32()), ("h", pa.binary()), ("y", pa.binary()), ("x", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, y, x = _arrays(batch)
            found = [(0, slice(None))] if assign is None else list(assign(h, x))
            columns = zip(*[(u, h[i].tobytes(), y[i].tobytes(), np.ascontiguousarray(x[:, i].T).tobytes()) for u, i in found])
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow)]
            if arrays:
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return rows.select("h", "y", "x").mapInArrow(run, "unit int, h binary, y binary, x binary")


def in_units(blobs: DataFrame, train: Callable, ddl: str, units: int) -> DataFrame:
    """``train(unit, h, y, x)`` on the rows of every unit, in the order of their hashes; it yields dicts."""
    schema = _parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for unit, parts in groupby(rows, key=lambda r: r[0]):
            _, h, y, x = zip(*parts)
            h, y = (np.frombuffer(b"".join(v), kind) for v, kind in ((h, np.int64), (y, float)))
            x = np.frombuffer(b"".join(x), np.uint16).reshape(len(h), -1)
            order = np.lexsort((y, h))
            for out in train(unit, h[order], y[order], np.ascontiguousarray(x[order].T)):
                yield pa.RecordBatch.from_pylist([out], schema=arrow)

    return blobs.repartitionById(units, "unit").sortWithinPartitions("unit").mapInArrow(run, schema)


def _every_unit(blobs: DataFrame, units: int) -> DataFrame:
    """All rows in each of ``units`` units."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit")
    return blobs.select(numbers, "h", "y", "x")


def _tree_row(unit: int, tree: int, nodes: C.Nodes) -> dict:
    names = ("feature", "cut", "lower", "upper", "value", "cover")
    return {"unit": unit, "tree": tree} | dict(zip(names, nodes.arrays()))


def _collected(found: DataFrame) -> list[tuple[int, int, tuple[np.ndarray, ...]]]:
    """(unit, tree, node arrays) of finished trees."""
    table = found.toArrow()
    kinds = (np.int16, np.int32, np.int32, np.int32, float, float)
    columns = [table.column(i) for i in range(2, 8)]
    out = []
    for row, (unit, tree) in enumerate(zip(*(table.column(i).to_pylist() for i in (0, 1)))):
        out.append((unit, tree, tuple(c[row].values.to_numpy().astype(k) for c, k in zip(columns, kinds))))
    return out


# ---- splitting large nodes by aggregation ----


@dataclass
class _Top:
    """The upper part of a tree: nodes split by aggregations, and those still open."""

    tree: int
    nodes: C.Nodes = field(default_factory=C.Nodes)
    keys: list = field(default_factory=list)
    rows: list = field(default_factory=list)
    depth: list = field(default_factory=list)
    cut: dict = field(default_factory=dict)  # node: its best cut, where known

    def add(self, key, depth: int, rows: float = 0.0, weight: float = 0.0, total: float = 0.0) -> int:
        value = total / weight if weight else 0.0
        for part, v in zip(vars(self.nodes).values(), (-1, 0, -1, -1, value, weight)):
            part.append(v)
        self.keys.append(key)
        self.rows.append(rows)
        self.depth.append(depth)
        return len(self.keys) - 1

    def split(self, node: int) -> tuple[int, int]:
        """Children of a node by its known cut."""
        if self.nodes.left[node] < 0:
            feature, cut, _, left, whole = self.cut[node]
            sides = C.child_keys(np.asarray([self.keys[node]], np.uint64))
            self.nodes.feature[node], self.nodes.cut[node] = feature, cut
            ends = [self.add(k[0], self.depth[node] + 1, *s) for k, s in zip(sides, (left, whole - left))]
            self.nodes.left[node], self.nodes.right[node] = ends
        return self.nodes.left[node], self.nodes.right[node]


def blocks_of(rows: DataFrame, centre: float, extra: float | None = None) -> RDD:
    """Rows as kept blocks (h, y - centre, x, a column of ``extra`` or None) of about BLOCK_ROWS rows, in PARTS_PER_CORE partitions a core.

    The number of partitions does not grow with the rows, and with it what a pass sends to be added up.
    """
    context = rows.sparkSession.sparkContext
    tasks = PARTS_PER_CORE * context.defaultParallelism
    blobs = pack(rows).select("h", "y", "x").rdd.map(tuple).repartition(tasks)

    def merge(parts):
        def block(held):
            h, y, x = zip(*held)
            h, y = np.frombuffer(b"".join(h), np.int64), np.frombuffer(b"".join(y), float) - centre
            x = np.ascontiguousarray(np.frombuffer(b"".join(x), np.uint16).reshape(len(h), -1).T)
            return h, y, x, None if extra is None else np.full(len(h), extra)

        held, count = [], 0
        for part in parts:
            held.append(part)
            count += len(part[0]) // 8
            if count >= BLOCK_ROWS:
                yield block(held)
                held, count = [], 0
        if held:
            yield block(held)

    return blobs.mapPartitions(merge).persist(StorageLevel.MEMORY_AND_DISK)


def _cut_of(key, cells: np.ndarray, squares: float, mine: np.ndarray, offsets: np.ndarray, values, rules: C.Rules) -> tuple:
    """Feature, cut, gain, what is on the left, all rows, weight and sum, and the error per weight of one node."""
    used = np.flatnonzero(cells[0])
    feature = np.searchsorted(offsets, used, side="right") - 1
    whole = cells[:, : offsets[1]].sum(axis=1)
    at, k = np.searchsorted(mine, feature), len(mine)
    here = np.flatnonzero(mine[np.minimum(at, k - 1)] == feature)
    key = np.asarray([key], np.uint64)
    drawn = (C.uniform(key, np.arange(k)), values[mine]) if rules.random_cuts else None
    gain, cut, left = C.cuts_of_cells(at[here], (used - offsets[feature])[here], cells[:, used[here]], k, rules, drawn)
    best = C.chosen(C.feature_order(key, k, rules), gain[None], cut[None], left[None], rules)
    error = squares / whole[1] - (whole[2] / whole[1]) ** 2
    return int(mine[best.feature[0]]), int(best.bin[0]), float(best.gain[0]), best.left[0], whole, float(error)


def count_cells(blocks: RDD, tops: Sequence[_Top], slots: list[tuple[int, int]], widths: list[int], view: Callable) -> RDD:
    """(slot, (cells, squares)) of the open nodes ``slots`` (number of the top, node), added up over all tasks."""
    offsets = np.concatenate(([0], np.cumsum(widths)))
    slot_of: dict[int, np.ndarray] = {}
    for i, (t, node) in enumerate(slots):
        slot_of.setdefault(t, np.full(len(tops[t].keys), -1))[node] = i
    seen = [(tops[t].tree, C.Nodes(*tops[t].nodes.arrays()), s) for t, s in slot_of.items()]
    count, size = len(slots), int(offsets[-1])

    def run(parts):
        n, s, q = np.zeros((count, size)), np.zeros((count, size)), np.zeros(count)
        w = None
        for h, y, x, extra in parts:
            for tree, nodes, slot_of_node in seen:
                target, weight = view(tree, h, y, x, extra)
                slot = slot_of_node[C.leaves_of(nodes, x)]
                inside = np.flatnonzero(slot >= 0 if weight is None else (slot >= 0) & (weight > 0))
                if not len(inside):
                    continue
                here, t = slot[inside], target[inside]
                if weight is not None:
                    weight = weight[inside]
                    w = np.zeros((count, size)) if w is None else w
                wt = t if weight is None else weight * t
                q += np.bincount(here, wt * t, count)
                low, high = int(here.min()), int(here.max()) + 1
                for f, (begin, end) in enumerate(zip(offsets[:-1], offsets[1:])):
                    width = end - begin
                    key, shape = (here - low) * width + x[f].take(inside), (high - low, width)
                    n[low:high, begin:end] += np.bincount(key, minlength=shape[0] * width).reshape(shape)
                    s[low:high, begin:end] += np.bincount(key, wt, shape[0] * width).reshape(shape)
                    if weight is not None:
                        w[low:high, begin:end] += np.bincount(key, weight, shape[0] * width).reshape(shape)
        for i in range(count):
            used = np.flatnonzero(n[i]).astype(np.int32)
            if len(used):
                yield i, [(used, n[i, used], None if w is None else w[i, used], s[i, used], q[i])]

    return blocks.mapPartitions(run).reduceByKey(lambda a, b: [_added([*a, *b], size)], min(count, blocks.getNumPartitions()))


def _added(parts: list[tuple], size: int) -> tuple:
    n, w, s = (np.zeros(size) for _ in range(3))
    weighted = any(p[2] is not None for p in parts)
    for used, pn, pw, ps, _ in parts:
        n[used] += pn
        s[used] += ps
        w[used] += pn if pw is None else pw
    used = np.flatnonzero(n).astype(np.int32)
    return used, n[used], w[used] if weighted else None, s[used], sum(p[4] for p in parts)


def _search(blocks, tops, slots, bins, view, rules, allowed) -> None:
    """Find the cuts of the nodes ``slots``, as many in a pass as a task holds cells of."""
    offsets = np.concatenate(([0], np.cumsum(bins.widths)))
    values = bins.values if rules.random_cuts else None
    everything = np.arange(len(bins.cuts))
    step = max(1, min(SLOTS_TOGETHER, CELLS_TOGETHER // int(offsets[-1])))
    for low in range(0, len(slots), step):
        part = slots[low : low + step]
        nodes = [(tops[t].keys[n], everything if allowed is None else allowed[tops[t].tree]) for t, n in part]

        def choose(counted):
            slot, ((used, n, w, s, squares),) = counted
            cells = np.zeros((3, int(offsets[-1])))
            cells[:, used] = n, n if w is None else w, s
            return slot, _cut_of(nodes[slot][0], cells, squares, nodes[slot][1], offsets, values, rules)

        if isinstance(blocks, KeptBlocks):
            found = map(choose, blocks.count_cells(tops, part, bins.widths, view))
        else:
            found = count_cells(blocks, tops, part, bins.widths, view).map(choose).collect()
        for slot, (feature, cut, gain, left, whole, error) in found:
            top, node = tops[part[slot][0]], part[slot][1]
            if node == 0:
                top.rows[0], top.nodes.cover[0], top.nodes.value[0] = whole[0], whole[1], whole[2] / whole[1]
                top.error = max(error, 0.0)
            pure = error <= C.PURE * top.error
            top.cut[node] = (feature, cut, -np.inf if pure else gain, left, whole)


def grow_tops(blocks: RDD, trees: Sequence[int], bins: Bins, rules: C.Rules, seed: int, view: Callable,
              stop_rows: int = 0, allowed: dict[int, np.ndarray] | None = None) -> list[_Top]:
    """Trees grown level by level, all together, down to nodes of at most ``stop_rows`` rows."""
    tops = [_Top(t) for t in trees]
    for top in tops:
        top.add(C.tree_key(seed, top.tree), 0)
    open_ = [(i, 0) for i in range(len(tops))]
    while open_:
        _search(blocks, tops, open_, bins, view, rules, allowed)
        new = []
        for i, node in open_:
            top = tops[i]
            if node not in top.cut or not np.isfinite(top.cut[node][2]) or not rules.may_split(np.asarray(top.rows[node])):
                continue
            if rules.depth is None or top.depth[node] < rules.depth:
                new += [(i, child) for child in top.split(node)]
        open_ = [(i, n) for i, n in new if tops[i].rows[n] > stop_rows and rules.may_split(np.asarray(tops[i].rows[n]))
                 and (rules.depth is None or tops[i].depth[n] < rules.depth)]
    return tops


def grow_best_first(blocks: RDD, tree: int, bins: Bins, rules: C.Rules, seed: int, view: Callable) -> C.Nodes:
    """A tree of at most ``rules.leaves`` leaves; a pass looks at all nodes that the order of gains asks for so far."""
    top = _Top(tree)
    top.add(C.tree_key(seed, tree), 0)
    wanted = [0]
    while wanted:
        _search(blocks, [top], [(0, n) for n in wanted], bins, view, rules, None)
        order, wanted = _split_order(top, rules)
    keep = C.Nodes()
    _copy(top, 0, set(order), keep)
    return keep


def _split_order(top: _Top, rules: C.Rules) -> tuple[list[int], list[int]]:
    """Nodes in the order in which the best leaf is split, and leaves whose cut has yet to be found."""
    leaves, order, unknown = {0}, [], []
    while len(leaves) < rules.leaves:
        known = [n for n in leaves if n in top.cut and np.isfinite(top.cut[n][2]) and _open(top, n, rules)]
        if not known:
            break
        best = min(known, key=lambda n: (-top.cut[n][2], n))
        leaves.remove(best)
        leaves |= set(top.split(best))
        order.append(best)
        unknown = [n for n in leaves if n not in top.cut and _open(top, n, rules)]
    return order, unknown


def _open(top: _Top, node: int, rules: C.Rules) -> bool:
    deep = rules.depth is not None and top.depth[node] >= rules.depth
    return not deep and (node == 0 or bool(rules.may_split(np.asarray(top.rows[node]))))


def _copy(top: _Top, node: int, inner: set[int], out: C.Nodes) -> int:
    at = len(out.feature)
    for part, source in zip(vars(out).values(), vars(top.nodes).values()):
        part.append(source[node])
    if node in inner:
        out.left[at], out.right[at] = (_copy(top, n, inner, out) for n in (top.nodes.left[node], top.nodes.right[node]))
    else:
        out.feature[at] = out.left[at] = out.right[at] = -1
    return at


# ---- forests ----


@dataclass(frozen=True)
class ForestPlan:
    """How many trees, how they grow, what share of the features each may use, and its rows' Poisson weights."""

    trees: int
    rules: C.Rules
    share: float = 1.0
    draws: float | None = None  # mean of the weights; None: every row once
    seed: int = 42

    def allowed(self, tree: int, p: int) -> np.ndarray:
        width = max(1, int(self.share * p))
        order = np.argsort(C.mix(C.tree_key(self.seed + 1, tree) ^ C.mix(np.arange(p))), kind="stable")
        return np.sort(order[:width])

    def row_key(self, tree: int) -> np.uint64:
        """What a tree's draws of rows follow from."""
        return C.tree_key(self.seed + 2, tree)

    def weights(self, tree: int, h: np.ndarray) -> np.ndarray | None:
        return None if self.draws is None else C.poisson(C.uniform(self.row_key(tree), h), self.draws)


def fit_forest(rows: DataFrame, bins: Bins, plan: ForestPlan) -> Forest | StoredForest:
    """All trees of a forest over stored ``binned`` rows.

    Trees are written where they have grown, in pieces of bounded size.  Only a forest of few nodes comes to the driver.
    """
    n, mean = rows.agg(F.count("*"), F.avg("y")).first()
    if n <= UNIT_ROWS:
        trees = np.arange(plan.trees)
        jobs = _Jobs(trees // TREES_TOGETHER, trees, np.zeros(plan.trees), [C.tree_key(plan.seed, t) for t in trees])
        units = -(-plan.trees // TREES_TOGETHER)
        grown = [(_grown(_every_unit(pack(rows), units), bins, plan, float(mean), jobs, units, whole=True), {})]
    else:
        grown = list(_fit_large(rows, bins, plan, float(mean)))
    stored = StoredForest.joined(rows.sparkSession, [_finished(table, tops, bins) for table, tops in grown], plan.trees)
    forest = stored.collected()
    if forest is None:
        return stored
    release(*[table for table, _ in grown])
    return forest


def _block(x, y, mean, bins: Bins, plan: ForestPlan, tree: int, h) -> C.Block:
    """The rows and features that a tree sees."""
    mine = plan.allowed(tree, len(bins.cuts))
    block = C.Block(x[mine], y - mean, [bins.widths[i] for i in mine], bins.values[mine], plan.weights(tree, h))
    return block if block.w is None else block.take(np.flatnonzero(block.w > 0))


def _named(nodes: C.Nodes, mine: np.ndarray, mean: float) -> C.Nodes:
    """Features by their number among all, values around zero again."""
    names = np.append(mine, -1)
    return C.Nodes(names[nodes.feature].tolist(), nodes.cut, nodes.left, nodes.right, (np.asarray(nodes.value) + mean).tolist(), nodes.cover)


@dataclass(frozen=True)
class _Jobs:
    """What grows in units, in their order: a tree from the root, or a node of its upper part, down; with its depth and hash."""

    unit: Sequence[int]
    tree: Sequence[int]
    depth: Sequence[int]
    key: Sequence[np.uint64]


def _grown(blobs: DataFrame, bins: Bins, plan: ForestPlan, mean: float, jobs: _Jobs, units: int, whole: bool) -> DataFrame:
    """Trees of units in pieces, with thresholds and bytes for numbers; stored.  ``whole`` trees are of unit -1; others have
    their root in a piece of its own."""
    p, rules, spark = len(bins.cuts), plan.rules, blobs.sparkSession
    columns = np.stack([plan.allowed(t, p) for t in range(plan.trees)])
    starts = np.concatenate(([0], np.cumsum([len(c) for c in bins.cuts])))[:-1]
    setup = (p, PIECE_NODES, columns.shape[1], whole, -1 if rules.depth is None else rules.depth, rules.min_leaf,
             max(rules.min_split, 2 * rules.min_leaf), rules.tried or 0, rules.random_cuts)
    whole_numbers = {"setup": setup, "unit": jobs.unit, "tree": jobs.tree, "depth": jobs.depth, "columns": columns, "widths": bins.widths, "base": starts}
    numbers = {"cuts": np.concatenate(bins.cuts), "values": bins.values if rules.random_cuts else [], "mean": [mean],
               "draws": [] if plan.draws is None else C.poisson_steps(plan.draws)}
    grow = job(spark, "Grow", **{k: np.asarray(v, np.int32) for k, v in whole_numbers.items()}, **{k: np.asarray(v, float) for k, v in numbers.items()},
               key=np.asarray(jobs.key, np.uint64), row_key=np.asarray([plan.row_key(t) for t in range(plan.trees)], np.uint64))
    dealt = blobs.repartitionById(units, "unit").sortWithinPartitions("unit")
    return materialize(over_partitions(dealt, grow, PIECE_DDL), "trees")


def _fit_large(rows: DataFrame, bins: Bins, plan: ForestPlan, mean: float) -> Iterator[tuple[DataFrame, dict]]:
    """Upper levels by aggregations, then every open node as a unit; a few trees at a time, so that their upper
    parts stay small.  Yields pieces of units, and by tree its upper part and the unit of each of its open leaves."""
    p = len(bins.cuts)
    allowed = {t: plan.allowed(t, p) for t in range(plan.trees)}
    context = rows.sparkSession.sparkContext
    blocks = blocks_of(rows, mean)

    def view(tree, h, y, x, extra):
        return y, plan.weights(tree, h)

    for low in range(0, plan.trees, TOPS_TOGETHER):
        trees = range(low, min(low + TOPS_TOGETHER, plan.trees))
        tops = grow_tops(blocks, trees, bins, plan.rules, plan.seed, view, UNIT_ROWS, allowed)
        # units: leaves that may go on
        units, ends = [], []
        for top in tops:
            end = np.full(len(top.keys), -1)
            for node in range(len(top.keys)):
                deep = plan.rules.depth is not None and top.depth[node] >= plan.rules.depth
                if top.nodes.feature[node] < 0 and node not in top.cut and not deep and plan.rules.may_split(np.asarray(top.rows[node])):
                    end[node] = len(units)
                    units.append((top.tree, top.keys[node], top.depth[node]))
            ends.append(end)
        shared = context.broadcast(([(t.tree, C.Nodes(*t.nodes.arrays()), e) for t, e in zip(tops, ends)], units))

        def assign(h, x, shared=shared):
            for tree, nodes, end in shared.value[0]:
                unit = end[C.leaves_of(nodes, x)]
                w = plan.weights(tree, h)
                inside = np.flatnonzero(unit >= 0 if w is None else (unit >= 0) & (w > 0))
                order = inside[np.argsort(unit[inside], kind="stable")]
                number, first = np.unique(unit[order], return_index=True)
                yield from zip(number.tolist(), np.split(order, first[1:]))

        jobs = _Jobs(range(len(units)), *([u[i] for u in units] for i in (0, 2, 1)))
        found = _grown(pack(rows, assign), bins, plan, mean, jobs, max(len(units), 1), whole=False)
        yield found, {t.tree: (_named(t.nodes, np.arange(p), mean), e) for t, e in zip(tops, ends)}
    blocks.unpersist()


def _finished(table: DataFrame, tops: dict[int, tuple[C.Nodes, np.ndarray]], bins: Bins) -> DataFrame:
    """Pieces of whole trees: nodes of units go behind those of the upper part, whose leaf their root becomes."""
    if not tops:
        return table.select("tree", "start", F.lit(0).alias("base"), *ARRAYS)
    spark, moves, upper = table.sparkSession, [], []
    roots = {r["unit"]: [np.frombuffer(r[c], k)[0] for c, k in zip(ARRAYS, KINDS)] for r in table.filter("start = 0").collect()}
    sizes = dict(table.groupBy("unit").agg(F.sum(F.expr(NODES))).collect())
    for tree, (nodes, end) in tops.items():
        arrays, size = [np.array(getattr(bins.tree(*nodes.arrays()), c), k) for c, k in zip(ARRAYS, KINDS)], len(end)
        for node in np.flatnonzero(end >= 0).tolist():
            unit, move = int(end[node]), size - 1
            for i, (a, v) in enumerate(zip(arrays, roots[unit])):
                a[node] = v + move if i in (2, 3) and v >= 0 else v
            moves.append((unit, move))
            size += sizes[unit] - 1
        upper.append((tree, 0, 0, *[bytearray(a.tobytes()) for a in arrays]))
    below = table.filter("start > 0").join(F.broadcast(spark.createDataFrame(moves, "unit int, base int")), "unit")
    moved = below.select("tree", (F.col("start") + F.col("base")).alias("start"), "base", *ARRAYS)
    return moved.unionByName(spark.createDataFrame(upper, FOREST_DDL))


# ---- boosting ----


@dataclass(frozen=True)
class BoostPlan:
    rounds: int
    rules: C.Rules
    rate: float
    share: float = 1.0
    seed: int = 42


def fit_boosted(rows: DataFrame, bins: Bins, plan: BoostPlan) -> Forest:
    """Trees on residuals; the first tree of the forest is the mean that they start from."""
    n, mean = rows.agg(F.count("*"), F.avg("y")).first()
    mean = float(mean)
    if n <= min(BOOST_ROWS, UNIT_ROWS):
        def train(unit, h, y, x):
            block = C.Block(x, y - mean, bins.widths)
            for i, (nodes, _) in enumerate(C.boost(block, h.astype(np.uint64), plan.rules, plan.rounds, plan.rate, plan.share, plan.seed)):
                yield _tree_row(0, i, nodes)

        found = sorted(_collected(in_units(pack(rows), train, TREE_DDL, 1)), key=lambda r: r[1])
        trees = [bins.tree(*arrays) for _, _, arrays in found]
    else:
        trees = [bins.tree(*nodes.arrays()) for nodes in _boost_large(rows, bins, plan, mean)]
    return Forest([constant(mean, n), *trees], [1.0, *[plan.rate] * len(trees)])


def constant(value: float, cover: float) -> Tree:
    """A tree that is one leaf."""
    return Tree(np.asarray([-1], np.int16), np.zeros(1), *[np.asarray([-1], np.int32)] * 2, np.asarray([value]), np.asarray([float(cover)]))


class KeptBlocks:
    """Rows of boosting as blocks that executors keep in the JVM, whose targets are what the rounds before have left.

    The cells of a pass go to the driver in one array for each partition, added up in between where there are many; partitions
    are as many as in ``blocks_of``.
    """

    def __init__(self, spark: SparkSession, blocks, tasks: int):
        self.spark, self.tasks = spark, tasks
        self.blocks = blocks.persist(spark.sparkContext._jvm.org.apache.spark.api.java.StorageLevels.MEMORY_AND_DISK)

    @classmethod
    def of(cls, rows: DataFrame, features: int, mean: float) -> KeptBlocks:
        spark = rows.sparkSession
        tasks = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
        made = job(spark, "ToBlocks", setup=np.asarray((features, BLOCK_ROWS), np.int32), mean=np.asarray([mean]))
        kept = cls(spark, pack(rows).select("h", "y", "x").repartition(tasks)._jdf.javaRDD().mapPartitions(made), tasks)
        return kept.written()  # or every task of every pass would be sent how the rows came about

    def count_cells(self, tops: Sequence[_Top], slots: list[tuple[int, int]], widths: list[int], view: tuple) -> Iterator[tuple]:
        """As ``count_cells``, of one tree; ``view`` is the hash that its draws of rows follow from, and their share."""
        ((top,),) = ({t for t, _ in slots},)
        nodes, offsets, count = tops[top].nodes, np.concatenate(([0], np.cumsum(widths))), len(slots)
        slot_of = np.full(len(nodes.feature), -1)
        slot_of[[n for _, n in slots]] = np.arange(count)
        whole = {"slot": slot_of, "offset": offsets, "slots": [count]} | _walked(nodes)
        made = job(self.spark, "Count", **{k: np.asarray(v, np.int32) for k, v in whole.items()}, key=np.asarray([view[0]], np.uint64),
                   share=np.asarray([view[1]], float))
        counted, add = self.blocks.mapPartitions(made), job(self.spark, "Add")
        added = counted.reduce(add) if self.tasks <= FEW_TASKS else counted.treeReduce(add, 2)
        with tempfile.NamedTemporaryFile(prefix="gavelstat-") as file:
            add.write(added, file.name)
            found = np.fromfile(file.name)
        cells, squares = found[:-count].reshape(count, -1, 2), found[-count:]
        for slot in range(count):
            used = np.flatnonzero(cells[slot, :, 0]).astype(np.int32)
            if len(used):
                n, s = cells[slot, used].T
                yield slot, [(used, n, None, s, squares[slot])]

    def without(self, nodes: C.Nodes, rate: float, number: int) -> KeptBlocks:
        """The blocks after a round; the next pass fills them.  Now and then that writes them, so that a lost executor does
        not cost all rounds."""
        made = job(self.spark, "Without", **{k: np.asarray(v, np.int32) for k, v in _walked(nodes).items()}, value=np.asarray(nodes.value, float),
                   rate=np.asarray([rate], float))
        after = KeptBlocks(self.spark, self.blocks.map(made), self.tasks)
        return after.written() if (number + 1) % ROUND_CUT == 0 else after

    def written(self) -> KeptBlocks:
        """The same, which the first job on them also writes to the shared folder."""
        context = self.spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_dir(self.spark))
        self.blocks.checkpoint()
        return self

    def unpersist(self) -> None:
        self.blocks.unpersist(False)


def _walked(nodes: C.Nodes) -> dict[str, list]:
    return {"feature": nodes.feature, "cut": nodes.cut, "left": nodes.left, "right": nodes.right}


def _boost_large(rows: DataFrame, bins: Bins, plan: BoostPlan, mean: float) -> Iterator[C.Nodes]:
    """Every round by aggregations over kept blocks."""
    features = len(bins.cuts)
    blocks, before = KeptBlocks.of(rows, features, mean), None
    for number in range(plan.rounds):
        view = (C.tree_key(plan.seed, number), plan.share)
        if plan.rules.leaves is None:
            (top,) = grow_tops(blocks, [number], bins, plan.rules, plan.seed, view)
            nodes = top.nodes
        else:
            nodes = grow_best_first(blocks, number, bins, plan.rules, plan.seed, view)
        yield nodes
        _forget(before)
        if number + 1 < plan.rounds:
            before, blocks = blocks, blocks.without(nodes, plan.rate, number)
    _forget(blocks)


def _next_round(spark: SparkSession, blocks: RDD, step: Callable, number: int) -> RDD:
    """Kept blocks after a round; the next job fills them.  Now and then that writes them, so that a lost executor does
    not cost all rounds."""
    after = blocks.map(step).persist(StorageLevel.MEMORY_AND_DISK)
    if (number + 1) % ROUND_CUT == 0:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(shared_dir(spark))
        after.checkpoint()
    return after


def _forget(blocks: RDD | KeptBlocks | None) -> None:
    if blocks is not None:
        blocks.unpersist()


@dataclass(frozen=True)
class AdaPlan:
    rounds: int
    rules: C.Rules
    rate: float
    seed: int = 42


def fit_ada(rows: DataFrame, bins: Bins, plan: AdaPlan) -> Forest:
    """AdaBoost.R2: trees on weighted rows, combined by their weighted median."""
    n, mean = rows.agg(F.count("*"), F.avg("y")).first()
    mean = float(mean)
    if n <= min(BOOST_ROWS, UNIT_ROWS):
        def train(unit, h, y, x):
            trees, votes = C.ada_boost(C.Block(x, y - mean, bins.widths), plan.rules, plan.rounds, plan.rate, plan.seed)
            for i, (nodes, vote) in enumerate(zip(trees, votes)):
                yield _tree_row(0, i, nodes) | {"vote": vote}

        found = in_units(pack(rows), train, TREE_DDL + ", vote double", 1).orderBy("tree")
        stored = materialize(found, "ada")
        votes = [r["vote"] for r in stored.select("tree", "vote").orderBy("tree").collect()]
        grown = [a for _, _, a in sorted(_collected(stored.drop("vote")), key=lambda r: r[1])]
        release(stored)
    else:
        grown, votes = _ada_large(rows, bins, plan, mean)
    trees = [bins.tree(*a[:4], a[4] + mean, a[5]) for a in grown]
    return Forest(trees, votes, "median")


def _ada_large(rows: DataFrame, bins: Bins, plan: AdaPlan, mean: float) -> tuple[list, list[float]]:
    blocks, before, state, grown = blocks_of(rows, mean, 1.0), None, C.AdaState(plan.rate), []

    def view(tree, h, y, x, w):
        return y, w

    for number in range(plan.rounds):
        (top,) = grow_tops(blocks, [number], bins, plan.rules, plan.seed, view)
        nodes = C.Nodes(*top.nodes.arrays())

        def missed(block, nodes=nodes):
            _, y, x, w = block
            miss = np.abs(nodes.value[C.leaves_of(nodes, x)] - y)
            return float(miss.max()), float((w * miss).sum()), float(w.sum())

        _forget(before)
        worst, error, total = blocks.map(missed).reduce(lambda a, b: (max(a[0], b[0]), a[1] + b[1], a[2] + b[2]))
        stays, goes_on, beta = state.after(worst, error, total)
        if stays:
            grown.append(nodes.arrays())
        if not goes_on or number + 1 == plan.rounds:
            break

        def weighed(block, nodes=nodes, worst=worst, total=total, beta=beta):
            h, y, x, w = block
            miss = np.abs(nodes.value[C.leaves_of(nodes, x)] - y)
            return h, y, x, w * beta ** ((1.0 - miss / worst) * plan.rate) / total

        before, blocks = blocks, _next_round(rows.sparkSession, blocks, weighed, number)
    _forget(blocks)
    return grown, state.votes


# ---- search ----


def staged_scores(rows: DataFrame, fits: str, bins: Bins, plans: Sequence[BoostPlan],
                  stages: Sequence[Sequence[int]]) -> list[dict[int, float]]:
    """R² on the rows outside ``fits`` of every plan's first trees, by their number.

    Each plan is a unit of its own, so plans are fitted side by side over rows that are binned and packed once.
    """
    marked = rows.select((F.col("h") * 2 + F.col(fits).cast("bigint")).alias("h"), "y", "x")

    def train(unit, h, y, x):
        plan, wanted = plans[unit], set(stages[unit])
        inside, h = (h & 1) == 1, h >> 1
        mean = float(y[inside].mean())
        block, test_x, test_y = C.Block(x[:, inside], y[inside] - mean, bins.widths), x[:, ~inside], y[~inside] - mean
        score, spread = np.zeros(len(test_y)), float(((test_y - test_y.mean()) ** 2).sum())
        grown = C.boost(block, h[inside].astype(np.uint64), plan.rules, plan.rounds, plan.rate, plan.share, plan.seed)
        for number, (nodes, _) in enumerate(grown, start=1):
            score += plan.rate * np.asarray(nodes.value)[C.leaves_of(nodes, test_x)]
            if number in wanted:
                yield {"unit": unit, "rounds": number, "r2": 1.0 - float(((test_y - score) ** 2).sum()) / spread}

    found = in_units(_every_unit(pack(marked), len(plans)), train, "unit int, rounds int, r2 double", len(plans))
    out: list[dict[int, float]] = [{} for _ in plans]
    for r in found.collect():
        out[r["unit"]][r["rounds"]] = r["r2"]
    return out


# ---- a model for every group ----


def fit_in_place(plan: ForestPlan | BoostPlan | AdaPlan, features: list[str], x: np.ndarray, y: np.ndarray, h: np.ndarray) -> Forest:
    """The forest of one bounded block of rows, as the fit of a table of just these rows gives it."""
    bins = bins_of_values(features, x)
    mean, codes = float(y.mean()), bins.of(x)
    if isinstance(plan, BoostPlan):
        grown = C.boost(C.Block(codes, y - mean, bins.widths), h.astype(np.uint64), plan.rules, plan.rounds, plan.rate, plan.share, plan.seed)
        trees = [bins.tree(*nodes.arrays()) for nodes, _ in grown]
        return Forest([constant(mean, len(y)), *trees], [1.0, *[plan.rate] * len(trees)])
    if isinstance(plan, AdaPlan):
        grown, votes = C.ada_boost(C.Block(codes, y - mean, bins.widths), plan.rules, plan.rounds, plan.rate, plan.seed)
        arrays = [nodes.arrays() for nodes in grown]
        return Forest([bins.tree(*a[:4], a[4] + mean, a[5]) for a in arrays], votes, "median")
    trees = []
    for tree in range(plan.trees):
        nodes, _ = C.grow(_block(codes, y, mean, bins, plan, tree, h), plan.rules, C.tree_key(plan.seed, tree))
        trees.append(bins.tree(*_named(nodes, plan.allowed(tree, len(features)), mean).arrays()))
    return Forest(trees, [1.0 / plan.trees] * plan.trees)


def trees_in_place(plan: ForestPlan, features: list[str], x: np.ndarray, y: np.ndarray, h: np.ndarray, trees: range) -> Iterator[tuple[Tree, np.ndarray]]:
    """Some trees of ``fit_in_place``, several in one set of node arrays, one behind the other, and where each begins.

    Many trees of few rows are grown side by side, as many as have GROWN_TOGETHER rows in all.
    """
    bins = bins_of_values(features, x)
    mean, codes = float(y.mean()), bins.of(x)
    step = max(1, GROWN_TOGETHER // len(y)) if plan.share == 1.0 and plan.draws is None and plan.rules.leaves is None else 1
    for low in range(trees.start, trees.stop, step):
        some = range(low, min(low + step, trees.stop))
        if step > 1:
            block = _block(codes, y, mean, bins, plan, low, h)
            (feature, cut, left, right, value, cover), sizes = C.grow_together(block, plan.rules, np.asarray([C.tree_key(plan.seed, t) for t in some]))
            begin = np.cumsum(sizes) - sizes
            shift = np.repeat(begin, sizes)
            left, right = (np.where(v >= 0, v + shift, -1) for v in (left, right))
            yield bins.tree(feature, cut, left, right, value + mean, cover), begin
        else:
            nodes, _ = C.grow(_block(codes, y, mean, bins, plan, low, h), plan.rules, C.tree_key(plan.seed, low))
            yield bins.tree(*_named(nodes, plan.allowed(low, len(features)), mean).arrays()), np.zeros(1, np.int64)


def in_groups(rows: DataFrame, by: str, features: Sequence[str], target: str, key: Column, fits: Column, chunks: Column, each: Callable, ddl: str) -> DataFrame:
    """``each(group, chunk, h, y, x, fits)`` for all chunks of work, numbered from 0, of every group of bounded size; it
    yields dicts.  x has a row per feature."""
    names = list(features)
    numbers = F.array(*[F.col(c).cast("double") for c in names])
    packed = rows.select(F.col(by).alias("unit"), (row_hash(key, 0) * 2 + fits.cast("bigint")).alias("h"),
                         F.col(target).cast("double").alias("y"), numbers.alias("x"), chunks.cast("int").alias("chunks"))
    kind = dict(packed.dtypes)["unit"]
    packed_ddl = f"unit {kind}, chunks int, h binary, y binary, x binary"
    arrow = to_arrow_schema(_parse_datatype_string(packed_ddl))

    def pack_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            number = groups.indices.to_numpy(zero_copy_only=False)
            h, y = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(len(h), -1).astype(float)
            order = np.argsort(number, kind="stable")
            found, first = np.unique(number[order], return_index=True)
            parts = np.split(order, first[1:])
            counts = batch.column(4).to_numpy()[order[first]]
            columns = [groups.dictionary.take(pa.array(found)), pa.array(counts), *[[v[p].tobytes() for p in parts] for v in (h, y, x)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, arrow)], schema=arrow)

    schema = _parse_datatype_string(ddl)
    out = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (group, chunk), parts in groupby(blobs, key=lambda r: r[:2]):
            _, _, h, y, x = zip(*parts)
            h, y = (np.frombuffer(b"".join(v), t) for v, t in ((h, np.int64), (y, float)))
            x = np.frombuffer(b"".join(x), float).reshape(len(h), -1)
            order = np.lexsort((y, h))
            h, y, x = h[order], y[order], x[order]
            for row in each(group, chunk, h >> 1, y, x, (h & 1) == 1):
                yield pa.RecordBatch.from_pylist([row], schema=out)

    blobs = packed.mapInArrow(pack_groups, packed_ddl)
    dealt = blobs.select("unit", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "h", "y", "x")
    return dealt.repartition(GROUP_TASKS, "unit", "chunk").sortWithinPartitions("unit", "chunk").mapInArrow(run, schema)
