"""A model for every group in one pass, and grading of groups by one model.

A ridge fit needs only counts, means and covariances.  They are ordinary aggregates, so
one shuffle of a few numbers per group replaces a training run per group, and a group
with a third of all rows is as cheap as a small one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from gavelstat.functions.group_ranks import joined_facts
from gavelstat.operators import models as M
from gavelstat.operators import tree_growth as T
from gavelstat.schema import MIN_CASES, TARGET
from gavelstat.workspace import materialize

ALPHA = 0.1
#: Rows times trees of a chunk of a group's forest; a power of two.
CHUNK_WORK = 1 << 22
BLOCK = 80  # whole-stage code generation stops at 100 fields


def group_sums(
    df: DataFrame, by: Sequence[str], features: Sequence[str], target: str = TARGET
) -> tuple[DataFrame, np.ndarray]:
    """Sums and sums of products per group, around the overall means, which are returned too.

    ``sums`` holds the count, the sum of each variable (features, then target) and the upper
    triangle of their products.  The sums are taken in blocks narrow enough for generated code;
    each block reads only stored columns.  Rows with a missing value are left out.
    """
    names = [*features, target]
    whole = df.dropna(subset=names)
    centre = whole.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names]).first()
    shifted = [(F.col(c).cast("double") - F.lit(centre[c])).alias(f"__{i}") for i, c in enumerate(names)]
    whole = whole.select(*by, *shifted)
    v = [F.col(f"__{i}") for i in range(len(names))]
    terms = [F.sum(F.lit(1.0)), *[F.sum(x) for x in v]]
    terms += [F.sum(v[i] * v[j]) for i in range(len(v)) for j in range(i, len(v))]
    blocks = None
    for number, start in enumerate(range(0, len(terms), BLOCK)):
        named = [t.alias(f"t{k}") for k, t in enumerate(terms[start : start + BLOCK])]
        found = whole.groupBy(*by).agg(*named)
        found = found.select(*by, F.struct(F.lit(number).alias("block"), F.array(*[f"t{k}" for k in range(len(named))]).alias("v")).alias("part"))
        blocks = found if blocks is None else blocks.unionByName(found)
    in_order = F.transform(F.sort_array(F.collect_list("part")), lambda part: part["v"])
    return blocks.groupBy(*by).agg(F.flatten(in_order).alias("sums")), np.array([centre[c] for c in names], dtype=float)


def moments_of(sums: np.ndarray, centre: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, means and population covariance matrix from one group's sums."""
    q = len(centre)
    n, first = sums[0], sums[1 : q + 1] / sums[0]
    covariance = np.zeros((q, q))
    covariance[np.triu_indices(q)] = sums[q + 1 :] / n
    covariance = covariance + np.triu(covariance, 1).T - np.outer(first, first)
    return n, centre + first, covariance


def solve_ridge(gram: np.ndarray, cross: np.ndarray, n: float, alpha: float) -> np.ndarray:
    """Coefficients from covariances; ``alpha`` penalises the sum of squares."""
    left, right = n * gram + alpha * np.eye(len(cross)), n * cross
    return np.linalg.solve(left, right) if alpha > 0 else np.linalg.lstsq(left, right, rcond=None)[0]


def train_per_group(
    df: DataFrame, by: Sequence[str], features: Sequence[str], target: str = TARGET, alpha: float = ALPHA,
    min_cases: int = MIN_CASES,
) -> DataFrame:
    """A ridge model per group with more than ``min_cases`` rows.

    Gives ``n, intercept, coefficients, mse, r2`` per group; the fit quality follows from the
    moments too.  Only the small systems are solved outside the JVM.
    """
    by = list(by)
    sums, centre = group_sums(df, by, features, target)
    kinds = dict(sums.dtypes)
    schema = ", ".join(
        [f"`{b}` {kinds[b]}" for b in by]
        + ["n bigint", "intercept double", "coefficients array<double>", "mse double", "r2 double"]
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *group, values in batch[[*by, "sums"]].itertuples(index=False, name=None):
                n, means, covariance = moments_of(np.asarray(values), centre)
                gram, cross, spread = covariance[:-1, :-1], covariance[:-1, -1], covariance[-1, -1]
                w = solve_ridge(gram, cross, n, alpha)
                mse = max(0.0, spread - 2 * w @ cross + w @ gram @ w)
                r2 = 1 - mse / spread if spread > 0 else None
                rows.append((*group, int(n), means[-1] - w @ means[:-1], w.tolist(), mse, r2))
            yield pd.DataFrame(rows, columns=[*by, "n", "intercept", "coefficients", "mse", "r2"])

    return sums.filter(F.col("sums")[0] > min_cases).mapInPandas(solve, schema)


def check_fits(
    df: DataFrame, fitted: DataFrame, by: Sequence[str], features: Sequence[str], target: str = TARGET,
    alpha: float = ALPHA,
) -> DataFrame:
    """How well stored models solve their normal equations on the rows: n, largest_residual and r2_recomputed.

    One pass over the rows; it does not use the moments that the fit came from.
    """
    by, y = list(by), F.col(target).cast("double")
    joined = df.join(fitted.select(*by, "intercept", "coefficients"), by)
    prediction = F.col("intercept")
    for i, f in enumerate(features):
        prediction = prediction + F.col("coefficients")[i] * F.col(f).cast("double")
    rows = joined.withColumn("__e", y - prediction)
    sums = [F.sum("__e").alias("__s"), F.sum(F.col("__e") * F.col("__e")).alias("__q"), F.var_pop(y).alias("__v"), F.count("*").alias("n")]
    for i, f in enumerate(features):
        x = F.col(f).cast("double")
        sums += [F.sum(x * F.col("__e")).alias(f"__c{i}"), F.avg(x).alias(f"__m{i}"), F.max(F.col("coefficients")[i]).alias(f"__w{i}")]
    residuals = [
        F.abs(F.col(f"__c{i}") - F.col(f"__m{i}") * F.col("__s") - alpha * F.col(f"__w{i}")) for i in range(len(features))
    ]
    return rows.groupBy(*by).agg(*sums).select(
        *by, "n", F.greatest(F.abs("__s"), *residuals).alias("largest_residual"),
        F.try_divide(-F.col("__q"), F.col("n") * F.col("__v")).alias("__r"),
    ).select(*by, "n", "largest_residual", (F.col("__r") + 1).alias("r2_recomputed"))


def coefficient_profile(per_group: DataFrame, by: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Long form: one row per group and feature."""
    names = F.array(*[F.lit(f) for f in features])
    pairs = F.explode(F.arrays_zip(names.alias("feature"), F.col("coefficients").alias("coefficient"))).alias("p")
    return per_group.select(*by, pairs).select(*by, F.col("p.feature"), F.col("p.coefficient"))


@dataclass(frozen=True)
class LinearModel:
    """A linear predictor as a column expression."""

    features: list[str]
    coefficients: list[float]
    intercept: float

    def prediction(self) -> Column:
        total = F.lit(self.intercept)
        for f, w in zip(self.features, self.coefficients):
            total = total + F.col(f).cast("double") * F.lit(w)
        return total

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        return df.withColumn(column, self.prediction())


def fit_state_model(df: DataFrame, features: Sequence[str], target: str = TARGET, alpha: float = ALPHA) -> LinearModel:
    """One ridge model over all rows from their moments."""
    row = train_per_group(df, [], features, target, alpha).first()
    return LinearModel(list(features), list(row["coefficients"]), row["intercept"])


def grade(
    scored: DataFrame, by: Sequence[str], target: str = TARGET, prediction: str = "prediction",
    min_cases: int = MIN_CASES, limit: int | None = None,
) -> DataFrame:
    """How each group's targets compare with the general model's predictions.

    One scoring pass and one aggregation serve every group; ``limit`` keeps the first groups
    by name.
    """
    y, p = F.col(target), F.col(prediction)
    mse = F.avg((y - p) * (y - p))
    graded = (
        scored.groupBy(*by)
        .agg(
            F.count("*").alias("n"),
            F.avg(p).alias("average_predicted"),
            F.avg(y).alias("average_actual"),
            F.avg(y - p).alias("average_difference"),
            mse.alias("mse"),
            (1 - F.try_divide(mse, F.var_pop(y))).alias("r2"),
        )
        .filter(F.col("n") > min_cases)
    )
    return graded.orderBy(*by).limit(limit) if limit is not None else graded


def train_trees_per_group(
    df: DataFrame, by: str, features: Sequence[str], model_type: str, key: Column, params: dict | None = None,
    target: str = TARGET, min_cases: int = MIN_CASES, fits: Column | None = None,
) -> DataFrame:
    """A tree ensemble of every group with more than ``min_cases`` rows: n, n_test, mse, r2, importances.

    Models learn from the rows where ``fits`` holds and are judged on the others, or on all rows without ``fits``.  A
    group of at most UNIT_ROWS rows is trained in the tasks that its rows are dealt to, very many side by side: forests in
    chunks of trees, the more the larger the group is, whose predictions and importances are then added up.  The few
    larger groups are fitted one after the other, each by all tasks.
    """
    features = list(features)
    plan = M.plan_of(model_type, {**M.GOOD_PARAMS[model_type], **(params or {})}, len(features))
    whole, fits_here = fits is None, F.lit(True) if fits is None else fits
    sizes = df.groupBy(by).agg(F.count("*").alias("__n")).filter(F.col(by).isNotNull() & (F.col("__n") > min_cases))
    sizes = materialize(sizes, "sizes")
    large = [r[by] for r in sizes.filter(F.col("__n") > T.UNIT_ROWS).select(by).collect()]
    small = sizes.filter(F.col("__n") <= T.UNIT_ROWS)
    forest_plan, p = isinstance(plan, T.ForestPlan), len(features)
    count = plan.trees if forest_plan else 1
    work = F.least(F.lit(count), F.ceil(F.col("__n") * count / CHUNK_WORK)) if forest_plan else F.lit(1)
    rows = joined_facts(df, small.select(by, work.cast("int").alias("__chunks")), [by])

    def each(group, chunk, h, y, x, learns):
        if not learns.any():
            return
        held = learns if whole else ~learns
        row = {by: group, "chunk": chunk, "n": len(y), "y": y[held].tobytes()}
        if forest_plan:
            of = min(count, -(-len(y) * count // CHUNK_WORK))
            total, shares = np.zeros(int(held.sum())), np.zeros(p)
            for tree, roots in T.trees_in_place(plan, features, x[learns], y[learns], h[learns], range(chunk * count // of, (chunk + 1) * count // of)):
                total += tree.sums_from(x[held], roots) / count
                shares += M.summed_shares(tree, roots, p)
            yield row | {"p": total.tobytes(), "shares": None if model_type == "bagging" else shares.tolist()}
        else:
            forest = T.fit_in_place(plan, features, x[learns], y[learns], h[learns])
            guess = forest.predict(x[held]) if held.any() else np.zeros(0)
            yield row | {"p": guess.tobytes(), "shares": M.forest_shares(forest, model_type, p)}

    kind = dict(df.dtypes)[by]
    ddl = f"`{by}` {kind}, chunk int, n bigint, y binary, p binary, shares array<double>"
    parts = T.in_groups(rows, by, features, target, key, fits_here, F.col("__chunks"), each, ddl)
    found = _judged(parts, by, f"`{by}` {kind}, n bigint, n_test bigint, mse double, r2 double, importances array<double>")
    for group in large:
        mine = df.filter(F.col(by) == group)
        model = M.train(mine.filter(fits_here), features, model_type, target, params, key)
        judged = M.evaluate(model.predict(mine if fits is None else mine.filter(~fits)), target=target)
        shares = F.array(*[F.lit(v) for v in model.importances()]) if model.importances() else F.lit(None).cast("array<double>")
        found = found.unionByName(judged.select(
            F.lit(group).alias(by), F.lit(mine.count()).alias("n"), F.col("n").alias("n_test"), "mse", "r2", shares.alias("importances")
        ))
    return found


def _judged(parts: DataFrame, by: str, ddl: str) -> DataFrame:
    """One row per group from the predictions and importances of its chunks, added up in their order."""
    arrow = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for group, chunks in groupby(rows, key=lambda r: r[0]):
            guess, shares = 0.0, None
            for _, _, n, y, p, share in chunks:
                y, guess = np.frombuffer(y, float), guess + np.frombuffer(p, float)
                shares = shares if share is None else np.asarray(share) + (0.0 if shares is None else shares)
            mse = float(((y - guess) ** 2).mean()) if len(y) else None
            spread = float(y.var()) if len(y) else 0.0
            if shares is not None and shares.sum():
                shares = shares / shares.sum()
            row = {by: group, "n": n, "n_test": len(y), "mse": mse, "r2": 1 - mse / spread if spread > 0 else None,
                   "importances": None if shares is None else shares.tolist()}
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return parts.repartition(by).sortWithinPartitions(by, "chunk").mapInArrow(run, ddl)


def train_for_targets(
    df: DataFrame, column: str, targets: Sequence[str], features: Sequence[str], model_type: str,
    target: str = TARGET, params: dict | None = None, key: Column | None = None, parallelism: int = 4,
) -> Iterator[tuple[str, M.FittedModel]]:
    """A separate model of any type for each listed judge or county, one after another finished.

    Rows are stored by target first, so each fit reads its own files only; ``parallelism``
    fits share the cluster at a time.  Linear models of all targets come cheaper from
    ``train_per_group``.
    """
    stored = materialize(df, "targets", by=column)

    def one(name: str) -> tuple[str, M.FittedModel]:
        mine = stored.filter(F.col(column) == name)
        return name, M.train(mine, features, model_type, target, params, key)

    with ThreadPool(parallelism) as pool:
        yield from pool.imap(inheritable_thread_target(df.sparkSession)(one), targets)
