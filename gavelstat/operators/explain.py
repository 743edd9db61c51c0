"""Importance, partial dependence and attributions."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gavelstat.functions.columns import row_hash
from gavelstat.functions.order_stats import melt_numbers, select_ranks
from gavelstat.functions.ranks import descending_rank
from gavelstat.operators.forest import Forest, attributions, dependence_sums, partial_dependence
from gavelstat.schema import TARGET
from gavelstat.workspace import materialize

BUCKET_ROWS = 65_536
GRID = 100
SWEEP_ROWS = 65_536
GRID_RANGE = (0.05, 0.95)
NOISE = 1e-9
LEVELS = {"state": [], "county": ["county_name"], "judge": ["county_name", "judge_name"]}


# ---- permutation importance ----


def permuted(df: DataFrame, features: Sequence[str], key: Column, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``__donor``: the features of the row that a random permutation of the whole table assigns.

    Two orders of all rows, each by a hash of the key, are matched place by place, so any row can be any other's donor
    and each is one exactly once.  An order is made by dealing rows to ranges of the hash; a row's place is its
    place within the range plus the rows of all ranges before, so that no task sorts more than a range.  The number of
    ranges follows that of the rows; the result depends on keys and seed alone.  ``key`` should tell rows apart: rows
    that share one stay in a range.
    """
    rows = materialize(df.withColumns({"__key": F.coalesce(key.cast("string"), F.lit("")), "__own": F.struct(*features)}), "permuted")
    n = rows.count()
    ranges = max(1, math.ceil(n / bucket_rows))
    left = _placed(rows, seed, ranges)
    right = _placed(rows.select("__key", "__own"), seed + 1, ranges)
    donors = right.select("__place", F.col("__own").alias("__donor"))
    # rows and donors meet in both cases by place, a number that no two rows of a side share
    return left.join(donors.hint("shuffle_hash"), "__place").drop("__place", "__key", "__own")


def _placed(rows: DataFrame, seed: int, ranges: int) -> DataFrame:
    """Adds ``__place``, 0 to n - 1, in the order of a hash of the key; equal rows may swap places."""
    # 60 bits in equal ranges; the top 30 decide, so that the product fits a long
    number = F.call_function("shiftright", F.col("__hash"), F.lit(30)).cast("bigint") * F.lit(ranges)
    hashed = rows.withColumn("__hash", row_hash(F.col("__key"), seed))
    hashed = hashed.withColumn("__range", F.call_function("shiftright", number, F.lit(30)).cast("bigint"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    # a row per range, some 65,000 times fewer than rows
    sizes = hashed.groupBy("__range").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy("__hash", "__key", "__own"))
    ranked = hashed.withColumn("__within", within)
    placed = ranked.join(offsets, "__range").withColumn("__place", F.col("__within") + F.col("__offset") - 1)
    return placed.drop("__hash", "__range", "__within", "__offset")


def permutation_importance(
    predict, df: DataFrame, features: Sequence[str], key: Column, target: str = TARGET, seed: int = 42,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Rise of the squared error when one feature's values are shuffled; any model.

    ``predict`` maps a frame with the feature columns to one with ``prediction``.  Each row is
    scored once as it is and once per feature.  The features of a row move together from its donor.
    """
    features = list(features)
    donors = permuted(df, features, key, seed, bucket_rows)
    variants = [F.struct(F.lit("").alias("Feature"), *[F.col(f).alias(f) for f in features])]
    for changed in features:
        values = [F.col(f"__donor.{f}").alias(f) if f == changed else F.col(f).alias(f) for f in features]
        variants.append(F.struct(F.lit(changed).alias("Feature"), *values))
    each = donors.select(target, F.explode(F.array(*variants)).alias("v")).select(target, "v.*")
    y, p = F.col(target), F.col("prediction")
    errors = predict(each).groupBy("Feature").agg(F.avg((y - p) * (y - p)).alias("mse"))
    base = errors.filter(F.col("Feature") == "").select(F.col("mse").alias("__base"))
    found = errors.filter(F.col("Feature") != "")
    return found.select("Feature", (F.col("mse") - base.scalar()).alias("Importance"))


# ---- association profiles ----


def _cells(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str):
    """Additive sums per county, judge and feature (and label), around the overall means."""
    centre = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in [target, *numeric]]).first()
    y = F.col(target).cast("double") - F.lit(centre[target])
    place = ["county_name", "judge_name"]
    labels = [F.struct(F.lit(c).alias("Feature"), F.col(c).cast("string").alias("value")) for c in categorical]
    by_label = (
        df.select(*place, y.alias("y"), F.explode(F.array(*labels)).alias("e"))
        .filter(F.col("e.value").isNotNull())
        .groupBy(*place, F.col("e.Feature").alias("Feature"), F.col("e.value").alias("value"))
        .agg(F.count("*").alias("c"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q"))
    )
    numbers = [
        F.struct(F.lit(c).alias("Feature"), (F.col(c).cast("double") - F.lit(centre[c])).alias("x")) for c in numeric
    ]
    x, yy = F.col("x"), F.col("y")
    by_number = (
        df.select(*place, y.alias("y"), F.explode(F.array(*numbers)).alias("e"))
        .select(*place, "y", "e.Feature", "e.x")
        .filter(x.isNotNull() & yy.isNotNull())
        .groupBy(*place, "Feature")
        .agg(F.count("*").alias("c"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(x * x).alias("sxx"),
             F.sum(x * yy).alias("sxy"), F.sum(yy * yy).alias("syy"))
    )
    return by_label, by_number


def _level_strength(by_label: DataFrame, by_number: DataFrame, keys: list[str]) -> DataFrame:
    merged = by_label.groupBy(*keys, "Feature", "value").agg(F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    overall = F.pow(F.sum("s"), 2) / F.sum("c")
    between = F.sum(F.col("s") * F.col("s") / F.col("c")) - overall
    total = F.sum("q") - overall
    varies = total > NOISE * F.sum("q")
    labels = merged.groupBy(*keys, "Feature").agg(_share(between, total, varies).alias("strength"))
    sums = {n: F.sum(n) for n in ("c", "sx", "sy", "sxx", "sxy", "syy")}
    cov = sums["sxy"] - sums["sx"] * sums["sy"] / sums["c"]
    vx = sums["sxx"] - sums["sx"] * sums["sx"] / sums["c"]
    vy = sums["syy"] - sums["sy"] * sums["sy"] / sums["c"]
    varies = (vx > NOISE * sums["sxx"]) & (vy > NOISE * sums["syy"])
    numbers = by_number.groupBy(*keys, "Feature").agg(_share(cov * cov, vx * vy, varies).alias("strength"))
    return labels.unionByName(numbers)


def _share(part: Column, whole: Column, varies: Column) -> Column:
    """Ratio of two sums, 0 where the whole is nothing but rounding."""
    return F.when(varies, part / whole).otherwise(F.lit(0.0))


def association_profile(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], target: str = TARGET,
    levels: Sequence[str] = tuple(LEVELS),
) -> DataFrame:
    """Share of the target's variation that goes with each feature, for the state, each county and each judge.

    The squared correlation for numbers, the between-label share of the variance for labels,
    scaled to sum to 1 per profile.  One pass over the rows fills cells that all levels share.
    """
    by_label, by_number = _cells(df, numeric, categorical, target)
    profiles = []
    for level in levels:
        keys = LEVELS[level]
        found = _level_strength(by_label, by_number, keys)
        whole = F.sum("strength").over(Window.partitionBy(*(F.col(k) for k in keys)) if keys else Window.partitionBy(F.lit(0)))
        share = F.when(whole > 0, F.col("strength") / whole).otherwise(F.lit(0.0))
        places = [F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("county_name", "judge_name")]
        profiles.append(found.select(F.lit(level).alias("level"), *places, "Feature", share.alias("Importance")))
    result = profiles[0]
    for p in profiles[1:]:
        result = result.unionByName(p)
    return result


def _correlations(df: DataFrame, by: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    y = F.col(target).cast("double")
    row = df.groupBy(*by).agg(*[F.corr(F.col(f).cast("double"), y).alias(f) for f in features])
    return row.unpivot(list(by), list(features), "Feature", "correlation")


def correlation_compare(
    df: DataFrame, features: Sequence[str], target: str = TARGET, group: str = "county_name", within: str | None = None
) -> DataFrame:
    """Correlations of each group against those of everyone (or of the ``within`` group), ranked.

    Rank 1 is the group whose correlation exceeds the general one most.
    """
    outer = [within] if within else []
    mine = _correlations(df, [*outer, group], features, target)
    general = _correlations(df, outer, features, target).withColumnRenamed("correlation", "general_correlation")
    joined = mine.join(general, [*outer, "Feature"])
    compared = joined.withColumn("difference", F.col("correlation") - F.col("general_correlation"))
    return descending_rank(compared, [*outer, "Feature"], F.round("difference", 9))


# ---- partial dependence ----


def feature_grids(df: DataFrame, features: Sequence[str], resolution: int = GRID) -> dict[str, list[float]]:
    """Values at which to evaluate each feature.

    All distinct values if there are fewer than ``resolution``, else evenly spaced ones
    between the 5th and 95th percentile (median-unbiased plotting positions).
    """
    features = list(features)
    # the estimate only saves exact counting where there are far more; the exact count decides
    counts = df.agg(*[F.approx_count_distinct(f, 0.02).alias(f) for f in features]).first()
    few = [f for f in features if counts[f] < resolution * 2]
    grids: dict[str, list[float]] = {}
    if few:
        exact = melt_numbers(df, few).distinct().groupBy("series").count().collect()
        few = [r["series"] for r in exact if r["count"] < resolution]
    if few:
        values = melt_numbers(df, few).distinct().collect()  # fewer than ``resolution`` per feature
        grids = {f: sorted(r["x"] for r in values if r["series"] == f) for f in few}
    many = [f for f in features if f not in grids]
    if many:
        grids.update(_even_grids(df, many, resolution))
    return {f: grids[f] for f in features}


def _even_grids(df: DataFrame, features: Sequence[str], resolution: int) -> dict[str, list[float]]:
    def spots(n):
        for p in GRID_RANGE:
            place = n * p + 0.4 + 0.2 * p
            k = math.floor(min(max(place, 1), n - 1)) if n > 1 else 1
            yield k, min(max(place - k, 0.0), 1.0)

    def ranks(_, n):
        return [r for k, _ in spots(n) for r in (k - 1, min(k, n - 1))]

    sizes, found = select_ranks(melt_numbers(df, features), ranks)
    grids = {}
    for f in features:
        ends = []
        for k, gamma in spots(sizes[f]):
            low, high = found[f][k - 1][0], found[f][min(k, sizes[f] - 1)][0]
            ends.append((1 - gamma) * low + gamma * high)
        grids[f] = np.linspace(ends[0], ends[1], resolution).tolist()
    return grids


def _grid_table(spark: SparkSession, grids: dict[str, list[float]]) -> DataFrame:
    rows = [(f, float(v)) for f, values in grids.items() for v in values]
    return spark.createDataFrame(rows, "feature string, `values` double")


def forest_dependence(spark: SparkSession, forest: Forest, features: Sequence[str], grids: dict[str, list[float]]) -> DataFrame:
    """Partial dependence of a summed forest, from the training proportions in its nodes."""
    position = {f: i for i, f in enumerate(features)}
    schema = "feature string, `values` double, average double"
    table = _grid_table(spark, grids).repartition(len(grids), "feature")
    total = None
    for part in forest.groups():
        evaluate = _dependence_kernel(spark.sparkContext.broadcast(part), position)
        found = table.groupBy("feature").applyInPandas(evaluate, schema)
        total = found if total is None else total.unionByName(found)
    return total.groupBy("feature", "values").agg(F.sum("average").alias("average"))


def _dependence_kernel(shared, position: dict[str, int]):
    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf["values"].to_numpy(float)
        feature = position[pdf["feature"].iloc[0]]
        each = zip(shared.value.trees, shared.value.weights)
        return pdf.assign(average=sum(w * partial_dependence(t, feature, grid) for t, w in each))

    return evaluate


def linear_dependence(df: DataFrame, features: Sequence[str], coefficients: Sequence[float], intercept: float,
                      grids: dict[str, list[float]]) -> DataFrame:
    """Partial dependence of a linear model: exact from the feature means."""
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in features]).first()
    centre = intercept + sum(w * means[f] for f, w in zip(features, coefficients))
    slope, mean = F.lit(0.0), F.lit(0.0)
    for f, w in zip(features, coefficients):
        slope = F.when(F.col("feature") == f, F.lit(w)).otherwise(slope)
        mean = F.when(F.col("feature") == f, F.lit(means[f])).otherwise(mean)
    table = _grid_table(df.sparkSession, grids)
    return table.withColumn("average", F.lit(centre) + slope * (F.col("values") - mean))


def sweep_dependence(df: DataFrame, forest: Forest, features: Sequence[str], grids: dict[str, list[float]]) -> DataFrame:
    """Partial dependence over the rows themselves; for any combination of trees.

    A task walks the trees once per row and feature and adds up over intervals between thresholds; one sum per grid value
    leaves it.  A summed forest is sent out in parts of bounded size; a median needs all its trees together.
    """
    features = list(features)
    parts = forest.groups() if forest.combine == "sum" else [forest]
    rows = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    total = None
    for part in parts:
        sums = _sweep_kernel(df.sparkSession.sparkContext.broadcast(part), features, grids)
        found = rows.mapInPandas(sums, "feature string, place int, s double, n bigint")
        found = found.groupBy("feature", "place").agg((F.sum("s") / F.sum("n")).alias("part"))
        total = found if total is None else total.unionByName(found)
    values = [(f, i, float(v)) for f, grid in grids.items() for i, v in enumerate(grid)]
    table = df.sparkSession.createDataFrame(values, "feature string, place int, `values` double")
    averages = total.groupBy("feature", "place").agg(F.sum("part").alias("average"))
    return table.join(averages, ["feature", "place"]).select("feature", "values", "average")


def _sweep_kernel(shared, features: list[str], grids: dict[str, list[float]]):
    wanted = {f: np.asarray(grid, float) for f, grid in grids.items()}

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {f: np.zeros(len(grid)) for f, grid in wanted.items()}
        count, held = 0, []

        def add() -> None:
            x = np.concatenate(held)
            for f, grid in wanted.items():
                total[f] += dependence_sums(shared.value, x, features.index(f), grid)
            held.clear()

        for batch in batches:
            held.append(batch[features].to_numpy(float))
            count += len(batch)
            if sum(map(len, held)) >= SWEEP_ROWS:  # a walk costs as much for few rows as for many
                add()
        if held:
            add()
        if count:
            rows = [(f, i, float(s), count) for f in total for i, s in enumerate(total[f])]
            yield pd.DataFrame(rows, columns=["feature", "place", "s", "n"])

    return sums


def dependence(model, df: DataFrame, features: Sequence[str] | None = None, resolution: int = GRID) -> DataFrame:
    """Partial dependence of a fitted model: long ``(feature, values, average)``."""
    grids = feature_grids(df, features or model.features, resolution)
    line = model.linear()
    if line is not None:
        return linear_dependence(df, model.features, line[0], line[1], grids)
    forest = model.as_forest()
    if forest.combine == "sum" and model.model_type != "bagging":
        return forest_dependence(df.sparkSession, forest, model.features, grids)
    return sweep_dependence(df, forest, model.features, grids)


# ---- attributions ----


def shap_values(df: DataFrame, forest: Forest, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Per-row tree attributions as ``keep, base_value, <feature>...``; with the base they add up to the prediction.

    A forest too large for one broadcast is applied part by part, adding up.
    """
    if forest.combine != "sum":
        raise ValueError("attributions need a summed forest; a weighted median does not add up")
    features, keep = list(features), list(keep)
    kinds = dict(df.dtypes)
    base = forest.base_value()
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"`{f}` double" for f in features] +
                       [f"`__phi_{f}` double" for f in features])
    rows = df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features],
                     *[F.lit(0.0).alias(f"__phi_{f}") for f in features])
    for part in forest.groups():
        shared = df.sparkSession.sparkContext.broadcast(part)
        rows = rows.mapInPandas(_attribution_kernel(shared, features), schema)
    return rows.select(*keep, F.lit(base).alias("base_value"), *[F.col(f"__phi_{f}").alias(f) for f in features])


def _attribution_kernel(shared, features: list[str]):
    columns = [f"__phi_{f}" for f in features]

    def applied(batches: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(batches, ignore_index=True)
        x, phi = (np.asfortranarray(rows[c].to_numpy(float)) for c in (features, columns))
        for tree, weight in zip(shared.value.trees, shared.value.weights):
            phi = phi + weight * attributions(tree, x)
        return rows.assign(**dict(zip(columns, phi.T)))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= SWEEP_ROWS:  # what a tree costs for itself is spread over many rows
                yield applied(held)
                held, count = [], 0
        if count:
            yield applied(held)

    return add


def melt_attributions(wide: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Long form (row, feature, value)."""
    return wide.unpivot(list(keep), list(features), "feature", "value")


def shap_summary(long: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature."""
    return long.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs_value"))
