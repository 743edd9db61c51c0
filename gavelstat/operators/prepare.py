"""Cleaning, imputation, encoding and scaling.

``fit`` learns every statistic with a fixed number of passes over a stored cohort,
``Preparation.transform`` applies them.  Training and scoring share one fit, so a new
row gets the same codes, fills and scales as the rows the model saw.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gavelstat.functions import codes as C
from gavelstat.functions.columns import equal_width_bin, severity_weight, to_number
from gavelstat.functions.order_stats import quantiles
from gavelstat.schema import RAW_TARGET, SCALED_COLUMNS, SEVERITY, TARGET, TEXT_NUMBERS
from gavelstat.workspace import materialize

CAP_QUANTILE = 0.99


# ---- single steps ----


def coerce_target(df: DataFrame, raw: str = RAW_TARGET, target: str = TARGET) -> DataFrame:
    """Text amount to number, renamed; what does not parse becomes NULL."""
    return df.withColumn(raw, to_number(F.col(raw))).withColumnRenamed(raw, target)


def quantile_cap(df: DataFrame, column: str = TARGET, q: float = CAP_QUANTILE) -> DataFrame:
    """Rows at or below the exact quantile; missing values drop out."""
    cap = quantiles(df, {column: [q]})[column][q]
    return df.filter(F.col(column) <= F.lit(cap))


def drop_all_null_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with at least one feature present; the target goes with its row."""
    return df.dropna(how="all", subset=list(features))


def array_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]


def drop_array_columns(df: DataFrame) -> DataFrame:
    """Without list-valued columns, told by the schema alone."""
    return df.drop(*array_columns(df))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def partition_by_type(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns first, then the others, each in their own order."""
    body = df.drop(*keep)
    return df.select(*keep, *numeric_columns(body), *categorical_columns(body))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing numbers by the exact median."""
    found = quantiles(df, {c: [0.5] for c in columns})
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(found[c][0.5])) for c in columns})


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill missing labels by the most frequent one, the smallest on ties."""
    top = C.label_summary(C.frequencies(df, columns))
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(top[c].mode)) for c in columns if c in top})


def map_severity(df: DataFrame, column: str = SEVERITY) -> DataFrame:
    return df.withColumn(column, severity_weight(F.col(column)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class LabelEncoder:
    """Fitted label codes: one table over all features, and facts about each."""

    codes: DataFrame
    facts: dict[str, C.LabelInfo]

    def transform(self, df: DataFrame, unseen: str = "error") -> DataFrame:
        present = {f: n for f, n in self.facts.items() if f in df.columns}
        return C.apply_codes(df, self.codes, present, unseen)


def fit_labels(df: DataFrame, columns: Sequence[str]) -> LabelEncoder:
    freq = materialize(C.frequencies(df, columns), "labels")
    return _encoder(freq, C.label_summary(freq))


def _encoder(freq: DataFrame, facts: dict[str, C.LabelInfo]) -> LabelEncoder:
    labels = freq.filter(F.col("value").isNotNull() & F.col("feature").isin(list(facts)))
    codes = materialize(C.rank_codes(labels, {f: info.labels for f, info in facts.items()}), "codes")
    return LabelEncoder(codes, facts)


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes of the sorted distinct labels, in string order ('10' before '2')."""
    return fit_labels(df, columns).transform(df)


def label_encode_new(
    new: DataFrame, encoder: LabelEncoder, columns: Sequence[str], unseen: str = "error"
) -> DataFrame:
    """Fitted codes for new rows; columns without a fitted encoder are fitted on them.

    Missing numbers are filled by the new rows' medians.
    """
    missing = [c for c in columns if c not in encoder.facts]
    if missing:
        new = fit_labels(new, missing).transform(new)
    new = encoder.transform(new, unseen)
    holes = [c for c in numeric_columns(new)]
    return impute_median(new, holes)


def one_hot(df: DataFrame, column: str, form: str = "columns", max_labels: int = 1000) -> DataFrame:
    """One 0/1 column per label, named ``column_label``; a row without a label is 0 in all.

    A table can't have very many columns: more than ``max_labels`` labels are an error.  ``form='map'`` takes any number: one
    map ``column_labels`` from the names that the columns would have to their ones.
    """
    rest = [c for c in df.columns if c != column]
    if form == "map":
        name = F.concat(F.lit(f"{column}_"), F.col(column).cast("string"))
        ones = F.when(F.col(column).isNotNull(), F.create_map(name, F.lit(1)))
        none = F.create_map().cast("map<string,int>")
        return df.select(*rest, F.coalesce(ones, none).alias(f"{column}_labels"))
    if form != "columns":
        raise ValueError(f"unknown form {form!r}; known are columns and map")
    rows = df.filter(F.col(column).isNotNull()).select(column).distinct().limit(max_labels + 1).collect()
    if len(rows) > max_labels:
        raise ValueError(f"{column} has more than {max_labels} labels; ask for form='map'")
    labels = sorted(r[column] for r in rows)
    dummies = [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{column}_{v}") for v in labels]
    return df.select(*rest, *dummies)


def column_moments(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of all ``columns`` in one pass."""
    if not columns:
        return {}
    aggs = [f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    row = df.agg(*aggs).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def _scaled(column: str, mean: float | None, std: float | None):
    if mean is None:
        return F.col(column).cast("double")
    return (F.col(column) - F.lit(mean)) / F.lit(std or 1.0)


def standardize(df: DataFrame, columns: Sequence[str] = SCALED_COLUMNS) -> DataFrame:
    """Zero mean, unit population deviation, for those ``columns`` that are present."""
    moments = column_moments(df, [c for c in columns if c in df.columns])
    return df.withColumns({c: _scaled(c, *m) for c, m in moments.items()})


def scale_by_max(df: DataFrame, column: str = TARGET) -> DataFrame:
    """Divide by the largest value.

    Dividing by the deviation first, as a scaler without centring would, cancels out.
    """
    top = df.agg(F.max(F.col(column).cast("double")).alias("top")).first()["top"]
    return df.withColumn(column, F.col(column) / F.lit(top))


def extent(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    value = F.col(column).cast("double")
    row = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    return row["lo"], row["hi"]


def bin_column(df: DataFrame, column: str, bins: int, name: str = "bin") -> DataFrame:
    """Equal-width interval number over the column's whole range."""
    low, high = extent(df, column)
    if low is None:
        return df.withColumn(name, F.lit(None).cast("int"))
    return df.withColumn(name, equal_width_bin(F.col(column).cast("double"), low, high, bins))


def adaptive_bin(df: DataFrame, column: str, start: int = 10, least: int = 2, name: str = "bin") -> DataFrame:
    """Equal-width intervals, as many (at most ``start``) as leave no occupied one under ``least`` rows.

    All candidate counts are judged in one pass over the data.
    """
    low, high = extent(df, column)
    if low is None:
        raise ValueError(f"{column} has no values to bin")
    value = F.col(column).cast("double")
    candidates = [
        F.struct(F.lit(n).alias("bins"), equal_width_bin(value, low, high, n).alias("bin"))
        for n in range(start, least - 1, -1)
    ]
    fits = (
        df.filter(value.isNotNull())
        .select(F.explode(F.array(*candidates)).alias("c"))
        .groupBy("c.bins", "c.bin")
        .agg(F.count("*").alias("n"))
        .groupBy("bins")
        .agg(F.min("n").alias("fewest"))
        .filter(F.col("fewest") >= least)
        .agg(F.max("bins").alias("bins"))
        .first()["bins"]
    )
    if fits is None:
        raise ValueError(f"cannot form intervals with at least {least} rows each; more rows are needed")
    return df.withColumn("bins", F.lit(fits)).withColumn(name, equal_width_bin(value, low, high, fits))


def separate(df: DataFrame, target: str = TARGET, key: Sequence[str] = (), bins: int | None = None):
    """Features and target as two frames sharing ``key``; the target optionally binned."""
    features = df.drop(target)
    y = bin_column(df, target, bins, target) if bins else df
    return features, y.select(*key, target)


# ---- the whole chain ----


@dataclass(frozen=True)
class Preparation:
    """Everything learned from the training cohort."""

    raw: str
    cap: float
    largest: float
    numeric: list[str]
    categorical: list[str]
    severity: str | None
    medians: dict[str, float]
    modes: dict[str, str]
    encoder: LabelEncoder
    moments: dict[str, tuple[float, float]]
    text_numbers: list[str]
    null_policy: str

    @property
    def features(self) -> list[str]:
        """Numeric columns, then the categorical ones."""
        return self.numeric + self.categorical

    def transform(self, df: DataFrame, keep: Sequence[str] = (), unseen: str = "error", cap: bool = False) -> DataFrame:
        """``keep``, the features and the scaled target; ``cap`` drops rows above the cap."""
        return self._scale(self._encode(self._clean(df, keep, cap), unseen))

    def _clean(self, df: DataFrame, keep: Sequence[str], cap: bool) -> DataFrame:
        has_target = self.raw in df.columns
        target = [to_number(F.col(self.raw)).alias(TARGET)] if has_target else []
        parse = {c: to_number(F.col(c)) for c in self.text_numbers}
        numbers = [
            F.coalesce(parse.get(c, F.col(c).cast("double")), F.lit(self.medians[c]).cast("double")).alias(c)
            for c in self.numeric
        ]
        labels = []
        for c in self.categorical:
            fill = "None" if self.null_policy == "category" else self.modes.get(c)
            label = F.coalesce(F.col(c).cast("string"), F.lit(fill).cast("string"))
            labels.append((severity_weight(label) if c == self.severity else label).alias(c))
        clean = df.select(*[F.col(k) for k in keep], *numbers, *labels, *target)
        return clean.filter(F.col(TARGET) <= F.lit(self.cap)) if cap and has_target else clean

    def _encode(self, df: DataFrame, unseen: str) -> DataFrame:
        return self.encoder.transform(df, unseen)

    def _scale(self, df: DataFrame) -> DataFrame:
        scaled = {c: _scaled(c, *m) for c, m in self.moments.items()}
        if TARGET in df.columns:
            scaled[TARGET] = F.col(TARGET) / F.lit(self.largest)
        return df.withColumns(scaled)


def prepare(
    cohort: DataFrame,
    keep: Sequence[str] = (),
    raw: str = RAW_TARGET,
    scale: Sequence[str] = SCALED_COLUMNS,
    text_numeric: str = "lexical",
    null_policy: str = "impute",
    cap_quantile: float = CAP_QUANTILE,
) -> tuple[DataFrame, Preparation]:
    """Learn the preparation from a stored cohort, and the cohort prepared by it.

    The encoded rows are written once; the scaling learned from them is a projection on top.

    ``text_numeric='lexical'`` keeps numbers stored as text as labels in string order;
    ``'numeric'`` parses them.  ``null_policy='impute'`` fills a missing label by the mode,
    ``'category'`` makes it a label of its own, ``None``.
    """
    body = drop_array_columns(cohort).drop(*keep)
    parsed = [c for c in TEXT_NUMBERS if c in body.columns] if text_numeric == "numeric" else []
    body = coerce_target(body, raw).withColumns({c: to_number(F.col(c)) for c in parsed})
    cap = quantiles(body, {TARGET: [cap_quantile]})[TARGET][cap_quantile]
    if cap is None:
        raise ValueError("the cohort has no amounts to learn from")
    body = body.filter(F.col(TARGET) <= F.lit(cap))
    numeric = [c for c in numeric_columns(body) if c != TARGET]
    categorical = categorical_columns(body)
    severity = SEVERITY if SEVERITY in categorical else None
    found = quantiles(body, {c: [0.5] for c in numeric})
    medians = {c: found[c][0.5] for c in numeric}
    if null_policy == "category":
        body = body.withColumns({c: F.coalesce(F.col(c), F.lit("None")) for c in categorical})
    freq = materialize(C.frequencies(body, categorical), "labels")
    summary = C.label_summary(freq)
    modes = {c: info.mode for c, info in summary.items()}
    encoder = _encoder(freq, {c: info for c, info in summary.items() if c != severity})
    draft = Preparation(
        raw, cap, 1.0, numeric, categorical, severity, medians, modes, encoder, {}, parsed, null_policy
    )
    encoded = materialize(draft.transform(cohort, keep, cap=True), "encoded")
    present = [c for c in scale if c in draft.features]
    aggs = [F.max(TARGET).alias("largest")]
    for c in present:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = encoded.agg(*aggs).first()
    moments = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in present}
    learned = replace(draft, largest=row["largest"], moments=moments)
    return learned._scale(encoded), learned


def fit(cohort: DataFrame, keep: Sequence[str] = (), **options) -> Preparation:
    """Learn the preparation alone."""
    return prepare(cohort, keep, **options)[1]
