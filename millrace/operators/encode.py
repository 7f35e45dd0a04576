"""Categories and dates as numbers. Maps of categories are DataFrames that join; Spark picks how by their size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dates, finite, is_missing, number, numeric_columns, text_of, value
from .base import BaseEstimator, TransformerMixin
from .quantiles import quantiles


def codes(df: DataFrame, column: str) -> DataFrame:
    """value, code: codes by sorted value from 0. Distinct values only are sorted."""
    from .split import running_count

    return running_count(df.where(~is_missing(df, column)).select(value(df, column).alias("value")).distinct(), "value").withColumnRenamed("before", "code")


class OneHotEncoder(BaseEstimator, TransformerMixin):
    """A 0/1 column for each sorted category, named column_category; unknown ones raise or give zeros."""

    def __init__(self, handle_unknown="error", drop=None, max_categories=10_000):
        self.handle_unknown, self.drop, self.max_categories = handle_unknown, drop, max_categories

    def fit(self, df: DataFrame, features: list[str]) -> "OneHotEncoder":
        self.categories_ = {}
        for c in features:
            found = [r[0] for r in df.select(f"`{c}`").distinct().orderBy(f"`{c}`").limit(self.max_categories + 1).collect()]
            if len(found) > self.max_categories:
                raise ValueError(f"{c} has more than {self.max_categories} categories, each a column")
            self.categories_[c] = found
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        cols = []
        for c, found in self.categories_.items():
            x = F.col(f"`{c}`")
            known = F.coalesce(x.isin([v for v in found if v is not None]), F.lit(False)) | (x.isNull() if None in found else F.lit(False))
            for v in found:
                hit = F.when(x.eqNullSafe(F.lit(v)), 1.0).otherwise(0.0)
                if self.handle_unknown == "error":
                    hit = F.when(known, hit).otherwise(F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), F.coalesce(x.cast("string"), F.lit("null")))).cast("double"))
                cols.append(hit.alias(f"{c}_{v}"))
        return df.select("*", *cols)


class OrdinalEncoder(BaseEstimator, TransformerMixin):
    """The place of a category among the sorted ones; -1 if it is unknown."""

    def fit(self, df: DataFrame, features: list[str]) -> "OrdinalEncoder":
        self.maps_ = {c: codes(df, c) for c in features}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        for i, (c, m) in enumerate(self.maps_.items()):
            named = m.select(F.col("value").alias(f"v_{i}"), F.col("code").alias(f"c_{i}"))
            df = df.join(named, value(df, c) == F.col(f"v_{i}"), "left").withColumn(c, F.coalesce(f"c_{i}", F.lit(-1)).cast("int")).drop(f"v_{i}", f"c_{i}")
        return df


class LabelEncoder(BaseEstimator, TransformerMixin):
    """As OrdinalEncoder for one column, and back; an unknown label is an error."""

    def fit(self, df: DataFrame, column: str) -> "LabelEncoder":
        self.column_, self.map_ = column, codes(df, column)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        m = self.map_.select(F.col("value").alias("v_"), F.col("code").alias("c_"))
        code = F.coalesce(F.col("c_"), F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(f"`{self.column_}`").cast("string"), F.lit("null")))).cast("long")).cast("int")
        return df.join(m, F.col(f"`{self.column_}`") == F.col("v_"), "left").withColumn(self.column_, code).drop("v_", "c_")

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        m = self.map_.select(F.col("value").alias("v_"), F.col("code").alias("c_"))
        return df.join(m, F.col(f"`{self.column_}`") == F.col("c_"), "left").withColumn(self.column_, F.col("v_")).drop("v_", "c_")


class LabelBinarizer(BaseEstimator, TransformerMixin):
    """Two classes are one 0/1 column, more an indicator for each."""

    def fit(self, df: DataFrame, column: str) -> "LabelBinarizer":
        self.column_, self.classes_ = column, [r[0] for r in df.select(f"`{column}`").distinct().orderBy(f"`{column}`").collect()]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        shown = self.classes_[1:] if len(self.classes_) == 2 else self.classes_
        return df.select("*", *[F.when(F.col(f"`{self.column_}`").eqNullSafe(F.lit(v)), 1).otherwise(0).alias(f"{self.column_}_{v}") for v in shown])

    def inverse_transform(self, df: DataFrame, out: str = "label") -> DataFrame:
        ind = [F.col(f"`{self.column_}_{v}`") for v in (self.classes_[1:] if len(self.classes_) == 2 else self.classes_)]
        if len(self.classes_) == 2:
            return df.withColumn(out, F.when(ind[0] > 0.5, F.lit(self.classes_[1])).otherwise(F.lit(self.classes_[0])))
        best = F.greatest(*ind) if len(ind) > 1 else ind[0]
        return df.withColumn(out, F.coalesce(*[F.when(i == best, F.lit(v)) for i, v in zip(ind, self.classes_)]))


class _Lookup(BaseEstimator, TransformerMixin):
    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        for i, (c, (m, default)) in enumerate(self.maps_.items()):
            named = m.select(F.col("k").alias(f"k_{i}"), F.col("e").alias(f"e_{i}"))
            df = df.join(named, text_of(df, c) == F.col(f"k_{i}"), "left").withColumn(c, F.coalesce(f"e_{i}", F.lit(default))).drop(f"k_{i}", f"e_{i}")
        return df


class TargetEncoder(_Lookup):
    """(n x mean + s x whole mean) / (n + s) of the target by category; the whole mean for unseen ones."""

    def __init__(self, columns=None, smoothing=10.0):
        self.columns, self.smoothing = columns, smoothing

    def fit(self, df: DataFrame, features: list[str], target: str) -> "TargetEncoder":
        t = F.col(f"`{target}`").cast("double")
        whole = df.agg(F.avg(t)).first()[0] or 0.0
        self.maps_ = {c: (df.groupBy(text_of(df, c).alias("k")).agg(((F.coalesce(F.sum(t), F.lit(0.0)) + self.smoothing * whole) / (F.count(t) + self.smoothing)).alias("e")), whole) for c in self.columns or features}
        return self


class FrequencyEncoder(_Lookup):
    """Share of a category among all rows; 0 for unseen ones."""

    def __init__(self, columns=None):
        self.columns = columns

    def fit(self, df: DataFrame, features: list[str]) -> "FrequencyEncoder":
        n = df.count() or 1
        self.maps_ = {c: (df.groupBy(text_of(df, c).alias("k")).agg((F.count("*") / n).alias("e")), 0.0) for c in self.columns or features}
        return self


class NumericBinner(BaseEstimator, TransformerMixin):
    """Bins between exact quantiles or equal steps of the finite values; half-open on the right, ends open, missing in the last."""

    def __init__(self, n_bins=5, strategy="quantile"):
        self.n_bins, self.strategy = n_bins, strategy

    def fit(self, df: DataFrame, features: list[str]) -> "NumericBinner":
        steps = [i / self.n_bins for i in range(self.n_bins + 1)]
        x = {c: finite(value(df, c).cast("double")) for c in features}
        row = quantiles(df, x, steps) if self.strategy == "quantile" else df.agg(*[F.array(F.min(x[c]), F.max(x[c])).alias(c) for c in features]).first()
        self.edges_ = {}
        for c in features:
            got = row[c]
            if not got or got[0] is None:
                edges = steps
            elif self.strategy == "quantile":
                edges = sorted(set(got))
            else:
                lo, hi = got
                edges = sorted({lo + (hi - lo) * s for s in steps})
            self.edges_[c] = edges if len(edges) > 1 else [edges[0] - 0.5, edges[0] + 0.5]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        out = {}
        for c, e in self.edges_.items():
            x, last = value(df, c).cast("double"), len(e) - 2
            place = F.lit(0)
            for edge in e[1:-1]:
                place = place + F.when(x >= edge, 1).otherwise(0)
            out[c] = F.when(x.isNull(), F.lit(last)).otherwise(place).cast("int")
        return df.withColumns(out)


class DateFeaturizer(BaseEstimator, TransformerMixin):
    def __init__(self, column, drop_original=True):
        self.column, self.drop_original = column, drop_original

    def fit(self, df: DataFrame, features=None) -> "DateFeaturizer":
        self.fitted_ = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumns(dates(F.col(f"`{self.column}`"), self.column))
        return out.drop(self.column) if self.drop_original else out


def auto_featurize(df: DataFrame, target: str | None = None, date_cols=(), max_onehot: int = 20, keep=()) -> tuple[DataFrame, list[str]]:
    """Numbers with gaps at 0, date parts, and the most frequent categories as 0/1 columns c=k; with the names of the features."""
    from .profile import value_counts

    rest = df.drop(*([target] if target else []), *keep)
    for c in date_cols:
        if c in df.columns:
            df, rest = DateFeaturizer(c).transform(df), DateFeaturizer(c).transform(rest)
    nums = numeric_columns(rest)
    cols = [number(F.col(f"`{c}`")).alias(c) for c in nums]
    for c in rest.columns:
        if c not in nums:
            texts = rest.select(text_of(rest, c).alias(c))
            top = [r["value"] for r in value_counts(texts, c, max_onehot).collect()]
            cols += [F.when(text_of(rest, c) == v, 1.0).otherwise(0.0).alias(f"{c}={v}") for v in top]
            nums = [*nums, *[f"{c}={v}" for v in top]]
    return df.select(*[F.col(f"`{k}`") for k in keep], *cols, *([F.col(f"`{target}`")] if target else [])), nums
