"""Cleaning, imputing and scaling: fit is one or two aggregations, transform a projection."""

from __future__ import annotations

from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clip, finite, is_missing, numeric_columns, value
from .base import BaseEstimator, TransformerMixin
from .quantiles import mode, quantiles


def _first_row(df: DataFrame, aggs: dict) -> dict:
    return df.agg(*[c.alias(k) for k, c in aggs.items()]).first().asDict() if aggs else {}


def _lit(v, df: DataFrame, c: str):
    return F.lit(v).cast(df.schema[c].dataType)


class DataCleaner(BaseEstimator, TransformerMixin):
    """Duplicates go, gaps are filled, outliers clipped, infinities filled, constant columns dropped; in this order.

    Fills are medians or means of numbers and the least most frequent value of the rest
    (``missing``: median, mean, most_frequent, constant; others act as median). Bounds are
    those of the filled table, duplicates included.
    """

    def __init__(self, missing="median", fill_value=0, drop_dupes=True, drop_constants=True, outlier_clip=None, z_thresh=3.0, iqr_k=1.5):
        self.missing, self.fill_value, self.drop_dupes, self.drop_constants = missing, fill_value, drop_dupes, drop_constants
        self.outlier_clip, self.z_thresh, self.iqr_k = outlier_clip, z_thresh, iqr_k

    def fit(self, df: DataFrame) -> "DataCleaner":
        self.numeric_ = numeric_columns(df, with_bool=True)
        aggs, fills, halves = {}, {}, {}
        for i, c in enumerate(df.columns):
            x = value(df, c)
            if self.missing == "most_frequent" or c not in self.numeric_ and self.missing != "constant":
                fills[c] = mode(df, x)
            elif self.missing == "mean":
                aggs[f"f{i}"] = F.avg(x.cast("double"))
            elif self.missing != "constant":
                halves[c] = x
            if self.drop_constants:  # it varies if its extremes differ, or if some values are missing and some are not
                aggs[f"d{i}"] = F.coalesce(F.min(x) != F.max(x), F.lit(False)) | ((F.count(x) > 0) & (F.count(x) < F.count(F.lit(1))))
        got = _first_row(df, aggs)
        fills |= {c: q and q[0] for c, q in quantiles(df, halves, [0.5]).items()} | {c: got[f"f{i}"] for i, c in enumerate(df.columns) if f"f{i}" in got}
        self.fill_ = {c: self.fill_value if fills.get(c) is None else fills[c] for c in df.columns}
        self.constant_ = [c for i, c in enumerate(df.columns) if self.drop_constants and not got[f"d{i}"]]
        self.bounds_ = {}
        if self.outlier_clip in ("zscore", "iqr"):
            filled, aggs = self._filled(df), {}
            for i, c in enumerate(self.numeric_):
                x = F.col(f"`{c}`").cast("double")
                if self.outlier_clip == "zscore":
                    aggs[f"m{i}"], aggs[f"s{i}"] = F.avg(x), F.stddev_pop(x)
            got = _first_row(filled, aggs) if aggs else {f"q{i}": q for i, q in enumerate(quantiles(filled, {c: F.col(f"`{c}`") for c in self.numeric_}, [0.25, 0.75]).values())}
            for i, c in enumerate(self.numeric_):
                if self.outlier_clip == "zscore" and got[f"m{i}"] is not None:
                    half = self.z_thresh * (got[f"s{i}"] or 1.0)
                    self.bounds_[c] = (got[f"m{i}"] - half, got[f"m{i}"] + half)
                elif self.outlier_clip == "iqr" and got[f"q{i}"]:
                    q1, q3 = got[f"q{i}"]
                    self.bounds_[c] = (q1 - self.iqr_k * (q3 - q1), q3 + self.iqr_k * (q3 - q1))
        return self

    def _fill(self, df: DataFrame, c: str):
        v = self.fill_[c]
        whole = c in self.numeric_ and isinstance(v, float) and not v.is_integer() and not isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType, T.DecimalType))
        return F.coalesce(value(df, c).cast("double"), F.lit(v)) if whole else F.coalesce(value(df, c), _lit(v, df, c))

    def _filled(self, df: DataFrame) -> DataFrame:
        return df.select(*[self._fill(df, c).alias(c) if c in self.fill_ else F.col(f"`{c}`") for c in df.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        out = self._filled(df.dropDuplicates() if self.drop_dupes else df)
        cols = []
        for c in out.columns:
            if c in self.constant_:
                continue
            x = F.col(f"`{c}`")
            if c in self.bounds_:
                x = clip(x.cast("double"), *self.bounds_[c])
            if isinstance(out.schema[c].dataType, (T.DoubleType, T.FloatType)):
                x = F.coalesce(finite(x), F.lit(self.fill_[c]).cast("double"))
            cols.append(x.alias(c))
        return out.select(*cols)


class SimpleImputer(BaseEstimator, TransformerMixin):
    """Missing values become the column's mean, exact median, least most frequent value or a constant; 0 where nothing is known."""

    def __init__(self, strategy="mean", fill_value=None, missing_values=None):
        self.strategy, self.fill_value, self.missing_values = strategy, fill_value, missing_values

    def _seen(self, df: DataFrame, c: str):
        v = value(df, c)
        return v if self.missing_values is None else F.when(v != F.lit(self.missing_values), v)

    def fit(self, df: DataFrame, features: list[str]) -> "SimpleImputer":
        if self.strategy == "constant":
            self.statistics_ = {c: self.fill_value for c in features}
        else:
            seen = {c: self._seen(df, c) for c in features}
            if self.strategy == "mean":
                got = _first_row(df, {c: F.avg(x) for c, x in seen.items()})
            elif self.strategy == "median":
                got = {c: q and q[0] for c, q in quantiles(df, seen, [0.5]).items()}
            else:
                got = {c: mode(df, x) for c, x in seen.items()}
            self.statistics_ = {c: 0 if v is None else v for c, v in got.items()}
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        return df.withColumns({c: F.coalesce(self._seen(df, c), F.lit(v)) for c, v in self.statistics_.items()})


class _Scaler(BaseEstimator, TransformerMixin):
    """x -> (x - shift) / scale by column, and back."""

    def fit(self, df: DataFrame, features: list[str]):
        self.features_ = list(features)
        got = _first_row(df, {f"{k}|{c}": e for c in features for k, e in self._stats(value(df, c).cast("double")).items()})
        self.shift_, self.scale_ = {}, {}
        for c in features:
            self.shift_[c], self.scale_[c] = self._rule({k: got[f"{k}|{c}"] for k in self._stats(F.lit(0.0))})
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        self._check_fitted()
        return df.withColumns({c: (value(df, c).cast("double") - self.shift_[c]) / self.scale_[c] for c in self.features_})

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(f"`{c}`") * self.scale_[c] + self.shift_[c] for c in self.features_})


class StandardScaler(_Scaler):
    """Population deviation; a constant column is only centred."""

    def __init__(self, with_mean=True, with_std=True):
        self.with_mean, self.with_std = with_mean, with_std

    def _stats(self, x):
        return {"m": F.avg(x), "s": F.stddev_pop(x)}

    def _rule(self, s):
        return (s["m"] or 0.0) if self.with_mean else 0.0, (s["s"] or 1.0) if self.with_std else 1.0


class MinMaxScaler(_Scaler):
    """To a range; a constant column maps to its lower end."""

    def __init__(self, feature_range=(0, 1)):
        self.feature_range = feature_range

    def _stats(self, x):
        return {"lo": F.min(x), "hi": F.max(x)}

    def _rule(self, s):
        lo, hi = self.feature_range
        low = s["lo"] or 0.0
        width = ((s["hi"] or 0.0) - low) or 1.0
        scale = width / ((hi - lo) or 1.0)
        return low - lo * scale, scale


class MaxAbsScaler(_Scaler):
    def _stats(self, x):
        return {"m": F.max(F.abs(x))}

    def _rule(self, s):
        return 0.0, max(s["m"] or 0.0, 1e-12)


class RobustScaler(_Scaler):
    """Exact median and distance of quantiles; 1 where that is 0."""

    def __init__(self, with_centering=True, with_scaling=True, quantile_range=(25.0, 75.0)):
        self.with_centering, self.with_scaling, self.quantile_range = with_centering, with_scaling, quantile_range

    def fit(self, df: DataFrame, features: list[str]):
        self.features_, self.shift_, self.scale_ = list(features), {}, {}
        found = quantiles(df, {c: value(df, c).cast("double") for c in features}, [0.5, *[q / 100 for q in self.quantile_range]])
        for c in features:
            mid, lo, hi = found[c] or (0.0, 0.0, 1.0)
            self.shift_[c] = mid if self.with_centering else 0.0
            self.scale_[c] = ((hi - lo) or 1.0) if self.with_scaling else 1.0
        return self


class Normalizer(BaseEstimator, TransformerMixin):
    """Rows of length 1 by l1, l2 or max; works on columns or on one array column."""

    def __init__(self, norm="l2"):
        self.norm = norm

    def fit(self, df: DataFrame, features) -> "Normalizer":
        self.features_ = features
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from .base import vector

        v = vector(self.features_)
        add = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
        size = {"l1": lambda: add(v, F.abs), "l2": lambda: F.sqrt(add(v, lambda x: x * x)), "max": lambda: F.array_max(F.transform(v, F.abs))}[self.norm]()
        size = F.greatest(size, F.lit(1e-12))
        if isinstance(self.features_, str):
            return df.withColumn(self.features_, F.transform(v, lambda x: x / size))
        return df.withColumns({c: F.col(f"`{c}`").cast("double") / size for c in self.features_})


class Binarizer(BaseEstimator, TransformerMixin):
    """1.0 above the threshold, else 0.0."""

    def __init__(self, threshold=0.0):
        self.threshold = threshold

    def fit(self, df: DataFrame, features: list[str]) -> "Binarizer":
        self.features_ = list(features)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.when(F.col(f"`{c}`") > self.threshold, 1.0).otherwise(0.0) for c in self.features_})


class PolynomialFeatures(BaseEstimator, TransformerMixin):
    """Bias, then products of the columns by degree, in the order of combinations; named p0, p1, ..."""

    def __init__(self, degree=2, include_bias=True, interaction_only=False):
        self.degree, self.include_bias, self.interaction_only = degree, include_bias, interaction_only

    def fit(self, df: DataFrame, features: list[str]) -> "PolynomialFeatures":
        pick = combinations if self.interaction_only else combinations_with_replacement
        self.terms_ = [()] * self.include_bias + [t for d in range(1, self.degree + 1) for t in pick(features, d)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        def product(t):
            out = F.lit(1.0)
            for c in t:
                out = out * F.col(f"`{c}`").cast("double")
            return out

        return df.select("*", *[product(t).alias(f"p{i}") for i, t in enumerate(self.terms_)])


def add_dummy_feature(df: DataFrame, value_: float = 1.0, name: str = "dummy") -> DataFrame:
    return df.withColumn(name, F.lit(float(value_)))


def scale(df, features, **kw):
    return StandardScaler(**kw).fit_transform(df, features)


def minmax_scale(df, features, **kw):
    return MinMaxScaler(**kw).fit_transform(df, features)


def robust_scale(df, features, **kw):
    return RobustScaler(**kw).fit_transform(df, features)


def normalize(df, features, norm="l2"):
    return Normalizer(norm).fit_transform(df, features)


def binarize(df, features, threshold=0.0):
    return Binarizer(threshold).fit_transform(df, features)


class KNNImputer(BaseEstimator, TransformerMixin):
    """Gaps become the mean of the nearest fitted rows that know the value.

    Distances are taken with gaps at the column means. All gaps are filled from the fitted
    rows, none from values filled before. Rows with gaps meet the fitted rows block by block.
    """

    def __init__(self, n_neighbors=5, weights="uniform"):
        self.n_neighbors, self.weights = n_neighbors, weights

    def fit(self, df: DataFrame, features: list[str]) -> "KNNImputer":
        self.features_ = list(features)
        got = _first_row(df, {c: F.avg(value(df, c).cast("double")) for c in features})
        self.means_ = {c: v or 0.0 for c, v in got.items()}
        self.fitted_ = df.select(*[value(df, c).cast("double").alias(c) for c in features])
        return self

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """``key`` tells the rows of ``df`` apart."""
        from .neighbors import nearest

        dense = lambda d: F.array(*[F.coalesce(value(d, c).cast("double"), F.lit(self.means_[c])) for c in self.features_])
        out = df
        for c in self.features_:
            gaps = df.where(is_missing(df, c)).select(F.col(f"`{key}`").alias("qid"), dense(df).alias("q"))
            known = self.fitted_.where(F.col(f"`{c}`").isNotNull()).select(F.struct(*[F.col(f"`{x}`") for x in self.features_]).alias("s"), dense(self.fitted_).alias("v"), F.col(f"`{c}`").alias("y")).select(F.xxhash64("s").alias("id"), "v", "y")
            near = nearest(known, gaps, self.n_neighbors, carry="y")
            w = F.lit(1.0) if self.weights == "uniform" else 1 / F.greatest("distance", F.lit(1e-12))
            fill = near.groupBy("qid").agg((F.sum(F.col("y") * w) / F.sum(w)).alias("fill_")).withColumnRenamed("qid", "q_")
            cols = [F.coalesce(value(out, c).cast("double"), F.col("fill_"), F.lit(self.means_[c])).alias(c) if x == c else F.col(f"`{x}`") for x in df.columns]
            out = out.join(fill, F.col(f"`{key}`") == F.col("q_"), "left").select(*cols)
        return out
