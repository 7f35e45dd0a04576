"""Scores of features and selection by them: group sums in Spark, distributions in closed form on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BaseEstimator, TransformerMixin, clone, vector
from .bayes import class_sums


def _survival(spark, kind: str, x: float, *dof: float) -> float:
    """P(X > x) of chi squared or F, by commons-math."""
    if not np.isfinite(x):
        return 0.0 if x > 0 else float("nan")
    d = spark.sparkContext._jvm.org.apache.commons.math3.distribution
    return 1.0 - (d.ChiSquaredDistribution if kind == "chi2" else d.FDistribution)(*[float(v) for v in dof]).cumulativeProbability(float(x))


def chi2_df(df: DataFrame, features, label: str) -> DataFrame:
    """i, chi2: of class sums of each feature against those that class sizes lead to expect."""
    g = class_sums(df, features, label)
    n = g.groupBy("i").agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    e = F.col("n") / F.col("all_n") * F.col("all_s")
    return g.join(F.broadcast(n), "i").groupBy("i").agg(F.sum(F.coalesce(F.try_divide((F.col("s") - e) ** 2, e), F.lit(0.0))).alias("chi2"))


def f_classif_df(df: DataFrame, features, label: str) -> DataFrame:
    """i, f, dfb, dfw: one-way analysis of variance."""
    x = df.select(F.col(f"`{label}`").alias("label"), F.posexplode(vector(features)).alias("i", "x"))
    g = x.groupBy("i", "label").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    w = g.groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    r = g.join(F.broadcast(w), "i").groupBy("i").agg(F.sum(F.col("n") * (F.col("m") - F.col("mean")) ** 2).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), (F.count("*") - 1).alias("dfb"), (F.sum("n") - F.count("*")).alias("dfw"))
    return r.select("i", F.try_divide(F.col("b") / F.col("dfb"), F.col("w") / F.col("dfw")).alias("f"), "dfb", "dfw")


def f_regression_df(df: DataFrame, features, label: str) -> DataFrame:
    """i, f, dof: of the correlation with the target."""
    x = df.select(F.col(f"`{label}`").cast("double").alias("y"), F.posexplode(vector(features)).alias("i", "x"))
    r = x.groupBy("i").agg(F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"), (F.count("*") - 2).alias("dof"))
    return r.select("i", F.try_divide(F.col("r") ** 2 * F.col("dof"), 1 - F.col("r") ** 2).alias("f"), "dof")


def _ordered(df: DataFrame):
    return df.orderBy("i").toPandas()  # a row for each feature


def chi2(df, features, label):
    got = _ordered(chi2_df(df, features, label))
    k = df.select(f"`{label}`").distinct().count()
    return got["chi2"].to_numpy(), np.asarray([_survival(df.sparkSession, "chi2", x, max(k - 1, 1)) for x in got["chi2"]])


def f_classif(df, features, label):
    got = _ordered(f_classif_df(df, features, label))
    f = got["f"].fillna(np.inf).to_numpy()
    return f, np.asarray([_survival(df.sparkSession, "f", x, b, w) for x, b, w in zip(f, got["dfb"], got["dfw"])])


def f_regression(df, features, label):
    got = _ordered(f_regression_df(df, features, label))
    f = got["f"].fillna(0.0).to_numpy()
    return f, np.asarray([_survival(df.sparkSession, "f", x, 1, d) for x, d in zip(f, got["dof"])])


def mutual_info_classif(df, features, label, n_bins=10):
    """Mutual information with each feature cut at its quantiles (nats)."""
    from .encode import NumericBinner
    from .metrics import mutual_info_score

    binned = NumericBinner(n_bins).fit(df, list(features)).transform(df)
    return np.asarray([mutual_info_score(binned, c, label) for c in features])


class _Selector(BaseEstimator, TransformerMixin):
    def get_support(self) -> list[str]:
        self._check_fitted()
        return list(self.selected_)

    def transform(self, df: DataFrame) -> DataFrame:
        """Selected columns in order of the selection, then all that were no features."""
        return df.select(*[F.col(f"`{c}`") for c in self.get_support()], *[F.col(f"`{c}`") for c in df.columns if c not in self.all_])


class SelectKBest(_Selector):
    """Best scores first."""

    def __init__(self, score_func=f_classif, k=10):
        self.score_func, self.k = score_func, k

    def fit(self, df, features, label):
        got = self.score_func(df, features, label)
        self.scores_, self.pvalues_ = (got, None) if isinstance(got, np.ndarray) else got
        self.all_ = list(features)
        s = np.nan_to_num(np.asarray(self.scores_, float), nan=-np.inf)
        self.selected_ = [features[i] for i in np.argsort(-s, kind="stable")[: self._count(len(features))]]
        return self

    def _count(self, d):
        return d if self.k == "all" else min(self.k, d)


class SelectPercentile(SelectKBest):
    def __init__(self, score_func=f_classif, percentile=10):
        self.score_func, self.percentile = score_func, percentile

    def _count(self, d):
        return max(1, int(d * self.percentile / 100))


class VarianceThreshold(_Selector):
    """Population variance above the threshold."""

    def __init__(self, threshold=0.0):
        self.threshold = threshold

    def fit(self, df, features, label=None):
        row = df.agg(*[F.var_pop(F.col(f"`{c}`").cast("double")).alias(c) for c in features]).first()
        self.all_, self.variances_ = list(features), [row[c] or 0.0 for c in features]
        self.selected_ = [c for c, v in zip(features, self.variances_) if v > self.threshold]
        return self


def importances(est) -> np.ndarray:
    if hasattr(est, "coef_"):
        c = np.abs(np.asarray(est.coef_))
        return c if c.ndim == 1 else c.mean(0)
    return np.asarray(est.feature_importances_)


class SelectFromModel(_Selector):
    def __init__(self, estimator=None, threshold="mean"):
        self.estimator, self.threshold = estimator, threshold

    def fit(self, df, features, label):
        self.estimator_ = clone(self.estimator).fit(df, features, label)
        w = importances(self.estimator_)
        t = {"mean": w.mean(), "median": np.median(w)}.get(self.threshold, self.threshold) if isinstance(self.threshold, str) else self.threshold
        self.all_, self.selected_ = list(features), [c for c, v in zip(features, w) if v >= t]
        return self


class RFE(_Selector):
    """Fit, drop the least important, fit again."""

    def __init__(self, estimator=None, n_features_to_select=None, step=1):
        self.estimator, self.n_features_to_select, self.step = estimator, n_features_to_select, step

    def fit(self, df, features, label):
        left, want = list(features), self.n_features_to_select or max(1, len(features) // 2)
        self.all_, self.ranking_ = list(features), {}
        while True:
            self.estimator_ = clone(self.estimator).fit(df, left, label)
            if len(left) <= want:
                break
            drop = np.argsort(importances(self.estimator_), kind="stable")[: min(self.step, len(left) - want)]
            for i in drop:
                self.ranking_[left[i]] = len(left) - want + 1
            left = [c for i, c in enumerate(left) if i not in set(drop)]
        self.ranking_ |= {c: 1 for c in left}
        self.selected_ = left
        return self
