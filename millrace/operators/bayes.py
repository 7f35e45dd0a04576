"""Naive Bayes from one grouped aggregation of sufficient statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import vector
from .linear import _Classifier


def class_sums(df: DataFrame, features, label: str) -> DataFrame:
    """label, i, n, s, ss: count, sum and sum of squares of each feature by class."""
    x = df.select(F.col(f"`{label}`").alias("label"), F.posexplode(vector(features)).alias("i", "x"))
    return x.groupBy("label", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))


def gaussian_stats(df: DataFrame, features, label: str) -> DataFrame:
    """label, i, mean, var (population)."""
    x = df.select(F.col(f"`{label}`").alias("label"), F.posexplode(vector(features)).alias("i", "x"))
    return x.groupBy("label", "i").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var"))


class _NB(_Classifier):
    def _table(self, df, features, label):
        self._classes(df, features, label)
        g = class_sums(df, features, label).toPandas()  # classes x features
        k = {c: i for i, c in enumerate(self.classes_)}
        d = int(g["i"].max()) + 1
        out = np.zeros((3, len(k), d))
        for name, a in zip(("n", "s", "ss"), out):
            a[[k[x] for x in g["label"]], g["i"]] = g[name]
        self.class_count_ = out[0][:, 0]
        return out

    def _proba(self, x):
        z = self._joint(x)
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _prior(self, fit_prior=True, prior=None):
        if prior is not None:
            return np.log(np.asarray(prior, float))
        return np.log(self.class_count_ / self.class_count_.sum()) if fit_prior else np.full(len(self.classes_), -np.log(len(self.classes_)))


class GaussianNB(_NB):
    def __init__(self, priors=None, var_smoothing=1e-9):
        self.priors, self.var_smoothing = priors, var_smoothing

    def fit(self, df, features, label):
        self._table(df, features, label)
        g = gaussian_stats(df, features, label).toPandas()
        k = {c: i for i, c in enumerate(self.classes_)}
        self.theta_, self.var_ = np.zeros((len(k), g["i"].max() + 1)), np.zeros((len(k), g["i"].max() + 1))
        at = ([k[x] for x in g["label"]], g["i"])
        self.theta_[at], self.var_[at] = g["mean"], g["var"]
        whole = df.select(F.posexplode(vector(features)).alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("v")).agg(F.max("v")).first()[0]
        self.var_ = self.var_ + self.var_smoothing * max(whole, 1e-300)
        self.prior_ = self._prior(prior=self.priors)
        return self

    def _joint(self, x):
        return np.stack([p - 0.5 * (np.log(2 * np.pi * v).sum() + ((x - m) ** 2 / v).sum(1)) for p, m, v in zip(self.prior_, self.theta_, self.var_)], 1)


class MultinomialNB(_NB):
    def __init__(self, alpha=1.0, fit_prior=True, class_prior=None):
        self.alpha, self.fit_prior, self.class_prior = alpha, fit_prior, class_prior

    def fit(self, df, features, label):
        s = self._table(df, features, label)[1] + self.alpha
        self.feature_log_prob_ = np.log(s) - np.log(s.sum(1, keepdims=True))
        self.prior_ = self._prior(self.fit_prior, self.class_prior)
        return self

    def _joint(self, x):
        return x @ self.feature_log_prob_.T + self.prior_


class ComplementNB(MultinomialNB):
    """Weights of a class come from all the others; the class that resembles its complement least wins."""

    def fit(self, df, features, label):
        s = self._table(df, features, label)[1]
        c = s.sum(0) - s + self.alpha
        self.feature_log_prob_ = -(np.log(c) - np.log(c.sum(1, keepdims=True)))
        self.prior_ = np.zeros(len(self.classes_))
        return self


class BernoulliNB(MultinomialNB):
    def __init__(self, alpha=1.0, binarize=0.0, fit_prior=True, class_prior=None):
        super().__init__(alpha, fit_prior, class_prior)
        self.binarize = binarize

    def fit(self, df, features, label):
        t = self.binarize
        ones = df.withColumn("b_", F.transform(vector(features), lambda x: F.when(x > t, 1.0).otherwise(0.0)) if t is not None else vector(features))
        s = self._table(ones, "b_", label)[1]
        self.features_ = features
        p = (s + self.alpha) / (self.class_count_[:, None] + 2 * self.alpha)
        self.feature_log_prob_, self.negative_ = np.log(p), np.log(1 - p)
        self.prior_ = self._prior(self.fit_prior, self.class_prior)
        return self

    def _joint(self, x):
        b = (x > self.binarize).astype(float) if self.binarize is not None else x
        return b @ (self.feature_log_prob_ - self.negative_).T + self.negative_.sum(1) + self.prior_
