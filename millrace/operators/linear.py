"""Linear models. Least squares needs one pass for the Gram matrix and a small solve; the rest is MLlib or averaged passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BaseEstimator, ClassifierMixin, RegressorMixin, matrix, moments, scored, vector


def nnls(gram: np.ndarray, target: np.ndarray, tol: float = 1e-10) -> np.ndarray:
    """Least squares with x >= 0 from normal equations, by active sets."""
    d = len(target)
    x, passive = np.zeros(d), np.zeros(d, bool)
    for _ in range(10 * d + 10):
        slope = target - gram @ x
        slope[passive] = -np.inf
        j = int(np.argmax(slope))
        if passive.all() or slope[j] <= tol * max(1.0, np.abs(target).max()):
            break
        passive[j] = True
        while True:
            z = np.zeros(d)
            z[passive] = np.linalg.lstsq(gram[np.ix_(passive, passive)], target[passive], rcond=None)[0]
            if (z[passive] > 0).all():
                x = z
                break
            bad = passive & (z <= 0)
            step = (x[bad] / (x[bad] - z[bad])).min()
            x = x + step * (z - x)
            passive &= x > 1e-14
            x[~passive] = 0
    return x


class _Linear(BaseEstimator, RegressorMixin):
    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        self._check_fitted()
        v, w = vector(self.features_), F.array(*[F.lit(float(c)) for c in self.coef_])
        return df.withColumn(out, F.aggregate(F.zip_with(v, w, lambda a, b: a * b), F.lit(float(self.intercept_)), lambda s, x: s + x))

    def _moments(self, df, features, label, weight=None):
        """n, means and centred Gram matrix of features and label; two passes, so large means cost no digits."""
        self.features_, self.label_ = features, label
        n, s, _ = moments(df, features, label, weight=weight)
        mean = s / n
        center = mean if getattr(self, "fit_intercept", True) else np.zeros_like(mean)
        _, _, g = moments(df, features, label, weight=weight, center=center)
        return n, mean, g[:-1, :-1], g[:-1, -1], g[-1, -1]

    def _set(self, coef, mean):
        self.coef_ = np.asarray(coef, float)
        self.intercept_ = float(mean[-1] - mean[:-1] @ self.coef_) if getattr(self, "fit_intercept", True) else 0.0
        return self


class LinearRegression(_Linear):
    def __init__(self, fit_intercept=True, positive=False):
        self.fit_intercept, self.positive = fit_intercept, positive

    def fit(self, df, features, label, weight=None):
        _, mean, g, t, _ = self._moments(df, features, label, weight)
        return self._set(nnls(g, t) if self.positive else np.linalg.lstsq(g, t, rcond=None)[0], mean)


class Ridge(_Linear):
    def __init__(self, alpha=1.0, fit_intercept=True):
        self.alpha, self.fit_intercept = alpha, fit_intercept

    def fit(self, df, features, label, weight=None):
        _, mean, g, t, _ = self._moments(df, features, label, weight)
        return self._set(np.linalg.solve(g + self.alpha * np.eye(len(g)), t) if self.alpha > 0 else np.linalg.lstsq(g, t, rcond=None)[0], mean)


class ElasticNet(_Linear):
    """Coordinate descent on the Gram matrix: rows are read once, whatever the number of rounds.

    ``scaled`` penalises coefficients of columns brought to length 1, with the penalty times
    the number of rows; else the penalty is that of the mean squared error.
    """

    def __init__(self, alpha=1.0, l1_ratio=0.5, fit_intercept=True, max_iter=1000, tol=1e-4, scaled=False):
        self.alpha, self.l1_ratio, self.fit_intercept, self.max_iter, self.tol, self.scaled = alpha, l1_ratio, fit_intercept, max_iter, tol, scaled

    def fit(self, df, features, label, weight=None):
        n, mean, g, t, _ = self._moments(df, features, label, weight)
        size = np.sqrt(np.maximum(np.diag(g), 1e-300)) if self.scaled else np.ones(len(g))
        q, c = g / np.outer(size, size), t / size
        l1, l2 = self.alpha * self.l1_ratio * n, self.alpha * (1 - self.l1_ratio) * n
        w = np.zeros(len(c))
        for _ in range(self.max_iter):
            most = 0.0
            for j in range(len(w)):
                rho = c[j] - q[j] @ w + q[j, j] * w[j]
                new = np.sign(rho) * max(abs(rho) - l1, 0) / (q[j, j] + l2) if q[j, j] + l2 > 0 else 0.0
                most, w[j] = max(most, abs(new - w[j])), new
            if most <= self.tol * max(1e-12, np.abs(w).max(initial=0.0)):
                break
        self.n_iter_ = _ + 1
        return self._set(w / size, mean)


class Lasso(ElasticNet):
    def __init__(self, alpha=1.0, fit_intercept=True, max_iter=1000, tol=1e-4, scaled=True):
        super().__init__(alpha, 1.0, fit_intercept, max_iter, tol, scaled)


class BayesianRidge(_Linear):
    """Evidence iteration on the Gram matrix of one fit."""

    def __init__(self, max_iter=300, tol=1e-8):
        self.max_iter, self.tol = max_iter, tol

    def fit(self, df, features, label, weight=None):
        n, mean, g, t, yy = self._moments(df, features, label, weight)
        values, basis = np.linalg.eigh(g)
        values = np.maximum(values, 0)
        beta, lam, w = n / max(yy, 1e-12), 1.0, np.zeros(len(t))
        for _ in range(self.max_iter):
            new = basis @ ((basis.T @ t) * beta / (lam + beta * values))
            gamma = float((beta * values / (lam + beta * values)).sum())
            sse = max(float(yy - 2 * new @ t + new @ g @ new), 1e-12)
            lam, beta = gamma / max(float(new @ new), 1e-12), max(n - gamma, 1e-12) / sse
            done = np.abs(new - w).max(initial=0.0) < self.tol
            w = new
            if done:
                break
        self.alpha_, self.lambda_ = beta, lam
        return self._set(w, mean)


class _Classifier(BaseEstimator, ClassifierMixin):
    """Keeps the sorted classes; labels become 0, 1, .. by a CASE over them."""

    def _classes(self, df: DataFrame, features, label: str) -> DataFrame:
        self.features_, self.label_ = features, label
        self.classes_ = [r[0] for r in df.select(f"`{label}`").where(F.col(f"`{label}`").isNotNull()).distinct().orderBy(f"`{label}`").collect()]
        return df.withColumn("y_", self._code(F.col(f"`{label}`")))

    def _code(self, c):
        return F.coalesce(*[F.when(c == F.lit(v), float(i)) for i, v in enumerate(self.classes_)])

    def _label(self, code):
        return F.element_at(F.array(*[F.lit(v) for v in self.classes_]), code.cast("int") + 1)

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Adds ``probability``: array of doubles in the order of ``classes_``."""
        self._check_fitted()
        return scored(df, self.features_, self._proba, "probability", "array<double>")

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        p = self.predict_proba(df)
        best = F.array_position("probability", F.array_max("probability")) - 1
        return p.withColumn(out, self._label(best)).drop("probability")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def assembled(df: DataFrame, features, out: str = "features_") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn(out, array_to_vector(vector(features)))


class LogisticRegression(_Classifier):
    """L2 (1 / C in all), or none. More than two classes: one against the rest, scores by softmax."""

    def __init__(self, penalty="l2", C=1.0, max_iter=100, tol=1e-8, fit_intercept=True):
        self.penalty, self.C, self.max_iter, self.tol, self.fit_intercept = penalty, C, max_iter, tol, fit_intercept

    def fit(self, df, features, label, weight=None):
        from pyspark.ml.classification import LogisticRegression as Fit

        data = assembled(self._classes(df, features, label), features).select("features_", "y_", *([F.col(f"`{weight}`").alias("w_")] if weight else [])).cache()
        reg = 0.0 if self.penalty in (None, "none") or len(self.classes_) < 2 else 1 / (self.C * max(1, data.count()))
        rows = []
        for k in range(len(self.classes_) if len(self.classes_) > 2 else 1):
            one = data.withColumn("t_", (F.col("y_") == k).cast("double") if len(self.classes_) > 2 else F.col("y_"))
            m = Fit(featuresCol="features_", labelCol="t_", maxIter=self.max_iter, tol=self.tol, regParam=reg, elasticNetParam=1.0 if self.penalty == "l1" else 0.0, standardization=False, fitIntercept=self.fit_intercept, family="binomial", **({"weightCol": "w_"} if weight else {})).fit(one)
            rows.append((m.coefficients.toArray(), m.intercept))
        data.unpersist()
        self.coef_, self.intercept_ = np.asarray([r[0] for r in rows]), np.asarray([r[1] for r in rows])
        return self

    def _scores(self, x):
        return x @ self.coef_.T + self.intercept_

    def _proba(self, x):
        z = self._scores(x)
        if len(self.classes_) > 2:
            return softmax(z)
        p = sigmoid(z[:, 0])
        return np.stack([1 - p, p], 1)

    def decision_function(self, df, out="decision"):
        return scored(df, self.features_, lambda x: self._scores(x)[:, 0] if len(self.classes_) < 3 else self._scores(x), out, "double" if len(self.classes_) < 3 else "array<double>")


class RidgeClassifier(_Classifier):
    """Ridge on targets of -1 and 1; the largest score wins."""

    def __init__(self, alpha=1.0):
        self.alpha = alpha

    def fit(self, df, features, label):
        data = self._classes(df, features, label)
        picks = range(len(self.classes_)) if len(self.classes_) > 2 else [1]
        models = [Ridge(self.alpha).fit(data.withColumn("t_", F.when(F.col("y_") == k, 1.0).otherwise(-1.0)), features, "t_") for k in picks]
        self.coef_, self.intercept_ = np.asarray([m.coef_ for m in models]), np.asarray([m.intercept_ for m in models])
        return self

    def _proba(self, x):
        z = x @ self.coef_.T + self.intercept_
        return softmax(z if z.shape[1] > 1 else np.concatenate([-z, z], 1))


def averaged_sgd(df: DataFrame, features, step, start: np.ndarray, epochs: int, tol: float = 1e-6) -> np.ndarray:
    """Each task goes through its rows from the common weights; the mean of their results, by rows, starts the next epoch.

    ``step(w, x, y)`` returns the weights after a block of rows; the column y_ is the target.
    """
    data = df.select(vector(features).alias("v"), F.col("y_").cast("double").alias("y")).cache()
    w = start
    for _ in range(epochs):
        held = w

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            own, n = held.copy(), 0
            for b in batches:
                if len(b):
                    own = step(own, matrix(b["v"]), b["y"].to_numpy("f8"))
                    n += len(b)
            if n:
                yield pd.DataFrame({"n": [n], "w": [own.ravel().tolist()]})

        got = data.mapInPandas(run, "n long, w array<double>").select("n", F.posexplode("w").alias("i", "x")).groupBy("i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x")).toPandas().sort_values("i")
        if not len(got):
            break
        w = got["x"].to_numpy().reshape(start.shape)
        if np.abs(w - held).max() < tol:
            break
    data.unpersist()
    return w


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], 1)


class _SGD(BaseEstimator):
    """Plain steps of a loss, row after row within a task."""

    def _run(self, df, features, grad, epochs, eta0, alpha):
        mean_abs = df.agg(F.avg(F.aggregate(vector(features), F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size(vector(features)))).first()[0] or 1.0
        rate = eta0 / max(mean_abs, 1e-12)

        def step(w, x, y):
            for row, t in zip(_with_one(x), y):
                g = grad(row @ w, t)
                w = w * (1 - np.append(np.full(len(w) - 1, rate * alpha), 0.0)) - rate * g * row
            return w

        d = df.select(F.size(vector(features))).first()[0]
        return averaged_sgd(df, features, step, np.zeros(d + 1), epochs)


class SGDRegressor(_SGD, _Linear):
    def __init__(self, alpha=1e-4, eta0=0.01, max_iter=50):
        self.alpha, self.eta0, self.max_iter = alpha, eta0, max_iter

    def fit(self, df, features, label):
        self.features_, self.label_ = features, label
        w = self._run(df.withColumn("y_", F.col(f"`{label}`")), features, lambda z, y: z - y, self.max_iter, self.eta0, self.alpha)
        self.coef_, self.intercept_ = w[:-1], float(w[-1])
        return self


class SGDClassifier(_SGD, _Classifier):
    """Two classes; hinge or log loss."""

    def __init__(self, loss="hinge", alpha=1e-4, eta0=0.01, max_iter=50):
        self.loss, self.alpha, self.eta0, self.max_iter = loss, alpha, eta0, max_iter

    def _grad(self, z, y):
        if self.loss == "hinge":
            return -y if y * z < 1 else 0.0
        if self.loss == "perceptron":
            return -y if y * z <= 0 else 0.0
        return -y / (1 + np.exp(np.clip(y * z, -500, 500)))

    def fit(self, df, features, label):
        data = self._classes(df, features, label)
        if len(self.classes_) != 2:
            raise ValueError("two classes are needed; OneVsRestClassifier takes more")
        w = self._run(data.withColumn("y_", 2 * F.col("y_") - 1), features, self._grad, self.max_iter, self.eta0, self.alpha)
        self.coef_, self.intercept_ = w[None, :-1], w[-1:]
        return self

    def _proba(self, x):
        p = sigmoid((x @ self.coef_.T + self.intercept_)[:, 0])
        return np.stack([1 - p, p], 1)


class Perceptron(SGDClassifier):
    def __init__(self, alpha=0.0, eta0=0.01, max_iter=50):
        super().__init__("perceptron", alpha, eta0, max_iter)


class PassiveAggressiveClassifier(SGDClassifier):
    """Each row that is not clear by 1 moves the weights just so far, at most by C."""

    def __init__(self, C=1.0, max_iter=20):
        self.C, self.max_iter = C, max_iter

    def fit(self, df, features, label):
        data = self._classes(df, features, label)
        if len(self.classes_) != 2:
            raise ValueError("two classes are needed; OneVsRestClassifier takes more")
        c = self.C

        def step(w, x, y):
            for row, t in zip(_with_one(x), y):
                miss = 1 - t * (row @ w)
                if miss > 0:
                    w = w + min(c, miss / (row @ row)) * t * row
            return w

        d = df.select(F.size(vector(features))).first()[0]
        w = averaged_sgd(data.withColumn("y_", 2 * F.col("y_") - 1), features, step, np.zeros(d + 1), self.max_iter)
        self.coef_, self.intercept_ = w[None, :-1], w[-1:]
        return self
