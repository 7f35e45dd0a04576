"""Support vectors, networks, wrappers of other models, baselines, calibration."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BaseEstimator, RegressorMixin, TransformerMixin, clone, matrix, moments, scored, vector
from .decompose import Nystroem, RBFSampler
from .linear import LogisticRegression, Ridge, _Classifier, _Linear, assembled, averaged_sgd, sigmoid, softmax
from .quantiles import quantiles
from .trees import _MlClassifier


# --- support vectors -------------------------------------------------------------


class LinearSVC(_Classifier):
    """Hinge loss by MLlib; more than two classes one against the rest."""

    def __init__(self, C=1.0, max_iter=100, tol=1e-6):
        self.C, self.max_iter, self.tol = C, max_iter, tol

    def fit(self, df, features, label):
        from pyspark.ml.classification import LinearSVC as Fit

        data = assembled(self._classes(df, features, label), features).select("features_", "y_").cache()
        reg, rows = 1 / (self.C * max(1, data.count())), []
        for k in range(len(self.classes_)) if len(self.classes_) > 2 else [1]:
            m = Fit(featuresCol="features_", labelCol="t_", maxIter=self.max_iter, tol=self.tol, regParam=reg, standardization=False).fit(data.withColumn("t_", (F.col("y_") == k).cast("double")))
            rows.append((m.coefficients.toArray(), m.intercept))
        data.unpersist()
        self.coef_, self.intercept_ = np.asarray([r[0] for r in rows]), np.asarray([r[1] for r in rows])
        return self

    def decision_function(self, df, out="decision"):
        w, b = self.coef_, self.intercept_
        return scored(df, self.features_, lambda x: (x @ w.T + b)[:, 0] if len(b) == 1 else x @ w.T + b, out, "double" if len(b) == 1 else "array<double>")

    def _proba(self, x):
        z = x @ self.coef_.T + self.intercept_
        if z.shape[1] > 1:
            return softmax(z)
        p = sigmoid(z[:, 0])
        return np.stack([1 - p, p], 1)


class LinearSVR(_Linear):
    """Distance beyond epsilon, by averaged steps."""

    def __init__(self, C=1.0, epsilon=0.0, max_iter=100, eta0=0.1):
        self.C, self.epsilon, self.max_iter, self.eta0 = C, epsilon, max_iter, eta0

    def fit(self, df, features, label):
        self.features_, self.label_ = features, label
        n, s, _ = moments(df, features, label)
        mean = s / n
        sd = np.sqrt(np.maximum(np.diag(moments(df, features, label, center=mean)[2]) / n, 1e-12))
        eps, lam, count = self.epsilon / sd[-1], 1 / (self.C * n), [0]

        def step(w, x, y):
            z, t = (x - mean[:-1]) / sd[:-1], (y - mean[-1]) / sd[-1]
            for i in range(0, len(z), 32):
                b = np.concatenate([z[i : i + 32], np.ones((len(z[i : i + 32]), 1))], 1)
                miss = b @ w - t[i : i + 32]
                count[0] += 1
                g = (np.sign(miss) * (np.abs(miss) > eps)) @ b / len(b) + lam * np.append(w[:-1], 0)
                w = w - self.eta0 / np.sqrt(1 + 0.1 * count[0]) * g
            return w

        w = averaged_sgd(df.withColumn("y_", F.col(f"`{label}`")), features, step, np.zeros(len(mean)), self.max_iter, 1e-5)
        self.coef_ = w[:-1] * sd[-1] / sd[:-1]
        self.intercept_ = float(w[-1] * sd[-1] + mean[-1] - mean[:-1] @ self.coef_)
        return self


class SVC(LinearSVC):
    """Linear; a Gaussian kernel by random Fourier features; polynomials, sigmoids and functions of two matrices by landmark rows."""

    def __init__(self, C=1.0, kernel="rbf", gamma="scale", n_components=200, max_iter=100, seed=0, degree=3, coef0=0.0):
        super().__init__(C, max_iter)
        self.kernel, self.gamma, self.n_components, self.seed, self.degree, self.coef0 = kernel, gamma, n_components, seed, degree, coef0

    def _mapped(self, df):
        return df if self.kernel == "linear" else self.map_.transform(df, "rbf_")

    def _prepare(self, df, features):
        g = self.gamma
        if g == "scale":
            d, v = df.select(F.size(vector(features)).alias("d"), F.explode(vector(features)).alias("x")).agg(F.first("d"), F.var_pop("x")).first()
            g = 1 / max(d * v, 1e-12)
        if self.kernel == "rbf":
            self.map_ = RBFSampler(g, self.n_components, self.seed).fit(df, features)
        else:
            self.map_ = Nystroem(self.kernel, g, self.n_components, self.seed, getattr(self, "degree", 3), getattr(self, "coef0", 0.0)).fit(df, features)

    def fit(self, df, features, label):
        if self.kernel != "linear":
            self._prepare(df, features)
        super().fit(self._mapped(df), features if self.kernel == "linear" else "rbf_", label)
        return self

    def predict_proba(self, df):
        return super().predict_proba(self._mapped(df)).drop("rbf_")

    def decision_function(self, df, out="decision"):
        return super().decision_function(self._mapped(df), out).drop("rbf_")


class NuSVC(SVC):
    """``nu`` bounds the share of rows within the margin; here it sets C = 1 / nu."""

    def __init__(self, nu=0.5, kernel="rbf", gamma="scale", n_components=200, max_iter=100, seed=0):
        super().__init__(1 / nu, kernel, gamma, n_components, max_iter, seed)
        self.nu = nu


class SVR(LinearSVR):
    def __init__(self, C=1.0, epsilon=0.1, kernel="rbf", gamma="scale", n_components=200, max_iter=100, seed=0):
        super().__init__(C, epsilon, max_iter)
        self.kernel, self.gamma, self.n_components, self.seed = kernel, gamma, n_components, seed

    _mapped, _prepare = SVC._mapped, SVC._prepare

    def fit(self, df, features, label):
        if self.kernel != "linear":
            self._prepare(df, features)
        return super().fit(self._mapped(df), features if self.kernel == "linear" else "rbf_", label)

    def predict(self, df, out="prediction"):
        return super().predict(self._mapped(df), out).drop("rbf_")


class OneClassSVM(BaseEstimator):
    """1 within the distance from the mean (in deviations) that all but a share ``nu`` of the rows keep, else -1."""

    def __init__(self, nu=0.5):
        self.nu = nu

    def fit(self, df, features):
        self.features_ = features
        n, s, _ = moments(df, features)
        self.mean_ = s / n
        self.scale_ = np.sqrt(np.maximum(np.diag(moments(df, features, center=self.mean_)[2]) / n, 1e-12))
        self.threshold_ = quantiles(self._distance(df), {"distance_": F.col("distance_")}, [1 - self.nu])["distance_"][0]
        return self

    def _distance(self, df):
        m, s = self.mean_, self.scale_
        return scored(df, self.features_, lambda x: np.sqrt((((x - m) / s) ** 2).sum(1)), "distance_")

    def decision_function(self, df, out="decision"):
        return self._distance(df).withColumn(out, self.threshold_ - F.col("distance_")).drop("distance_")

    def predict(self, df, out="prediction"):
        return self.decision_function(df, "d_").withColumn(out, F.when(F.col("d_") >= 0, 1).otherwise(-1)).drop("d_")


# --- networks --------------------------------------------------------------------


class MLPClassifier(_MlClassifier):
    _kind = "MultilayerPerceptronClassifier"

    def __init__(self, hidden_layer_sizes=(100,), max_iter=200, tol=1e-6, seed=0):
        self.hidden_layer_sizes, self.max_iter, self.tol, self.seed = hidden_layer_sizes, max_iter, tol, seed

    def fit(self, df, features, label, weight=None):
        self.width_ = df.select(F.size(vector(features))).first()[0]
        return super().fit(df, features, label)

    def _options(self):
        return {"layers": [self.width_, *self.hidden_layer_sizes, max(2, len(self.classes_))], "maxIter": self.max_iter, "tol": self.tol, "seed": self.seed}


class MLPRegressor(BaseEstimator, RegressorMixin):
    """Adam on each task's rows, weights averaged after each epoch; inputs and target standardised."""

    def __init__(self, hidden_layer_sizes=(100,), activation="relu", learning_rate=0.01, alpha=1e-4, batch_size=64, max_iter=100, seed=0):
        self.hidden_layer_sizes, self.activation, self.learning_rate, self.alpha = hidden_layer_sizes, activation, learning_rate, alpha
        self.batch_size, self.max_iter, self.seed = batch_size, max_iter, seed

    def _forward(self, flat, z):
        acts, at = [z], 0
        for k, (a, b) in enumerate(self.shapes_):
            w = flat[at : at + a * b].reshape(a, b)
            z = acts[-1] @ w + flat[at + a * b : at + a * b + b]
            at += a * b + b
            if k < len(self.shapes_) - 1:
                z = np.maximum(z, 0) if self.activation == "relu" else np.tanh(z)
            acts.append(z)
        return acts

    def _gradient(self, flat, z, t):
        acts = self._forward(flat, z)
        delta, out, at = (acts[-1] - t[:, None]) / len(t), np.empty_like(flat), len(flat)
        for k in range(len(self.shapes_) - 1, -1, -1):
            a, b = self.shapes_[k]
            at -= a * b + b
            w = flat[at : at + a * b].reshape(a, b)
            out[at : at + a * b] = (acts[k].T @ delta).ravel() + self.alpha * w.ravel() / len(t)
            out[at + a * b : at + a * b + b] = delta.sum(0)
            if k:
                delta = (delta @ w.T) * ((acts[k] > 0) if self.activation == "relu" else 1 - acts[k] ** 2)
        return out

    def fit(self, df, features, label):
        self.features_, self.label_ = features, label
        n, s, _ = moments(df, features, label)
        self.mean_ = s / n
        self.scale_ = np.sqrt(np.maximum(np.diag(moments(df, features, label, center=self.mean_)[2]) / n, 1e-12))
        sizes = [len(self.mean_) - 1, *self.hidden_layer_sizes, 1]
        self.shapes_ = list(zip(sizes, sizes[1:]))
        rng = np.random.default_rng(self.seed)
        start = np.concatenate([np.concatenate([rng.standard_normal(a * b) * np.sqrt(2 / a), np.zeros(b)]) for a, b in self.shapes_])

        def step(flat, x, y):
            z, t = (x - self.mean_[:-1]) / self.scale_[:-1], (y - self.mean_[-1]) / self.scale_[-1]
            m, v = np.zeros_like(flat), np.zeros_like(flat)
            for k, i in enumerate(range(0, len(z), self.batch_size), 1):
                g = self._gradient(flat, z[i : i + self.batch_size], t[i : i + self.batch_size])
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                flat = flat - self.learning_rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
            return flat

        self.weights_ = averaged_sgd(df.withColumn("y_", F.col(f"`{label}`")), features, step, start, self.max_iter, 1e-7)
        return self

    def predict(self, df, out="prediction"):
        self._check_fitted()
        return scored(df, self.features_, lambda x: self._forward(self.weights_, (x - self.mean_[:-1]) / self.scale_[:-1])[-1][:, 0] * self.scale_[-1] + self.mean_[-1], out)


class BernoulliRBM(BaseEstimator, TransformerMixin):
    """Contrastive divergence on each task's rows, averaged by epoch; transform gives hidden probabilities."""

    def __init__(self, n_components=256, learning_rate=0.1, n_iter=10, batch_size=32, seed=0):
        self.n_components, self.learning_rate, self.n_iter, self.batch_size, self.seed = n_components, learning_rate, n_iter, batch_size, seed

    def fit(self, df, features):
        self.features_, h = features, self.n_components
        d = df.select(F.size(vector(features))).first()[0]
        rng = np.random.default_rng(self.seed)
        start = np.concatenate([rng.standard_normal(d * h) * 0.01, np.zeros(d + h)])

        def step(flat, x, _):
            r, flat = np.random.default_rng(len(x) + self.seed), flat.copy()
            w, vb, hb = flat[: d * h].reshape(d, h), flat[d * h : d * h + d], flat[d * h + d :]
            for i in range(0, len(x), self.batch_size):
                v = x[i : i + self.batch_size]
                p = sigmoid(v @ w + hb)
                v2 = sigmoid((r.random(p.shape) < p).astype(float) @ w.T + vb)
                p2 = sigmoid(v2 @ w + hb)
                w += self.learning_rate * (v.T @ p - v2.T @ p2) / len(v)
                vb += self.learning_rate * (v - v2).mean(0)
                hb += self.learning_rate * (p - p2).mean(0)
            return flat

        got = averaged_sgd(df.withColumn("y_", F.lit(0.0)), features, step, start, self.n_iter)
        self.components_, self.hidden_bias_ = got[: d * h].reshape(d, h), got[d * h + d :]
        return self

    def transform(self, df, out="components"):
        w, b = self.components_, self.hidden_bias_
        return scored(df, self.features_, lambda x: sigmoid(x @ w + b), out, "array<double>")


# --- wrappers --------------------------------------------------------------------


class OneVsRestClassifier(_Classifier):
    """One model for each class; probabilities of the positives, brought to sum 1."""

    def __init__(self, estimator=None):
        self.estimator = estimator

    def fit(self, df, features, label):
        data = self._classes(df, features, label)
        base = self.estimator or LogisticRegression()
        self.members_ = [clone(base).fit(data.withColumn("is_", (F.col("y_") == k).cast("int")), features, "is_") for k in range(len(self.classes_))]
        return self

    def predict_proba(self, df):
        for k, m in enumerate(self.members_):
            df = m.predict_proba(df).withColumn(f"p_{k}", F.element_at("probability", -1)).drop("probability")
        ps = [F.col(f"p_{k}") for k in range(len(self.members_))]
        return df.withColumn("probability", F.array(*[p / F.greatest(sum(ps, F.lit(0.0)), F.lit(1e-300)) for p in ps])).drop(*[f"p_{k}" for k in range(len(ps))])


class OutputCodeClassifier(OneVsRestClassifier):
    pass


class OneVsOneClassifier(_Classifier):
    """A vote of models for each pair of classes."""

    def __init__(self, estimator=None):
        self.estimator = estimator

    def fit(self, df, features, label):
        self._classes(df, features, label)
        base, c = self.estimator or LogisticRegression(), self.classes_
        self.members_ = [clone(base).fit(df.where(F.col(f"`{label}`").isin([a, b])), features, label) for i, a in enumerate(c) for b in c[i + 1 :]]
        return self

    def predict_proba(self, df):
        names = [f"v_{k}" for k in range(len(self.members_))]
        for n, m in zip(names, self.members_):
            df = m.predict(df, n)
        share = [sum((F.when(F.col(n) == F.lit(c), 1.0).otherwise(0.0) for n in names), F.lit(0.0)) / max(1, len(names)) for c in self.classes_]
        return df.withColumn("probability", F.array(*share)).drop(*names)


class _Many(BaseEstimator):
    def __init__(self, estimator=None):
        self.estimator = estimator

    def fit(self, df, features, labels):
        self.features_, self.labels_ = features, list(labels)
        self.members_ = [clone(self.estimator or self._base()).fit(df, features, y) for y in labels]
        return self

    def predict(self, df):
        """Adds prediction_<label> for each."""
        for y, m in zip(self.labels_, self.members_):
            df = m.predict(df, f"prediction_{y}")
        return df


class MultiOutputClassifier(_Many):
    def _base(self):
        return LogisticRegression()


class MultiOutputRegressor(_Many):
    def _base(self):
        return Ridge()


class ClassifierChain(_Many):
    """Each model also sees the labels before it: true ones when fitted, predicted ones after."""

    def __init__(self, estimator=None, order=None):
        self.estimator, self.order = estimator, order

    def _base(self):
        return LogisticRegression()

    def fit(self, df, features, labels):
        self.labels_ = [labels[i] for i in self.order] if self.order else list(labels)
        self.members_, feats = [], list(features)
        data = df.withColumns({f"chain_{y}": F.col(f"`{y}`").cast("double") for y in self.labels_})
        for y in self.labels_:
            self.members_.append(clone(self.estimator or self._base()).fit(data, list(feats), y))
            feats.append(f"chain_{y}")
        return self

    def predict(self, df):
        for y, m in zip(self.labels_, self.members_):
            df = m.predict(df, f"prediction_{y}").withColumn(f"chain_{y}", F.col(f"prediction_{y}").cast("double"))
        return df.drop(*[f"chain_{y}" for y in self.labels_])


class RegressorChain(ClassifierChain):
    def _base(self):
        return Ridge()


class TransformedTargetRegressor(BaseEstimator, RegressorMixin):
    """Fits g(y) and turns predictions back; func and inverse_func take and return columns."""

    def __init__(self, regressor=None, func=None, inverse_func=None):
        self.regressor, self.func, self.inverse_func = regressor, func, inverse_func

    def fit(self, df, features, label):
        self.label_ = label
        same = lambda c: c
        self.regressor_ = clone(self.regressor or Ridge()).fit(df.withColumn("target_", (self.func or same)(F.col(f"`{label}`"))), features, "target_")
        return self

    def predict(self, df, out="prediction"):
        return self.regressor_.predict(df, out).withColumn(out, (self.inverse_func or (lambda c: c))(F.col(out)))


# --- baselines -------------------------------------------------------------------


class DummyClassifier(_Classifier):
    """prior and stratified draw by class shares (by a hash of the row), uniform evenly; most_frequent and constant always the same."""

    def __init__(self, strategy="prior", constant=None, seed=0):
        self.strategy, self.constant, self.seed = strategy, constant, seed

    def fit(self, df, features, label):
        self._classes(df, features, label)
        got = {r[0]: r[1] for r in df.groupBy(f"`{label}`").count().collect()}
        self.class_prior_ = np.asarray([got[c] for c in self.classes_], float) / max(1, sum(got.values()))
        return self

    def predict(self, df, out="prediction"):
        self._check_fitted()
        if self.strategy in ("most_frequent", "constant"):
            v = self.constant if self.strategy == "constant" else self.classes_[int(self.class_prior_.argmax())]
            return df.withColumn(out, F.lit(v))
        p = self.class_prior_ if self.strategy != "uniform" else np.full(len(self.classes_), 1 / len(self.classes_))
        u = F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), F.to_json(F.struct("*"))), 11) / float(1 << 53)
        cuts = np.cumsum(p)
        return df.withColumn(out, F.coalesce(*[F.when(u < float(c), F.lit(v)) for c, v in zip(cuts[:-1], self.classes_)], F.lit(self.classes_[-1])))

    def predict_proba(self, df):
        return df.withColumn("probability", F.array(*[F.lit(float(p)) for p in self.class_prior_]))


class DummyRegressor(BaseEstimator, RegressorMixin):
    def __init__(self, strategy="mean", constant=None):
        self.strategy, self.constant = strategy, constant

    def fit(self, df, features, label):
        y = F.col(f"`{label}`").cast("double")
        self.label_ = label
        self.constant_ = self.constant if self.strategy == "constant" else df.agg(F.avg(y)).first()[0] if self.strategy == "mean" else (quantiles(df, {"y": y}, [0.5])["y"] or [None])[0]
        return self

    def predict(self, df, out="prediction"):
        return df.withColumn(out, F.lit(float(self.constant_)))


# --- calibration -----------------------------------------------------------------


class CalibratedClassifierCV(_Classifier):
    """Out-of-fold scores of a two-class model are mapped to probabilities by a sigmoid or a monotone step function."""

    def __init__(self, estimator=None, method="sigmoid", cv=5, order_by=None):
        self.estimator, self.method, self.cv, self.order_by = estimator, method, cv, order_by

    def fit(self, df, features, label):
        from pyspark.ml.regression import IsotonicRegression

        from .split import check_cv

        data = self._classes(df, features, label)
        base = self.estimator or LogisticRegression()
        parts = [clone(base).fit(train, features, label).predict_proba(test) for train, test in check_cv(self.cv, True).split(data, self.order_by or list(features), label)]
        oof = reduce(DataFrame.unionByName, parts).select("y_", *[F.col("probability")[k].alias(f"p_{k}") for k in range(len(self.classes_))])
        self.maps_ = []
        for k in range(len(self.classes_)):
            one = oof.select((F.col("y_") == k).cast("double").alias("t"), F.col(f"p_{k}").alias("p"))
            if self.method == "isotonic":
                m = IsotonicRegression(featuresCol="p", labelCol="t").fit(one)
                self.maps_.append(("isotonic", m.boundaries.toArray(), m.predictions.toArray()))
            else:
                lim = one.withColumn("z", F.log(F.greatest("p", F.lit(1e-12)) / F.greatest(1 - F.col("p"), F.lit(1e-12))))
                m = LogisticRegression(penalty="none").fit(lim, ["z"], "t")
                self.maps_.append(("sigmoid", float(m.coef_[0, 0]), float(m.intercept_[0])))
        self.base_ = clone(base).fit(df, features, label)
        return self

    def predict_proba(self, df):
        maps = self.maps_

        @F.pandas_udf("array<double>")
        def calibrated(p: pd.Series) -> pd.Series:
            x = matrix(p)
            out = np.stack([np.interp(x[:, k], m[1], m[2]) if m[0] == "isotonic" else sigmoid(m[1] * np.log(np.maximum(x[:, k], 1e-12) / np.maximum(1 - x[:, k], 1e-12)) + m[2]) for k, m in enumerate(maps)], 1)
            return pd.Series(list(out / np.maximum(out.sum(1, keepdims=True), 1e-300)))

        return self.base_.predict_proba(df).withColumn("probability", calibrated("probability"))


