"""Projections: one pass for the Gram matrix, a small eigenproblem, then a linear map; manifolds on bounded rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BaseEstimator, TransformerMixin, matrix, moments, scored, vector
from .cluster import bounded, joined, squared


def _signed(v: np.ndarray) -> np.ndarray:
    """Rows with the largest entry positive."""
    return v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)] + 1e-300)[:, None]


class _Map(BaseEstimator, TransformerMixin):
    def transform(self, df: DataFrame, out: str = "components") -> DataFrame:
        self._check_fitted()
        return scored(df, self.features_, self._apply, out, "array<double>")

    def inverse_transform(self, df: DataFrame, column: str = "components", out: str = "restored") -> DataFrame:
        return scored(df, column, self._back, out, "array<double>")


class PCA(_Map):
    """Centred; whitened components have variance 1. ``n_components`` below 1 is a share of the variance."""

    def __init__(self, n_components=None, whiten=False):
        self.n_components, self.whiten = n_components, whiten

    def fit(self, df, features):
        self.features_ = features
        n, s, _ = moments(df, features)
        self.mean_ = s / n
        g = moments(df, features, center=self.mean_)[2] / max(n - 1, 1)
        values, basis = np.linalg.eigh(g)
        values, basis = np.maximum(values[::-1], 0), basis[:, ::-1].T
        ratio = values / max(values.sum(), 1e-300)
        k = self.n_components
        k = len(values) if k is None else int(np.searchsorted(np.cumsum(ratio), k) + 1) if isinstance(k, float) and k < 1 else int(k)
        self.components_, self.explained_variance_, self.explained_variance_ratio_ = _signed(basis[:k]), values[:k], ratio[:k]
        self.noise_, self.n_ = values[k:].mean() if k < len(values) else 0.0, n
        return self

    def _apply(self, x):
        z = (x - self.mean_) @ self.components_.T
        return z / np.sqrt(np.maximum(self.explained_variance_, 1e-300)) if self.whiten else z

    def _back(self, z):
        return (z * np.sqrt(self.explained_variance_) if self.whiten else z) @ self.components_ + self.mean_

    def score(self, df) -> float:
        """Minus the mean squared error of what comes back."""
        return -scored(df, self.features_, lambda x: ((self._back(self._apply(x)) - x) ** 2).mean(1), "e_").agg(F.avg("e_")).first()[0]


class TruncatedSVD(_Map):
    """Not centred."""

    def __init__(self, n_components=2):
        self.n_components = n_components

    def fit(self, df, features):
        self.features_ = features
        values, basis = np.linalg.eigh(moments(df, features)[2])
        self.components_, self.singular_values_ = _signed(basis[:, ::-1].T[: self.n_components]), np.sqrt(np.maximum(values[::-1][: self.n_components], 0))
        return self

    def _apply(self, x):
        return x @ self.components_.T

    def _back(self, z):
        return z @ self.components_


class NMF(_Map):
    """Non-negative factors: rows' weights by multiplicative updates inside tasks, the common part from summed products."""

    def __init__(self, n_components=2, max_iter=100, inner=30, seed=0):
        self.n_components, self.max_iter, self.inner, self.seed = n_components, max_iter, inner, seed

    def fit(self, df, features):
        self.features_ = features
        data = df.select(vector(features).alias("v")).cache()
        if (data.agg(F.min(F.array_min("v"))).first()[0] or 0) < 0:
            data.unpersist()
            raise ValueError("non-negative factors need values that aren't negative")
        d = len(data.first()["v"])
        h, k = np.random.default_rng(self.seed).uniform(0.1, 1, (self.n_components, d)), self.n_components
        for _ in range(self.max_iter):

            def add(batches, h=h):
                for b in batches:
                    if len(b):
                        x = matrix(b["v"])
                        w = self._weights(x, h)
                        out = np.concatenate([(w.T @ x).ravel(), (w.T @ w).ravel()])
                        yield pd.DataFrame({"cell": np.arange(len(out)), "x": out})

            got = data.mapInPandas(add, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas().sort_values("cell")["x"].to_numpy()
            wx, ww = got[: k * d].reshape(k, d), got[k * d :].reshape(k, k)
            new = h
            for _ in range(5):
                new = new * wx / np.maximum(ww @ new, 1e-12)
            done = np.abs(new - h).max() < 1e-5 * max(1e-12, h.max())
            h = new
            if done:
                break
        data.unpersist()
        self.components_ = h
        return self

    def _weights(self, x, h):
        w = np.full((len(x), len(h)), max(x.mean(), 1e-6))
        top, gram = x @ h.T, h @ h.T
        for _ in range(self.inner):
            w = w * top / np.maximum(w @ gram, 1e-12)
        return w

    def _apply(self, x):
        return self._weights(x, self.components_)

    def _back(self, w):
        return w @ self.components_


class FactorAnalysis(_Map):
    """Expectation maximisation on the covariance matrix."""

    def __init__(self, n_components=2, max_iter=200, tol=1e-6):
        self.n_components, self.max_iter, self.tol = n_components, max_iter, tol

    def fit(self, df, features):
        self.features_ = features
        n, s, _ = moments(df, features)
        self.mean_ = s / n
        c = moments(df, features, center=self.mean_)[2] / n
        values, basis = np.linalg.eigh(c)
        k = self.n_components
        load, noise = (basis[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 1e-12))), np.maximum(np.diag(c) * 0.5, 1e-12)
        for _ in range(self.max_iter):
            beta = np.linalg.solve(load @ load.T + np.diag(noise), load).T
            ezz = np.eye(k) - beta @ load + beta @ c @ beta.T
            new = c @ beta.T @ np.linalg.inv(ezz)
            noise = np.maximum(np.diag(c - new @ beta @ c), 1e-12)
            done = np.abs(new - load).max() < self.tol
            load = new
            if done:
                break
        self.components_, self.noise_variance_ = load.T, noise
        self.beta_ = np.linalg.solve(load @ load.T + np.diag(noise), load)
        return self

    def _apply(self, x):
        return (x - self.mean_) @ self.beta_

    def _back(self, z):
        return z @ self.components_ + self.mean_


class FastICA(_Map):
    """Whitened by PCA; the symmetric fixed point of tanh, each round one pass over the rows."""

    def __init__(self, n_components=2, max_iter=100, tol=1e-4, seed=0):
        self.n_components, self.max_iter, self.tol, self.seed = n_components, max_iter, tol, seed

    def fit(self, df, features):
        self.features_, k = features, self.n_components
        self.white_ = PCA(k, whiten=True).fit(df, features)
        data = self.white_.transform(df, "z_").select("z_").cache()
        w = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((k, k)))[0]
        for _ in range(self.max_iter):

            def add(batches, w=w):
                for b in batches:
                    if len(b):
                        z = matrix(b["z_"])
                        t = np.tanh(z @ w.T)
                        out = np.concatenate([[len(z)], (t.T @ z).ravel(), (1 - t * t).sum(0)])
                        yield pd.DataFrame({"cell": np.arange(len(out)), "x": out})

            got = data.mapInPandas(add, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas().sort_values("cell")["x"].to_numpy()
            n = got[0]
            new = got[1 : 1 + k * k].reshape(k, k) / n - (got[1 + k * k :] / n)[:, None] * w
            u, _, v = np.linalg.svd(new)
            new = u @ v
            done = np.abs(np.abs(np.einsum("ij,ij->i", new, w)) - 1).max() < self.tol
            w = new
            if done:
                break
        data.unpersist()
        self.unmixing_ = w
        return self

    def _apply(self, x):
        return self.white_._apply(x) @ self.unmixing_.T

    def _back(self, s):
        return self.white_._back(s @ self.unmixing_)


def kernel(a: np.ndarray, b: np.ndarray, kind: str = "rbf", gamma: float = 1.0, degree: int = 3, coef0: float = 1.0) -> np.ndarray:
    """``kind`` is rbf, linear, poly, sigmoid or a function of the two matrices."""
    if callable(kind):
        return np.asarray(kind(a, b), float)
    if kind == "rbf":
        return np.exp(-gamma * squared(a, b))
    if kind not in ("linear", "poly", "sigmoid"):
        raise ValueError(f"kernel {kind!r}: choose linear, poly, rbf, sigmoid or a function")
    dot = a @ b.T
    return {"linear": lambda: dot, "poly": lambda: (gamma * dot + coef0) ** degree, "sigmoid": lambda: np.tanh(gamma * dot + coef0)}[kind]()


class RBFSampler(_Map):
    """Random Fourier features."""

    def __init__(self, gamma=1.0, n_components=100, seed=0):
        self.gamma, self.n_components, self.seed = gamma, n_components, seed

    def fit(self, df, features):
        self.features_ = features
        d = df.select(F.size(vector(features))).first()[0]
        rng = np.random.default_rng(self.seed)
        self.weights_, self.offset_ = rng.standard_normal((d, self.n_components)) * np.sqrt(2 * self.gamma), rng.uniform(0, 2 * np.pi, self.n_components)
        return self

    def _apply(self, x):
        return np.sqrt(2 / self.n_components) * np.cos(x @ self.weights_ + self.offset_)


class Nystroem(_Map):
    """Kernel with a bounded number of landmark rows, whitened in the directions where it is positive."""

    def __init__(self, kernel="rbf", gamma=1.0, n_components=100, seed=0, degree=3, coef0=1.0):
        self.kernel, self.gamma, self.n_components, self.seed, self.degree, self.coef0 = kernel, gamma, n_components, seed, degree, coef0

    def fit(self, df, features):
        self.features_ = features
        self.landmarks_ = matrix(df.select(vector(features).alias("v")).orderBy(F.xxhash64("v", F.lit(self.seed))).limit(self.n_components).toPandas()["v"])
        values, basis = np.linalg.eigh(self._k(self.landmarks_))
        used = values > 1e-10 * max(values.max(initial=0.0), 1e-300)
        self.normal_ = basis[:, used] / np.sqrt(values[used]) @ basis[:, used].T
        return self

    def _k(self, x):
        return kernel(x, self.landmarks_, self.kernel, self.gamma, self.degree, self.coef0)

    def _apply(self, x):
        return self._k(x) @ self.normal_


class KernelPCA(_Map):
    """Eigenvectors of the centred kernel of all rows; any row is projected on them. Needs the whole kernel, so more than ``most`` rows are refused; only where ``max_rows`` is given does a sample of so many rows stand for them."""

    most = 3000

    def __init__(self, n_components=2, kernel="rbf", gamma=None, degree=3, coef0=1.0, max_rows=None, seed=0):
        self.n_components, self.kernel, self.gamma, self.degree, self.coef0, self.max_rows, self.seed = n_components, kernel, gamma, degree, coef0, max_rows, seed

    def fit(self, df, features):
        self.features_ = features
        x = matrix(df.select(vector(features).alias("v")).orderBy(F.xxhash64("v", F.lit(self.seed))).limit(self.max_rows or self.most + 1).toPandas()["v"])
        if self.max_rows is None and len(x) > self.most:
            raise ValueError(f"more than {self.most} rows; this method holds a matrix of rows x rows (max_rows draws a sample)")
        self.base_, self.gamma_ = x, self.gamma or 1 / x.shape[1]
        k = self._k(x)
        self.row_, self.all_ = k.mean(0), k.mean()
        values, basis = np.linalg.eigh(k - self.row_ - self.row_[:, None] + self.all_)
        self.values_ = np.maximum(values[::-1][: self.n_components], 1e-12)
        self.alphas_ = basis[:, ::-1][:, : self.n_components] / np.sqrt(self.values_)
        return self

    def _k(self, x):
        return kernel(x, self.base_, self.kernel, self.gamma_, self.degree, self.coef0)

    def _apply(self, x):
        k = self._k(x)
        return (k - k.mean(1, keepdims=True) - self.row_ + self.all_) @ self.alphas_


class _Manifold(BaseEstimator):
    """Defined by all distances, so rows are bounded by ``max_rows``."""

    def __init__(self, n_components=2, n_neighbors=5, max_rows=3000, seed=0):
        self.n_components, self.n_neighbors, self.max_rows, self.seed = n_components, n_neighbors, max_rows, seed

    def fit_transform(self, df: DataFrame, features, id_col: str, out: str = "embedding") -> DataFrame:
        ids, x = bounded(df, features, id_col, self.max_rows)
        return joined(df, id_col, ids, self._embed(x), out, "array<double>")


def classical_scaling(d2: np.ndarray, k: int) -> np.ndarray:
    b = -0.5 * (d2 - d2.mean(0) - d2.mean(1)[:, None] + d2.mean())
    values, basis = np.linalg.eigh(b)
    return basis[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))


def neighbor_graph(x: np.ndarray, k: int) -> np.ndarray:
    d = np.sqrt(squared(x, x))
    keep = np.zeros_like(d, bool)
    near = np.argsort(d, 1)[:, 1 : k + 1]
    keep[np.arange(len(x))[:, None], near] = True
    return np.where(keep | keep.T, d, np.inf)


class MDS(_Manifold):
    def _embed(self, x):
        return classical_scaling(squared(x, x), self.n_components)


class Isomap(_Manifold):
    def _embed(self, x):
        g = neighbor_graph(x, self.n_neighbors)
        np.fill_diagonal(g, 0)
        for k in range(len(g)):
            np.minimum(g, g[:, k, None] + g[None, k, :], out=g)
        g[~np.isfinite(g)] = g[np.isfinite(g)].max() * 2
        return classical_scaling(g * g, self.n_components)


class SpectralEmbedding(_Manifold):
    def _embed(self, x):
        w = np.isfinite(neighbor_graph(x, self.n_neighbors)).astype(float)
        deg = np.sqrt(np.maximum(w.sum(1), 1e-12))
        values, basis = np.linalg.eigh(np.eye(len(w)) - w / deg[:, None] / deg)
        return (basis / deg[:, None])[:, 1 : self.n_components + 1]


class TSNE(_Manifold):
    def __init__(self, n_components=2, perplexity=30.0, learning_rate=200.0, max_iter=500, max_rows=2000, seed=0):
        self.n_components, self.perplexity, self.learning_rate, self.max_iter, self.max_rows, self.seed = n_components, perplexity, learning_rate, max_iter, max_rows, seed

    def _embed(self, x):
        n, d2 = len(x), squared(x, x)
        p = np.zeros((n, n))
        want = np.log(min(self.perplexity, max(1.0, (n - 1) / 3)))
        for i in range(n):
            lo, hi, beta, row = 0.0, np.inf, 1.0, np.delete(d2[i], i)
            for _ in range(60):
                e = np.exp(-(row - row.min()) * beta)
                q = e / e.sum()
                h = -(q * np.log(np.maximum(q, 1e-300))).sum()
                if abs(h - want) < 1e-5:
                    break
                lo, hi = (beta, hi) if h > want else (lo, beta)
                beta = beta * 2 if hi == np.inf else (lo + hi) / 2
            p[i, np.arange(n) != i] = q
        p = np.maximum((p + p.T) / (2 * n), 1e-12)
        y, v = np.random.default_rng(self.seed).standard_normal((n, self.n_components)) * 1e-4, np.zeros((n, self.n_components))
        for t in range(self.max_iter):
            w = 1 / (1 + squared(y, y))
            np.fill_diagonal(w, 0)
            force = ((12 if t < 100 else 1) * p - w / w.sum()) * w
            grad = 4 * (force.sum(1)[:, None] * y - force @ y)
            v = (0.5 if t < 250 else 0.8) * v - self.learning_rate * grad / max(1.0, np.abs(grad).max())
            y = y + v
            y -= y.mean(0)
        return y
