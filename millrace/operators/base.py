"""Parameters, copies and checks that all estimators share.

An estimator's constructor takes parameters by name. ``fit(df, features, label)`` runs a
few distributed jobs and keeps small results in attributes that end in an underscore.
``predict`` and ``transform`` are lazy: they add columns to a DataFrame.
"""

from __future__ import annotations

import copy
import inspect
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFittedError(ValueError):
    """Used before fit."""


class ConvergenceWarning(UserWarning):
    """An iteration ended before it settled."""


class BaseEstimator:
    @classmethod
    def _names(cls) -> list[str]:
        names: list[str] = []
        for kind in cls.__mro__:
            if "__init__" in vars(kind):
                sig = inspect.signature(kind.__init__)
                names += [p.name for p in sig.parameters.values() if p.name != "self" and p.kind is p.POSITIONAL_OR_KEYWORD and p.name not in names]
                if not any(p.kind is p.VAR_KEYWORD for p in sig.parameters.values()):
                    break
        return sorted(names)

    def get_params(self, deep: bool = True) -> dict:
        out = {n: getattr(self, n) for n in self._names() if hasattr(self, n)}
        if deep:
            for n, v in list(out.items()):
                if isinstance(v, BaseEstimator):
                    out |= {f"{n}__{k}": x for k, x in v.get_params().items()}
        return out

    def set_params(self, **params) -> "BaseEstimator":
        for name, v in params.items():
            own, _, rest = name.partition("__")
            if not hasattr(self, own):
                raise ValueError(f"{type(self).__name__} has no parameter {own}")
            getattr(self, own).set_params(**{rest: v}) if rest else setattr(self, own, v)
        return self

    def clone(self) -> "BaseEstimator":
        return clone(self)

    def _check_fitted(self) -> None:
        if not any(k.endswith("_") and not k.startswith("_") for k in vars(self)):
            raise NotFittedError(f"{type(self).__name__} is not fitted")

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in self.get_params(False).items())})"


def clone(est):
    """A new estimator of the same parameters, not fitted."""
    params = {k: clone(v) if isinstance(v, BaseEstimator) else copy.deepcopy(v) for k, v in est.get_params(False).items()}
    return type(est)(**params)


class ClassifierMixin:
    _estimator_type = "classifier"

    def score(self, df: DataFrame, label: str | None = None) -> float:
        from .metrics import accuracy_score

        return accuracy_score(self.predict(df), label or self.label_, "prediction")


class RegressorMixin:
    _estimator_type = "regressor"

    def score(self, df: DataFrame, label: str | None = None) -> float:
        from .metrics import r2_score

        return r2_score(self.predict(df), label or self.label_, "prediction")


class TransformerMixin:
    def fit_transform(self, df: DataFrame, *args, **kw) -> DataFrame:
        return self.fit(df, *args, **kw).transform(df)


class ClusterMixin:
    _estimator_type = "clusterer"

    def fit_predict(self, df: DataFrame, *args, **kw) -> DataFrame:
        return self.fit(df, *args, **kw).predict(df)


def is_classifier(est) -> bool:
    return getattr(est, "_estimator_type", None) == "classifier"


def is_regressor(est) -> bool:
    return getattr(est, "_estimator_type", None) == "regressor"


def vector(features: Iterable[str]) -> Column:
    """Numeric columns, or one array column, as array<double>."""
    names = [features] if isinstance(features, str) else list(features)
    if len(names) == 1:
        return F.col(f"`{names[0]}`").cast("array<double>") if isinstance(features, str) else F.array(F.col(f"`{names[0]}`").cast("double"))
    return F.array(*[F.col(f"`{n}`").cast("double") for n in names])


def matrix(batch: pd.Series) -> np.ndarray:
    return np.asarray(batch.tolist(), "f8").reshape(len(batch), -1)


def scored(df: DataFrame, features, f, out: str, kind: str = "double") -> DataFrame:
    """Add ``out`` = f(matrix) by Arrow batches; f returns an array, a row for each row."""

    @F.pandas_udf(kind)
    def run(v: pd.Series) -> pd.Series:
        got = f(matrix(v)) if len(v) else np.empty(0)
        return pd.Series(list(got) if getattr(got, "ndim", 1) > 1 else got)

    return df.withColumn(out, run(vector(features)))


def moments(df: DataFrame, features, *more: str, weight: str | None = None, center: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, sums, Gram matrix) of the feature columns followed by ``more``; each task adds up its rows, so d x d numbers move."""
    whole = F.concat(vector(features), *[F.array(F.col(f"`{m}`").cast("double")) for m in more])
    data = df.select(whole.alias("v"), (F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)).alias("w"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0.0, None, None
        for b in batches:
            if not len(b):
                continue
            x, w = matrix(b["v"]), b["w"].to_numpy("f8")
            x = x if center is None else x - center
            s = (0 if s is None else s) + w @ x
            g = (0 if g is None else g) + (x * w[:, None]).T @ x
            n += w.sum()
        if s is not None:
            yield pd.DataFrame({"cell": np.arange(1 + len(s) + g.size), "x": np.concatenate([[n], s, g.ravel()])})

    got = data.mapInPandas(add, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas().sort_values("cell")["x"].to_numpy()
    if not len(got):
        raise ValueError("no rows")
    d = int((np.sqrt(4 * len(got) - 3) - 1) / 2)
    return float(got[0]), got[1 : d + 1], got[d + 1 :].reshape(d, d)


def check_array(df: DataFrame, features, *, min_samples: int = 1) -> int:
    """Rows, all finite and of one length; ValueError otherwise. One pass."""
    v = vector(features)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = df.agg(F.count("*").alias("n"), F.sum(F.coalesce(bad, F.lit(True)).cast("int")).alias("bad"), F.countDistinct(F.size(v)).alias("sizes")).first()
    if r["n"] < min_samples:
        raise ValueError(f"{r['n']} rows, {min_samples} needed")
    if r["bad"]:
        raise ValueError(f"{r['bad']} rows hold missing or infinite values")
    if r["sizes"] > 1:
        raise ValueError("vectors of different lengths")
    return r["n"]


def check_X_y(df: DataFrame, features, label: str) -> int:
    if df.where(F.col(f"`{label}`").isNull()).limit(1).count():
        raise ValueError("missing labels")
    return check_array(df, features)
