"""Choosing a model, explaining it, keeping it."""

from __future__ import annotations

import json
import os
import pickle
import time
from dataclasses import dataclass
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import bayes, linear, meta, trees
from ..operators.base import is_classifier
from ..operators.metrics import confusion_df, get_scorer, prf_average_df, regression_df
from ..operators.split import shuffle_key
from .compose import clone_any, cross_val_score


def detect_task(df: DataFrame, label: str) -> str:
    """Text is classes; whole numbers are, if they are few; booleans and fractions are quantities."""
    kind = df.schema[label].dataType
    if isinstance(kind, T.StringType):
        return "classification"
    if isinstance(kind, T.IntegralType):
        r = df.agg(F.countDistinct(f"`{label}`").alias("d"), F.count("*").alias("n")).first()
        return "classification" if r["d"] <= 20 and r["d"] <= max(10, int(0.05 * r["n"])) else "regression"
    return "regression"


def portfolio(task: str, n: int) -> list[tuple[str, object]]:
    if task == "classification":
        out = [("logreg", linear.LogisticRegression()), ("tree", trees.DecisionTreeClassifier(8)), ("rf", trees.RandomForestClassifier(50)), ("et", trees.ExtraTreesClassifier(50)), ("gnb", bayes.GaussianNB()), ("mlp", meta.MLPClassifier((32,)))]
        return out + ([("gbm", trees.GradientBoostingClassifier(30)), ("hgb", trees.HistGradientBoostingClassifier(30))] if n < 5000 else [])
    out = [("ridge", linear.Ridge()), ("lasso", linear.Lasso(0.01, scaled=False)), ("tree", trees.DecisionTreeRegressor(8)), ("rf", trees.RandomForestRegressor(50)), ("et", trees.ExtraTreesRegressor(50)), ("mlp", meta.MLPRegressor((32,)))]
    return out + ([("gbm", trees.GradientBoostingRegressor(30))] if n < 5000 else [])


def leaderboard(df: DataFrame, features, label: str, *, order_by, task: str | None = None, cv: int = 3, scoring=None, time_budget: float = 30.0, candidates=None) -> list[dict]:
    """Candidates by mean score; the budget is looked at between them, and what fails is noted, not raised."""
    task = task or detect_task(df, label)
    out, began = [], time.perf_counter()
    for name, est in candidates or portfolio(task, df.count()):
        if out and time.perf_counter() - began > time_budget:
            break
        t = time.perf_counter()
        try:
            s = cross_val_score(est, df, features, label, order_by=order_by, cv=cv, scoring=scoring)
            out.append({"name": name, "mean": float(s.mean()), "std": float(s.std()), "seconds": time.perf_counter() - t, "estimator": est})
        except Exception as e:  # noqa: BLE001  one candidate's failure is a row of the report
            out.append({"name": name, "mean": float("-inf"), "std": 0.0, "seconds": time.perf_counter() - t, "estimator": est, "error": str(e)[:200]})
    return sorted(out, key=lambda r: -r["mean"])


def find_best(df: DataFrame, features, label: str, *, order_by, refit: bool = True, **kw):
    """(best model, leaderboard)."""
    board = leaderboard(df, features, label, order_by=order_by, **kw)
    best = board[0]["estimator"]
    return (clone_any(best).fit(df, features, label) if refit else best), board


@dataclass
class PermImport:
    importances_mean: np.ndarray
    importances_std: np.ndarray
    feature_names: list[str]


def permuted(df: DataFrame, column: str, order_by, seed: int) -> DataFrame:
    """``df`` with one column's values dealt anew: positions in one order meet positions in another."""
    from ..operators.split import positions

    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    a = positions(df, keys, "pos_")
    b = positions(df.select(*[F.col(f"`{k}`") for k in dict.fromkeys([*keys, column])]).withColumn("key_", shuffle_key(seed, *keys)), ["key_", *keys], "pos_").select("pos_", F.col(f"`{column}`").alias("new_"))
    return a.join(b, "pos_").withColumn(column, F.col("new_")).drop("pos_", "new_")


def permutation_importance(est, df: DataFrame, features: list[str], label: str, *, order_by, n_repeats: int = 5, seed: int = 0, scoring=None) -> PermImport:
    scorer = get_scorer(scoring or ("accuracy" if is_classifier(est) else "r2"))
    base = scorer(est, df, label)
    drops = np.asarray([[base - scorer(est, permuted(df, c, order_by, seed + 1009 * r), label) for r in range(n_repeats)] for c in features])
    return PermImport(drops.mean(1), drops.std(1), list(features))


def partial_dependence(est, df: DataFrame, feature: str, *, grid=None, n_points: int = 50) -> DataFrame:
    """value, mean of the prediction (of the second class's probability) with the feature set to it: one pass for all values."""
    if grid is None:
        lo, hi = df.agg(F.min(f"`{feature}`"), F.max(f"`{feature}`")).first()
        grid = np.linspace(float(lo), float(hi), n_points)
    points = F.array(*[F.lit(float(g)) for g in grid])
    wide = df.withColumn(feature, F.explode(points))
    if is_classifier(est):
        return est.predict_proba(wide).groupBy(F.col(f"`{feature}`").alias("value")).agg(F.avg(F.get("probability", F.lit(1))).alias("mean"))
    return est.predict(wide).groupBy(F.col(f"`{feature}`").alias("value")).agg(F.avg("prediction").alias("mean"))


def model_report(est, df: DataFrame, features: list[str], label: str, *, order_by) -> dict:
    out = est.predict(df)
    if is_classifier(est):
        r = prf_average_df(out, label, "prediction", "weighted").first()
        rep = {"task": "classification", "accuracy": get_scorer("accuracy")(est, df, label), **r.asDict()}
    else:
        r = regression_df(out, label, "prediction").select("rmse", "r2").first()
        rep = {"task": "regression", **r.asDict()}
    imp = permutation_importance(est, df, features, label, order_by=order_by)
    top = np.argsort(-imp.importances_mean, kind="stable")[:10]
    rep["top_features"] = [(imp.feature_names[i], float(imp.importances_mean[i])) for i in top]
    return rep


# --- keeping ----------------------------------------------------------------------


def save_model(est, path: str, metadata: dict | None = None) -> None:
    """Parameters and fitted numbers by pickle, MLlib models beside them in their own format, what describes them as JSON."""
    os.makedirs(path, exist_ok=True)
    parts: list = []
    state = _strip(est, parts)
    with open(f"{path}/model.pkl", "wb") as f:
        pickle.dump(state, f)
    for i, p in enumerate(parts):
        p.write().overwrite().save(f"{path}/ml-{i}")
    with open(f"{path}/model.json", "w", encoding="utf-8") as f:
        json.dump({"class": type(est).__name__, "saved": datetime.now(timezone.utc).isoformat(), "ml": [type(p).__module__ + "." + type(p).__name__ for p in parts], **(metadata or {})}, f, default=str)


class _Part:
    def __init__(self, i: int) -> None:
        self.i = i


def _strip(x, parts: list):
    if hasattr(x, "_java_obj"):
        parts.append(x)
        return _Part(len(parts) - 1)
    if isinstance(x, (list, tuple)):
        return type(x)([_strip(v, parts) for v in x])
    if isinstance(x, DataFrame):
        raise TypeError("models that hold fitted rows (neighbours, encoders by join) are kept as tables, not as files")
    if hasattr(x, "get_params") and not isinstance(x, type):
        new = object.__new__(type(x))
        new.__dict__ = {k: _strip(v, parts) for k, v in vars(x).items()}
        return new
    return x


def _restore(x, parts: list):
    if isinstance(x, _Part):
        return parts[x.i]
    if isinstance(x, (list, tuple)):
        return type(x)([_restore(v, parts) for v in x])
    if hasattr(x, "get_params") and not isinstance(x, type):
        x.__dict__ = {k: _restore(v, parts) for k, v in vars(x).items()}
    return x


def load_model(path: str):
    """Only files of one's own: pickle runs code."""
    import importlib

    with open(f"{path}/model.json", encoding="utf-8") as f:
        about = json.load(f)
    parts = []
    for i, name in enumerate(about["ml"]):
        module, _, cls = name.rpartition(".")
        parts.append(getattr(importlib.import_module(module), cls).load(f"{path}/ml-{i}"))
    with open(f"{path}/model.pkl", "rb") as f:
        return _restore(pickle.load(f), parts)  # noqa: S301


class ModelRegistry:
    """root/name/vN, and latest.txt; the next number is one more than the highest."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _versions(self, name: str) -> list[int]:
        at = f"{self.root}/{name}"
        return sorted(int(v[1:]) for v in os.listdir(at) if v[0] == "v" and v[1:].isdigit()) if os.path.isdir(at) else []

    def register(self, name: str, est, metadata: dict | None = None) -> str:
        v = f"v{max(self._versions(name), default=0) + 1}"
        save_model(est, f"{self.root}/{name}/{v}", metadata)
        with open(f"{self.root}/{name}/latest.txt", "w", encoding="utf-8") as f:
            f.write(v)
        return v

    def latest(self, name: str):
        with open(f"{self.root}/{name}/latest.txt", encoding="utf-8") as f:
            return load_model(f"{self.root}/{name}/{f.read().strip()}")

    def load(self, name: str, version: str):
        return load_model(f"{self.root}/{name}/{version}")

    def list(self, name: str | None = None) -> list[str]:
        names = [name] if name else sorted(os.listdir(self.root)) if os.path.isdir(self.root) else []
        return [f"{n}/v{v}" for n in names for v in self._versions(n)]


# --- figures: aggregates by Spark, drawn on the driver --------------------------------


def confusion_matrix_fig(df: DataFrame, y: str, p: str, ax=None):
    rows = confusion_df(df, y, p).orderBy("y", "p").collect()
    labels = sorted({r["y"] for r in rows})
    m = np.asarray([r["n"] for r in rows]).reshape(len(labels), len(labels))
    return _draw(ax, lambda a: a.imshow(m)) or (labels, m)


def importance_fig(names, values, top: int = 15, ax=None):
    best = sorted(zip(names, map(float, values)), key=lambda x: -abs(x[1]))[:top]
    return _draw(ax, lambda a: a.barh([n for n, _ in best][::-1], [v for _, v in best][::-1])) or "\n".join(f"{n:>20} {'#' * int(40 * abs(v) / (abs(best[0][1]) or 1))} {v:.4g}" for n, v in best)


def residual_histogram(df: DataFrame, y: str, p: str, bins: int = 30) -> DataFrame:
    """bin, lo, n: residuals in equal steps."""
    e = df.select((F.col(f"`{y}`") - F.col(f"`{p}`")).cast("double").alias("e"))
    r = F.broadcast(e.agg(F.min("e").alias("lo"), F.max("e").alias("hi")))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.coalesce(F.floor(F.try_divide(F.col("e") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    return e.crossJoin(r).groupBy(b.alias("bin")).agg(F.min(F.col("lo") + b * width).alias("lo"), F.count("*").alias("n"))


def residual_fig(df: DataFrame, y: str, p: str, ax=None):
    rows = residual_histogram(df, y, p).orderBy("bin").collect()
    return _draw(ax, lambda a: a.bar([r["lo"] for r in rows], [r["n"] for r in rows])) or [(r["lo"], r["n"]) for r in rows]


def _draw(ax, f):
    """A figure where matplotlib is present, else nothing."""
    try:
        import matplotlib.pyplot as plt
    except ImportError:
        return None
    ax = ax or plt.gca()
    f(ax)
    return ax.figure


