"""Steps in sequence and side by side, cross-validation, search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.base import BaseEstimator, TransformerMixin, clone, is_classifier
from ..operators.metrics import get_scorer
from ..operators.split import check_cv


def _named(steps) -> list[tuple[str, BaseEstimator]]:
    out, seen = [], {}
    for s in steps:
        name = type(s).__name__.lower()
        seen[name] = seen.get(name, 0) + 1
        out.append((name if seen[name] == 1 else f"{name}-{seen[name]}", s))
    return out


class Pipeline(BaseEstimator):
    """Transformers, then a model. All work on the same columns; a transformer that makes a vector column passes its name on."""

    def __init__(self, steps):
        self.steps = steps

    @property
    def named_steps(self) -> dict:
        return dict(self.steps)

    def get_params(self, deep=True):
        out = {"steps": self.steps}
        if deep:
            out |= {f"{n}__{k}": v for n, s in self.steps for k, v in s.get_params().items()}
        return out

    def set_params(self, **params):
        for name, v in params.items():
            own, _, rest = name.partition("__")
            if rest:
                self.named_steps[own].set_params(**{rest: v})
            else:
                setattr(self, own, v)
        return self

    def clone(self):
        return Pipeline([(n, clone(s)) for n, s in self.steps])

    def fit(self, df: DataFrame, features=None, label: str | None = None) -> "Pipeline":
        self.fitted_, self.label_ = [], label
        for i, (_, s) in enumerate(self.steps):
            s = clone(s)
            last = i == len(self.steps) - 1
            s.fit(*[x for x in (df, features, label) if x is not None]) if last and hasattr(s, "predict") else s.fit(*([df] if features is None else [df, features] if not _wants_label(s) else [df, features, label]))
            self.fitted_.append(s)
            if not last:
                df = s.transform(df)
                features = _features(s, features)
        return self

    def _through(self, df):
        for s in self.fitted_[:-1]:
            df = s.transform(df)
        return df

    def transform(self, df):
        return self.fitted_[-1].transform(self._through(df))

    def predict(self, df, out="prediction"):
        return self.fitted_[-1].predict(self._through(df), out)

    def predict_proba(self, df):
        return self.fitted_[-1].predict_proba(self._through(df))

    def decision_function(self, df):
        return self.fitted_[-1].decision_function(self._through(df))

    def score(self, df, label=None):
        return self.fitted_[-1].score(self._through(df), label or self.label_)


def _wants_label(s) -> bool:
    import inspect

    return any(p in inspect.signature(s.fit).parameters for p in ("label", "target"))


def _features(s, features):
    if hasattr(s, "selected_"):
        return list(s.selected_)
    if hasattr(s, "terms_"):
        return [f"p{i}" for i in range(len(s.terms_))]
    from ..operators.decompose import _Map

    return "components" if isinstance(s, _Map) else features


def make_pipeline(*steps) -> Pipeline:
    return Pipeline(_named(steps))


class FeatureUnion(BaseEstimator, TransformerMixin):
    """Vector outputs of several transformers end to end in one array column; weights count in fit_transform, too."""

    def __init__(self, transformer_list, transformer_weights=None):
        self.transformer_list, self.transformer_weights = transformer_list, transformer_weights

    def fit(self, df, features, label=None):
        self.fitted_ = [(n, clone(t).fit(df, features)) for n, t in self.transformer_list]
        self.features_ = features
        return self

    def transform(self, df, out="components"):
        parts = []
        for i, (n, t) in enumerate(self.fitted_):
            df = t.transform(df, f"u_{i}")
            parts.append(_times(f"u_{i}", float((self.transformer_weights or {}).get(n, 1.0))))
        return df.withColumn(out, F.concat(*parts)).drop(*[f"u_{i}" for i in range(len(parts))])


def _times(column: str, w: float):
    return F.transform(F.col(column), lambda x: x * w)


def make_union(*transformers) -> FeatureUnion:
    return FeatureUnion(_named(transformers))


class ColumnTransformer(BaseEstimator, TransformerMixin):
    """Each transformer on its own columns; what no transformer takes is dropped, unless named in ``keep``."""

    def __init__(self, transformers, remainder="drop", keep=()):
        self.transformers, self.remainder, self.keep = transformers, remainder, keep

    def fit(self, df, features=None, label=None):
        self.fitted_ = [(clone(t).fit(df, cols), cols) for _, t, cols in self.transformers]
        return self

    def transform(self, df):
        before, made = set(df.columns), []
        for t, cols in self.fitted_:
            df = t.transform(df)
            new = [c for c in df.columns if c not in before and c not in made]
            made += new or [c for c in cols if c not in made]
        return df.select(*[F.col(f"`{c}`") for c in [*made, *[k for k in self.keep if k not in made]]])


# --- validation and search --------------------------------------------------------


def folds_of(est, df, features, label, cv, order_by) -> Iterator[tuple[DataFrame, DataFrame]]:
    return check_cv(cv, is_classifier(est)).split(df, order_by, label)


def _default(est):
    return "accuracy" if is_classifier(est) or isinstance(est, Pipeline) and is_classifier(est.steps[-1][1]) else "r2"


def cross_val_score(est, df, features, label, *, order_by, cv=5, scoring=None) -> np.ndarray:
    """A score for each fold. The table is cached once for all folds."""
    data, scorer = df.cache(), get_scorer(scoring or _default(est))
    out = [scorer(clone_any(est).fit(train, features, label), test, label) for train, test in folds_of(est, data, features, label, cv, order_by)]
    data.unpersist()
    return np.asarray(out)


def clone_any(est):
    return est.clone() if isinstance(est, Pipeline) else clone(est)


def cross_validate(est, df, features, label, *, order_by, cv=5, scoring=None) -> dict:
    import time

    scorer, out = get_scorer(scoring or _default(est)), {"test_score": [], "fit_time": [], "score_time": []}
    for train, test in folds_of(est, df, features, label, cv, order_by):
        t0 = time.perf_counter()
        fitted = clone_any(est).fit(train, features, label)
        t1 = time.perf_counter()
        out["test_score"].append(scorer(fitted, test, label))
        out["fit_time"].append(t1 - t0)
        out["score_time"].append(time.perf_counter() - t1)
    return {k: np.asarray(v) for k, v in out.items()}


def cross_val_predict(est, df, features, label, *, order_by, cv=5) -> DataFrame:
    """Each row with the prediction of the model that didn't see it."""
    return reduce(DataFrame.unionByName, [clone_any(est).fit(train, features, label).predict(test) for train, test in folds_of(est, df, features, label, cv, order_by)])


class GridSearchCV(BaseEstimator):
    """Every combination; the first best is fitted again on all rows."""

    def __init__(self, estimator, param_grid, cv=5, scoring=None, refit=True):
        self.estimator, self.param_grid, self.cv, self.scoring, self.refit = estimator, param_grid, cv, scoring, refit

    def _candidates(self) -> list[dict]:
        grids = self.param_grid if isinstance(self.param_grid, list) else [self.param_grid]
        return [dict(zip(g, v)) for g in grids for v in product(*g.values())]

    def fit(self, df, features, label, *, order_by):
        self.cv_results_ = []
        for params in self._candidates():
            s = cross_val_score(clone_any(self.estimator).set_params(**params), df, features, label, order_by=order_by, cv=self.cv, scoring=self.scoring)
            self.cv_results_.append((float(s.mean()), params, s))
        self.best_score_, self.best_params_, _ = max(self.cv_results_, key=lambda r: r[0])
        if self.refit:
            self.best_estimator_ = clone_any(self.estimator).set_params(**self.best_params_).fit(df, features, label)
        self.label_ = label
        return self

    def predict(self, df, out="prediction"):
        return self.best_estimator_.predict(df, out)

    def predict_proba(self, df):
        return self.best_estimator_.predict_proba(df)

    def score(self, df, label=None):
        return self.best_estimator_.score(df, label or self.label_)


class RandomizedSearchCV(GridSearchCV):
    """Random combinations of lists or of distributions with ``rvs(random_state)``."""

    def __init__(self, estimator, param_distributions, n_iter=10, cv=5, scoring=None, refit=True, seed=0):
        super().__init__(estimator, None, cv, scoring, refit)
        self.param_distributions, self.n_iter, self.seed = param_distributions, n_iter, seed

    def _candidates(self):
        rng = np.random.default_rng(self.seed)
        pick = lambda v: v.rvs(random_state=rng) if hasattr(v, "rvs") else v[int(rng.integers(len(v)))]
        return [{k: pick(v) for k, v in self.param_distributions.items()} for _ in range(self.n_iter)]


def learning_curve(est, df, features, label, *, order_by, train_sizes=(0.1, 0.33, 0.55, 0.78, 1.0), cv=5, scoring=None) -> dict:
    """Scores after fits on the first rows of each training part."""
    from ..operators.split import positions

    scorer, out = get_scorer(scoring or _default(est)), {"train_sizes": [], "train_scores": [], "test_scores": []}
    parts = [(positions(a, order_by, "pos_").cache(), b) for a, b in folds_of(est, df, features, label, cv, order_by)]
    for share in train_sizes:
        rows = []
        for train, test in parts:
            n = int(train.count() * share) if isinstance(share, float) else share
            some = train.where(F.col("pos_") < n).drop("pos_")
            m = clone_any(est).fit(some, features, label)
            rows.append((n, scorer(m, some, label), scorer(m, test, label)))
        out["train_sizes"].append(rows[0][0])
        out["train_scores"].append([r[1] for r in rows])
        out["test_scores"].append([r[2] for r in rows])
    return {k: np.asarray(v) for k, v in out.items()}


def validation_curve(est, df, features, label, param: str, values, *, order_by, cv=5, scoring: str | Callable | None = None) -> dict:
    """Cross-validated test scores, and the score of a fit on all rows, for each value."""
    scorer, train, test = get_scorer(scoring or _default(est)), [], []
    for v in values:
        m = clone_any(est).set_params(**{param: v})
        test.append(cross_val_score(m, df, features, label, order_by=order_by, cv=cv, scoring=scoring))
        train.append(scorer(clone_any(m).fit(df, features, label), df, label))
    return {"train_scores": np.asarray(train), "test_scores": np.asarray(test)}
