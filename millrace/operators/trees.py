"""Trees and ensembles: MLlib grows them over distributed histograms; the ensembles it lacks are loops over it."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BaseEstimator, RegressorMixin, clone, is_classifier
from .linear import LogisticRegression, Ridge, _Classifier, assembled


def _ml(name: str):
    from pyspark.ml import classification, regression

    return getattr(classification, name, None) or getattr(regression, name)


class _Ml(BaseEstimator):
    """Wraps an MLlib estimator: features assembled, labels coded, probabilities as arrays."""

    _kind = ""

    def _options(self) -> dict:
        return {}

    def fit(self, df: DataFrame, features, label: str, weight: str | None = None):
        data = self._classes(df, features, label) if isinstance(self, _Classifier) else df.withColumn("y_", F.col(f"`{label}`").cast("double"))
        self.features_, self.label_ = features, label
        extra = {"weightCol": "w_"} if weight else {}
        data = assembled(data, features).select("features_", "y_", *([F.col(f"`{weight}`").cast("double").alias("w_")] if weight else []))
        self.model_ = _ml(self._kind)(featuresCol="features_", labelCol="y_", **self._options(), **extra).fit(data)
        return self

    @property
    def feature_importances_(self) -> np.ndarray:
        return self.model_.featureImportances.toArray()


class _MlClassifier(_Ml, _Classifier):
    def predict_proba(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        self._check_fitted()
        m = self.model_.copy({self.model_.probabilityCol: "probability", self.model_.rawPredictionCol: "raw_", self.model_.predictionCol: "code_"})
        return m.transform(assembled(df, self.features_)).withColumn("probability", vector_to_array("probability")).drop("features_", "raw_", "code_")


class _MlRegressor(_Ml, RegressorMixin):
    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        self._check_fitted()
        return self.model_.copy({self.model_.predictionCol: out}).transform(assembled(df, self.features_)).drop("features_")


class _TreeOptions:
    def __init__(self, max_depth=None, min_samples_leaf=1, min_impurity=0.0, max_bins=257, seed=0):
        self.max_depth, self.min_samples_leaf, self.min_impurity, self.max_bins, self.seed = max_depth, min_samples_leaf, min_impurity, max_bins, seed

    def _options(self):
        return {"maxDepth": min(self.max_depth or 10, 30), "minInstancesPerNode": self.min_samples_leaf, "minInfoGain": self.min_impurity, "maxBins": self.max_bins, "seed": self.seed}


class DecisionTreeClassifier(_TreeOptions, _MlClassifier):
    _kind = "DecisionTreeClassifier"


class DecisionTreeRegressor(_TreeOptions, _MlRegressor):
    _kind = "DecisionTreeRegressor"


class _ForestOptions:
    def __init__(self, n_estimators=100, max_depth=None, max_features=None, min_samples_leaf=1, max_samples=1.0, bootstrap=True, max_bins=257, seed=0):
        self.n_estimators, self.max_depth, self.max_features, self.min_samples_leaf = n_estimators, max_depth, max_features, min_samples_leaf
        self.max_samples, self.bootstrap, self.max_bins, self.seed = max_samples, bootstrap, max_bins, seed

    def _options(self):
        m = self.max_features
        pick = ("sqrt" if isinstance(self, _Classifier) else "all") if m is None else {1.0: "all"}.get(m, str(m))
        return {"numTrees": self.n_estimators, "maxDepth": min(self.max_depth or 10, 30), "featureSubsetStrategy": pick, "minInstancesPerNode": self.min_samples_leaf, "subsamplingRate": float(self.max_samples or 1.0), "bootstrap": self.bootstrap, "maxBins": self.max_bins, "seed": self.seed}


class RandomForestClassifier(_ForestOptions, _MlClassifier):
    _kind = "RandomForestClassifier"


class RandomForestRegressor(_ForestOptions, _MlRegressor):
    _kind = "RandomForestRegressor"


class ExtraTreeClassifier(DecisionTreeClassifier):
    """Coarse random splits: few bins at a random seed stand for random thresholds."""

    def __init__(self, max_depth=None, min_samples_leaf=1, min_impurity=0.0, max_bins=16, seed=0):
        super().__init__(max_depth, min_samples_leaf, min_impurity, max_bins, seed)


class ExtraTreeRegressor(DecisionTreeRegressor):
    pass


class ExtraTreesClassifier(RandomForestClassifier):
    """All rows for each tree, coarse splits."""

    def __init__(self, n_estimators=100, max_depth=None, max_features=None, min_samples_leaf=1, max_samples=1.0, bootstrap=False, max_bins=16, seed=0):
        super().__init__(n_estimators, max_depth, max_features, min_samples_leaf, max_samples, bootstrap, max_bins, seed)


class ExtraTreesRegressor(RandomForestRegressor):
    pass


class _BoostOptions:
    def __init__(self, n_estimators=100, learning_rate=0.1, max_depth=3, subsample=1.0, loss=None, seed=0):
        self.n_estimators, self.learning_rate, self.max_depth, self.subsample, self.loss, self.seed = n_estimators, learning_rate, max_depth, subsample, loss, seed

    def _options(self):
        return {"maxIter": self.n_estimators, "stepSize": self.learning_rate, "maxDepth": self.max_depth or 3, "subsamplingRate": self.subsample, "seed": self.seed}


class GradientBoostingRegressor(_BoostOptions, _MlRegressor):
    _kind = "GBTRegressor"

    def _options(self):
        losses = {None: "squared", "squared_error": "squared", "squared": "squared", "absolute_error": "absolute", "absolute": "absolute"}
        if self.loss not in losses:
            raise ValueError(f"loss {self.loss!r}: choose squared_error or absolute_error")
        return super()._options() | {"lossType": losses[self.loss]}


class GradientBoostingClassifier(_BoostOptions, _MlClassifier):
    """Two classes by MLlib; more, one against the rest, probabilities brought to sum 1."""

    _kind = "GBTClassifier"

    def fit(self, df, features, label, weight=None):
        data = self._classes(df, features, label)
        if len(self.classes_) <= 2:
            return super().fit(df, features, label, weight)
        self.parts_ = []
        for k in range(len(self.classes_)):
            one = GradientBoostingClassifier(**self.get_params(False))
            self.parts_.append(one.fit(data.withColumn("is_", (F.col("y_") == k).cast("int")), features, "is_", weight))
        return self

    def predict_proba(self, df):
        if not getattr(self, "parts_", None):
            return super().predict_proba(df)
        out = df
        for k, p in enumerate(self.parts_):
            out = p.predict_proba(out).withColumn(f"p_{k}", F.element_at("probability", 2)).drop("probability")
        ps = [F.col(f"p_{k}") for k in range(len(self.parts_))]
        return out.withColumn("probability", F.array(*[p / F.greatest(sum(ps, F.lit(0.0)), F.lit(1e-300)) for p in ps])).drop(*[f"p_{k}" for k in range(len(ps))])


class HistGradientBoostingClassifier(GradientBoostingClassifier):
    """Another name: boosting is over histograms here in any case."""


class HistGradientBoostingRegressor(GradientBoostingRegressor):
    """Another name: boosting is over histograms here in any case."""


class _Members(BaseEstimator):
    """Fitted members; their results are columns of one DataFrame, not joins."""

    def _columns(self, df: DataFrame, proba: bool) -> tuple[DataFrame, list[str]]:
        names = []
        for k, m in enumerate(self.members_):
            if proba:
                df = m.predict_proba(df).withColumnRenamed("probability", f"m_{k}")
            else:
                df = m.predict(df, f"m_{k}")
            names.append(f"m_{k}")
        return df, names


def _mean(arrays, weights):
    total = float(sum(weights))

    def share(name, w):
        return F.transform(F.col(name), lambda x: x * (w / total))

    return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), [share(a, w) for a, w in zip(arrays, weights)])


def _average(names, weights):
    return sum((F.col(n) * float(w) for n, w in zip(names, weights)), F.lit(0.0)) / float(sum(weights))


class BaggingClassifier(_Members, _Classifier):
    """Members fitted on samples of rows and subsets of columns; probabilities averaged."""

    def __init__(self, estimator=None, n_estimators=10, max_samples=1.0, max_features=1.0, seed=0):
        self.estimator, self.n_estimators, self.max_samples, self.max_features, self.seed = estimator, n_estimators, max_samples, max_features, seed

    def _base(self):
        return DecisionTreeClassifier()

    def fit(self, df, features, label):
        if isinstance(self, _Classifier):
            self._classes(df, features, label)
        self.features_, self.label_, self.members_ = features, label, []
        rng = np.random.default_rng(self.seed)
        for k in range(self.n_estimators):
            some = sorted(rng.choice(len(features), max(1, int(len(features) * self.max_features)), replace=False))
            rows = df.sample(True, float(self.max_samples), self.seed + k)
            self.members_.append(clone(self.estimator or self._base()).fit(rows, [features[i] for i in some], label))
        return self

    def predict_proba(self, df):
        """A member that saw no row of a class gives it no probability."""
        out, names = self._columns(df, True)
        full = []
        for n, m in zip(names, self.members_):
            at = {c: i for i, c in enumerate(m.classes_)}
            out = out.withColumn(n, F.array(*[F.col(n)[at[c]] if c in at else F.lit(0.0) for c in self.classes_]))
            full.append(n)
        return out.withColumn("probability", _mean(full, [1.0] * len(full))).drop(*full)


class BaggingRegressor(BaggingClassifier, RegressorMixin):
    _estimator_type = "regressor"
    score = RegressorMixin.score

    def _base(self):
        return DecisionTreeRegressor()

    def fit(self, df, features, label):
        return BaggingClassifier.fit(self, df, features, label)

    def predict(self, df, out="prediction"):
        d, names = self._columns(df, False)
        return d.withColumn(out, _average(names, [1.0] * len(names))).drop(*names)


class VotingClassifier(_Members, _Classifier):
    """Hard: the class with most votes, the smaller on ties. Soft: mean probability."""

    def __init__(self, estimators=(), voting="hard", weights=None):
        self.estimators, self.voting, self.weights = estimators, voting, weights

    def fit(self, df, features, label):
        self._classes(df, features, label)
        self.members_ = [clone(e).fit(df, features, label) for _, e in self.estimators]
        return self

    def predict_proba(self, df):
        d, names = self._columns(df, True)
        return d.withColumn("probability", _mean(names, self.weights or [1.0] * len(names))).drop(*names)

    def predict(self, df, out="prediction"):
        if self.voting == "soft":
            return super().predict(df, out)
        d, names = self._columns(df, False)
        return d.withColumn(out, vote(names, self.classes_, self.weights)).drop(*names)


def vote(names, classes, weights=None):
    """Most weight, first class on ties."""
    w = weights or [1.0] * len(names)
    sums = [sum((F.when(F.col(n) == F.lit(c), float(x)).otherwise(0.0) for n, x in zip(names, w)), F.lit(0.0)) for c in classes]
    best = F.greatest(*sums) if len(sums) > 1 else sums[0]
    return F.coalesce(*[F.when(s == best, F.lit(c)) for s, c in zip(sums, classes)])


class VotingRegressor(_Members, RegressorMixin):
    def __init__(self, estimators=(), weights=None):
        self.estimators, self.weights = estimators, weights

    def fit(self, df, features, label):
        self.features_, self.label_ = features, label
        self.members_ = [clone(e).fit(df, features, label) for _, e in self.estimators]
        return self

    def predict(self, df, out="prediction"):
        d, names = self._columns(df, False)
        return d.withColumn(out, _average(names, self.weights or [1.0] * len(names))).drop(*names)


class _Stacking(_Members):
    """Members' out-of-fold results are the features of the last model."""

    def __init__(self, estimators=(), final_estimator=None, cv=5, order_by=None):
        self.estimators, self.final_estimator, self.cv, self.order_by = estimators, final_estimator, cv, order_by

    def _meta(self, df, members):
        names = []
        for k, m in enumerate(members):
            if is_classifier(m):
                df = m.predict_proba(df)
                for j in range(len(m.classes_) - 1 if len(m.classes_) == 2 else len(m.classes_)):
                    df, names = df.withColumn(f"s_{k}_{j}", F.col("probability")[j + (len(m.classes_) == 2)]), [*names, f"s_{k}_{j}"]
                df = df.drop("probability")
            else:
                df, names = m.predict(df, f"s_{k}"), [*names, f"s_{k}"]
        return df, names

    def fit(self, df, features, label):
        from .split import check_cv

        if isinstance(self, _Classifier):
            self._classes(df, features, label)
        self.features_, self.label_ = features, label
        parts, names = [], []
        for train, test in check_cv(self.cv, is_classifier(self)).split(df, self.order_by or list(features), label):
            out, names = self._meta(test, [clone(e).fit(train, features, label) for _, e in self.estimators])
            parts.append(out)
        self.members_ = [clone(e).fit(df, features, label) for _, e in self.estimators]
        self.final_ = clone(self.final_estimator or (LogisticRegression() if is_classifier(self) else Ridge())).fit(reduce(DataFrame.unionByName, parts), names, label)
        return self

    def predict(self, df, out="prediction"):
        d, names = self._meta(df, self.members_)
        return self.final_.predict(d, out).drop(*names)


class StackingClassifier(_Stacking, _Classifier):
    def predict_proba(self, df):
        d, names = self._meta(df, self.members_)
        return self.final_.predict_proba(d).drop(*names)

    def predict(self, df, out="prediction"):
        return _Stacking.predict(self, df, out)


class StackingRegressor(_Stacking, RegressorMixin):
    pass


class AdaBoostClassifier(_Classifier):
    """Two or more classes (SAMME): rows that the last tree missed weigh more for the next."""

    def __init__(self, n_estimators=50, learning_rate=1.0, max_depth=1, seed=0):
        self.n_estimators, self.learning_rate, self.max_depth, self.seed = n_estimators, learning_rate, max_depth, seed

    def fit(self, df, features, label):
        self._classes(df, features, label)
        k = len(self.classes_)
        self.members_, self.weights_ = [], []
        y = F.col(f"`{label}`")
        for i in range(self.n_estimators):
            now = df
            for j, (m, a) in enumerate(zip(self.members_, self.weights_)):  # weights follow from the fitted trees; no table of weights is kept
                now = m.predict(now, f"a_{j}")
            boost = sum((F.when(F.col(f"a_{j}") != y, a).otherwise(0.0) for j, a in enumerate(self.weights_)), F.lit(0.0))
            now = now.withColumn("weight_", F.exp(boost))
            m = DecisionTreeClassifier(self.max_depth, seed=self.seed + i).fit(now, features, label, "weight_")
            err = m.predict(now, "p_").agg((F.sum(F.when(F.col("p_") != y, F.col("weight_")).otherwise(0.0)) / F.sum("weight_"))).first()[0]
            if err >= 1 - 1 / k:
                break
            err = max(err, 1e-10)
            self.members_.append(m)
            self.weights_.append(self.learning_rate * (float(np.log((1 - err) / err)) + float(np.log(max(k - 1, 1)))))
            if err <= 1e-10:
                break
        return self

    def predict_proba(self, df):
        d = df
        for j, m in enumerate(self.members_):
            d = m.predict(d, f"a_{j}")
        total = float(sum(self.weights_)) or 1.0
        share = [sum((F.when(F.col(f"a_{j}") == F.lit(c), w / total).otherwise(0.0) for j, w in enumerate(self.weights_)), F.lit(0.0)) for c in self.classes_]
        return d.withColumn("probability", F.array(*share)).drop(*[f"a_{j}" for j in range(len(self.members_))])


class AdaBoostRegressor(BaseEstimator, RegressorMixin):
    """R2: losses relative to the largest; the prediction is the weighted median of the trees."""

    def __init__(self, n_estimators=50, learning_rate=1.0, max_depth=3, seed=0):
        self.n_estimators, self.learning_rate, self.max_depth, self.seed = n_estimators, learning_rate, max_depth, seed

    def fit(self, df, features, label):
        self.features_, self.label_, self.members_, self.weights_, scales = features, label, [], [], []
        y = F.col(f"`{label}`")
        for i in range(self.n_estimators):
            now, log_w = df, F.lit(0.0)
            for j, (m, b, s) in enumerate(zip(self.members_, self.weights_, scales)):
                now = m.predict(now, f"a_{j}")
                log_w = log_w - b * self.learning_rate * (1 - F.abs(F.col(f"a_{j}") - y) / s)
            now = now.withColumn("weight_", F.exp(log_w))
            m = DecisionTreeRegressor(self.max_depth, seed=self.seed + i).fit(now, features, label, "weight_")
            e = F.abs(F.col("p_") - y)
            worst, mean = m.predict(now, "p_").agg(F.max(e), F.sum(F.col("weight_") * e) / F.sum("weight_")).first()
            if not worst:
                self.members_.append(m)
                self.weights_.append(10.0)
                break
            if mean / worst >= 0.5 and self.members_:
                break
            self.members_.append(m)
            self.weights_.append(float(np.log(max(1 - mean / worst, 1e-10) / max(mean / worst, 1e-10))))
            scales.append(worst)
        return self

    def predict(self, df, out="prediction"):
        d = df
        for j, m in enumerate(self.members_):
            d = m.predict(d, f"a_{j}")
        pairs = F.array_sort(F.array(*[F.struct(F.col(f"a_{j}").alias("v"), F.lit(max(w, 1e-12)).alias("w")) for j, w in enumerate(self.weights_)]))
        half = sum(max(w, 1e-12) for w in self.weights_) / 2
        zero = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("v"))
        at = F.aggregate(pairs, zero, lambda a, x: F.struct((a["s"] + x["w"]).alias("s"), F.when(a["v"].isNull() & (a["s"] + x["w"] >= half), x["v"]).otherwise(a["v"]).alias("v")))
        return d.withColumn(out, at["v"]).drop(*[f"a_{j}" for j in range(len(self.members_))])


