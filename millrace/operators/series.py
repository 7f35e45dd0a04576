"""Time series as rows (time, value): forecasts, splits, errors, decomposition. The time column is the order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import BaseEstimator
from .split import positions, sizes


class _Forecaster(BaseEstimator):
    def fit(self, df: DataFrame, time: str, y: str):
        self.spark_ = df.sparkSession
        self._fit(df.select(F.col(f"`{time}`").alias("t"), F.col(f"`{y}`").cast("double").alias("y")))
        return self

    def predict(self, horizon: int = 1) -> DataFrame:
        """h, forecast for h = 1..horizon."""
        self._check_fitted()
        return self.spark_.createDataFrame([(h + 1, float(v)) for h, v in enumerate(self._values(horizon))], "h int, forecast double")

    @staticmethod
    def _tail(df: DataFrame, n: int) -> list[float]:
        return [r["y"] for r in df.orderBy(F.desc("t")).limit(n).collect()][::-1]


class NaiveForecaster(_Forecaster):
    """The last value."""

    def _fit(self, df):
        self.last_ = df.agg(F.max_by("y", "t")).first()[0]

    def _values(self, horizon):
        return [self.last_] * horizon


class SeasonalNaiveForecaster(_Forecaster):
    """The last season over and over."""

    def __init__(self, season=7):
        self.season = season

    def _fit(self, df):
        self.tail_ = self._tail(df, self.season)

    def _values(self, horizon):
        return [self.tail_[i % len(self.tail_)] for i in range(horizon)]


class MovingAverageForecaster(_Forecaster):
    """The mean of the last values."""

    def __init__(self, window=7):
        self.window = window

    def _fit(self, df):
        tail = self._tail(df, self.window)
        self.mean_ = sum(tail) / len(tail)

    def _values(self, horizon):
        return [self.mean_] * horizon


def exponential_level(df: DataFrame, time: str, y: str, alpha: float) -> DataFrame:
    """One row: the smoothed level, as a weighted sum over positions instead of a recursion."""
    p = positions(df, time, "pos_")
    n = F.broadcast(p.agg((F.max("pos_") + 1).alias("n_")))
    age = F.col("n_") - 1 - F.col("pos_")
    w = F.pow(F.lit(1 - alpha), age) * F.when(F.col("pos_") == 0, 1.0).otherwise(alpha)
    return p.crossJoin(n).agg(F.sum(w * F.col(f"`{y}`").cast("double")).alias("level"))


class ExponentialSmoothingForecaster(_Forecaster):
    def __init__(self, alpha=0.3):
        self.alpha = alpha

    def _fit(self, df):
        self.level_ = exponential_level(df, "t", "y", self.alpha).first()[0]

    def _values(self, horizon):
        return [self.level_] * horizon


def lagged(df: DataFrame, time: str, y: str, lags: int) -> DataFrame:
    """lag1.. of each row; rows without all of them go. The series is cut into ranges of time that overlap by the lags."""
    p = positions(df.select(F.col(f"`{time}`").alias("t"), F.col(f"`{y}`").cast("double").alias("y")), "t", "pos")
    copies = F.explode(F.transform(F.sequence(F.lit(0), F.lit(lags)), lambda k: F.struct((F.col("pos") + k).alias("pos"), k.alias("k"), F.col("y").alias("y"))))
    rows = p.select(copies.alias("c")).select("c.*").groupBy("pos").agg(*[F.max(F.when(F.col("k") == k, F.col("y"))).alias("y" if k == 0 else f"lag{k}") for k in range(lags + 1)], F.count("*").alias("n_"))
    return rows.where((F.col("n_") == lags + 1) & F.col("y").isNotNull()).drop("n_")


class ARForecaster(_Forecaster):
    """Least squares on the last values; forecasts feed the next."""

    def __init__(self, lags=7):
        self.lags = lags

    def _fit(self, df):
        from .linear import LinearRegression

        n = df.count()
        p = max(1, min(self.lags, n - 1))
        names = [f"lag{k}" for k in range(1, p + 1)]
        model = LinearRegression().fit(lagged(df, "t", "y", p), names, "y")
        self.coef_, self.intercept_, self.tail_ = model.coef_, model.intercept_, self._tail(df, p)

    def _values(self, horizon):
        known = list(self.tail_)
        for _ in range(horizon):
            known.append(float(self.intercept_ + np.dot(self.coef_, known[::-1][: len(self.coef_)])))
        return known[len(self.tail_) :]


def temporal_split(df: DataFrame, time: str, test_size: float | int = 0.2) -> tuple[DataFrame, DataFrame]:
    """The tail of the time is the test."""
    n = df.count()
    cut = n - sizes(n, test_size)[1]
    p = positions(df, time, "pos_")
    return p.where(F.col("pos_") < cut).drop("pos_"), p.where(F.col("pos_") >= cut).drop("pos_")


def errors_df(df: DataFrame, actual: str, forecast: str, eps: float = 1e-9) -> DataFrame:
    """mae, smape (in percent)."""
    a, f = F.col(f"`{actual}`").cast("double"), F.col(f"`{forecast}`").cast("double")
    return df.agg(F.avg(F.abs(a - f)).alias("mae"), (100 * F.avg(2 * F.abs(f - a) / (F.abs(a) + F.abs(f) + eps))).alias("smape"))


def mae(df, actual, forecast):
    return errors_df(df, actual, forecast).first()["mae"]


def smape(df, actual, forecast):
    return errors_df(df, actual, forecast).first()["smape"]


def mase(train: DataFrame, df: DataFrame, time: str, y: str, actual: str, forecast: str, season: int = 1) -> float:
    """Error over that of the seasonal naive forecast on the training series; over 1 if that is 0."""
    p = positions(train, time, "pos_").select("pos_", F.col(f"`{y}`").cast("double").alias("y_"))
    before = p.select((F.col("pos_") + season).alias("pos_"), F.col("y_").alias("b_"))
    scale = p.join(before, "pos_").agg(F.avg(F.abs(F.col("y_") - F.col("b_")))).first()[0] or 1.0
    return mae(df, actual, forecast) / scale


def rolling_origin_cv(df: DataFrame, time: str, y: str, forecaster: BaseEstimator, horizon: int = 7, folds: int = 3, metric=mae) -> list[float]:
    """Errors over the horizon after each of several ends; ends not beyond the horizon are left out."""
    p = positions(df.select(F.col(f"`{time}`").alias("t"), F.col(f"`{y}`").alias("y")), "t", "pos_").cache()
    n, out = p.count(), []
    for f in range(folds):
        end = n - horizon * (folds - f)
        if end <= horizon:
            continue
        model = forecaster.clone().fit(p.where(F.col("pos_") < end), "t", "y")
        test = p.where((F.col("pos_") >= end) & (F.col("pos_") < end + horizon)).withColumn("h", (F.col("pos_") - end + 1).cast("int"))
        out.append(metric(test.join(model.predict(horizon), "h"), "y", "forecast"))
    p.unpersist()
    return out


def seasonal_decompose(df: DataFrame, time: str, y: str, season: int = 7) -> DataFrame:
    """time, y, trend (centred mean, nothing beyond the ends), seasonal (mean of what is left by place in the season), resid.

    Each row goes to the few positions whose mean it is part of, so no window spans the series.
    """
    p = positions(df.select(F.col(f"`{time}`").alias("t"), F.col(f"`{y}`").cast("double").alias("y")), "t", "pos")
    lo, hi = season // 2, (season - 1) // 2
    spread = p.select(F.col("y"), F.explode(F.sequence(F.col("pos") - hi, F.col("pos") + lo)).alias("pos"))
    trend = spread.groupBy("pos").agg((F.sum("y") / season).alias("trend"))
    d = p.join(trend, "pos").withColumn("place", F.col("pos") % season)
    s = d.groupBy("place").agg(F.avg(F.col("y") - F.col("trend")).alias("seasonal"))
    return d.join(F.broadcast(s), "place").select("t", "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("resid"))


def window_mean(df: DataFrame, time: str, y: str, by: str, size: int) -> DataFrame:
    """Trailing mean in each of many series."""
    w = Window.partitionBy(by).orderBy(time).rowsBetween(-(size - 1), 0)
    return df.withColumn("mean", F.avg(y).over(w))
