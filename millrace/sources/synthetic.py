"""Generated data sets: each row from its own number and a seed, so any size is made in place."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _normal(seed: int) -> F.Column:
    """A standard normal variate by row number: the same however rows are partitioned."""
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(k)), 11) + 0.5) / float(1 << 53)
    return F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2))


def _uniform(seed: int) -> F.Column:
    return (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed), F.lit(0)), 11) + 0.5) / float(1 << 53)


def make_classification(spark: SparkSession, n_samples: int = 100, n_features: int = 20, n_informative: int = 2, n_classes: int = 2, class_sep: float = 1.0, seed: int = 0) -> DataFrame:
    """id, x0.., label: classes are normal clouds around corners of a cube in the informative features."""
    corners = np.random.default_rng(seed).choice([-1.0, 1.0], (n_classes, n_informative)) * class_sep
    corners += np.arange(n_classes)[:, None] * 1e-3
    label = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(n_classes)).cast("int")
    cols = [_normal(seed * 1009 + j) + (F.element_at(F.array(*[F.lit(float(c)) for c in corners[:, j]]), label + 1) if j < n_informative else 0.0) for j in range(n_features)]
    return spark.range(n_samples).select("id", *[c.alias(f"x{j}") for j, c in enumerate(cols)], label.alias("label"))


def make_regression(spark: SparkSession, n_samples: int = 100, n_features: int = 100, n_informative: int = 10, noise: float = 0.0, seed: int = 0) -> DataFrame:
    coef = np.random.default_rng(seed).uniform(0, 100, min(n_informative, n_features))
    df = spark.range(n_samples).select("id", *[_normal(seed * 1009 + j).alias(f"x{j}") for j in range(n_features)])
    y = sum((F.col(f"x{j}") * float(c) for j, c in enumerate(coef)), F.lit(0.0)) + noise * _normal(seed + 77_777)
    return df.withColumn("label", y)


def make_blobs(spark: SparkSession, n_samples: int = 100, n_features: int = 2, centers: int = 3, cluster_std: float = 1.0, seed: int = 0) -> DataFrame:
    at = np.random.default_rng(seed).uniform(-10, 10, (centers, n_features))
    label = F.pmod(F.col("id"), F.lit(centers)).cast("int")
    cols = [_normal(seed * 1009 + j) * cluster_std + F.element_at(F.array(*[F.lit(float(c)) for c in at[:, j]]), label + 1) for j in range(n_features)]
    return spark.range(n_samples).select("id", *[c.alias(f"x{j}") for j, c in enumerate(cols)], label.alias("label"))


def _rings(spark: SparkSession, n: int, noise: float, seed: int, outer, inner) -> DataFrame:
    label, t = F.pmod(F.col("id"), F.lit(2)).cast("int"), _uniform(seed)
    x, y = (F.when(label == 0, outer(t)[k]).otherwise(inner(t)[k]) + noise * _normal(seed + 1 + k) for k in range(2))
    return spark.range(n).select("id", x.alias("x0"), y.alias("x1"), label.alias("label"))


def make_moons(spark: SparkSession, n_samples: int = 100, noise: float = 0.0, seed: int = 0) -> DataFrame:
    return _rings(spark, n_samples, noise, seed, lambda t: (F.cos(math.pi * t), F.sin(math.pi * t)), lambda t: (1 - F.cos(math.pi * t), 0.5 - F.sin(math.pi * t)))


def make_circles(spark: SparkSession, n_samples: int = 100, noise: float = 0.0, factor: float = 0.8, seed: int = 0) -> DataFrame:
    ring = lambda r: lambda t: (r * F.cos(2 * math.pi * t), r * F.sin(2 * math.pi * t))
    return _rings(spark, n_samples, noise, seed, ring(1.0), ring(factor))
