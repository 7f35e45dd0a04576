"""Nearest rows and sums over pairs. Both sides meet in blocks of a bounded size; only the best, or sums, leave a block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .base import BaseEstimator, RegressorMixin, matrix, vector
from .linear import _Classifier

BLOCK = 2048
#: Rows in a side of a tile.
SIDE = 1024


def _blocks(df: DataFrame, id_col: str, v: str, more: list[str], prefix: str) -> DataFrame:
    """One row for each block: ids, vectors and further columns as arrays. The rows go to blocks by a hash of the id."""
    n = max(1, -(-df.count() // BLOCK))
    cols = [F.collect_list(F.struct(F.col(id_col).alias("id"), F.col(v).alias("v"), *[F.col(m) for m in more])).alias(f"{prefix}_rows")]
    return df.groupBy(F.pmod(F.xxhash64(id_col), F.lit(n)).alias(f"{prefix}_block")).agg(*cols)


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "manhattan":
        return np.stack([np.abs(x - b).sum(1) for x in a]) if len(a) else np.zeros((0, len(b)))
    if metric == "cosine":
        size = lambda m: np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
        return 1 - (a / size(a)) @ (b / size(b)).T
    out = np.empty((len(a), len(b)))
    for i in range(0, len(a), 64):  # differences, not the product form: equal rows are at distance 0
        d = a[i : i + 64, None, :] - b[None, :, :]
        out[i : i + 64] = np.einsum("ijk,ijk->ij", d, d)
    return out if metric == "sqeuclidean" else np.sqrt(out)


def nearest(fitted: DataFrame, queries: DataFrame, k: int, metric: str = "euclidean", carry: str | None = None, skip_self: bool = False) -> DataFrame:
    """qid, id, distance, rank (and ``carry`` of the fitted row) of the k nearest; ties by id. Inputs: (id, v[, carry]) and (qid, q)."""
    more = [carry] if carry else []
    pairs = _blocks(queries, "qid", "q", [], "q").crossJoin(_blocks(fitted, "id", "v", more, "f"))  # blocks, not rows
    id_t, q_t = fitted.schema["id"].dataType.simpleString(), queries.schema["qid"].dataType.simpleString()
    extra = f", {carry} {fitted.schema[carry].dataType.simpleString()}" if carry else ""

    schema = to_arrow_schema(queries.select("qid").limit(0).join(fitted.select("id", F.lit(0.0).alias("distance"), *more).limit(0), how="cross").schema)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, f = r["q_rows"], r["f_rows"]
                d = _distances(np.asarray([x["v"] for x in q], "f8"), np.asarray([x["v"] for x in f], "f8"), metric)
                ids = np.asarray([x["id"] for x in f])
                out = {"qid": [], "id": [], "distance": [], **({carry: []} if carry else {})}
                for i, x in enumerate(q):
                    row = np.where(ids == x["id"], np.inf, d[i]) if skip_self else d[i]
                    near = np.flatnonzero(row <= np.partition(row, min(k, len(row)) - 1)[min(k, len(row)) - 1])
                    near = [j for j in near[np.lexsort((ids[near], row[near]))][:k] if row[j] < np.inf]
                    out["qid"] += [x["id"]] * len(near)
                    out["id"] += [f[j]["id"] for j in near]
                    out["distance"] += [float(row[j]) for j in near]
                    if carry:
                        out[carry] += [f[j][carry] for j in near]
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    found = pairs.select("q_rows", "f_rows").mapInArrow(best, f"qid {q_t}, id {id_t}, distance double{extra}")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def block_sums(rows: DataFrame) -> DataFrame:
    """Of (id, label, v): id, label, other, total, n: sums of distances to each cluster's rows, block by block."""
    a = _blocks(rows, "id", "v", ["label"], "q")
    pairs = a.crossJoin(_blocks(rows, "id", "v", ["label"], "f"))
    id_t, l_t = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()

    schema = to_arrow_schema(rows.select("id", "label", F.col("label").alias("other"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n")).schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pandas().to_dict("records"):
                q, f = r["q_rows"], r["f_rows"]
                d = _distances(np.asarray([x["v"] for x in q], "f8"), np.asarray([x["v"] for x in f], "f8"), "euclidean")
                other = pd.Series([x["label"] for x in f])
                parts = [pd.DataFrame({"id": [x["id"] for x in q], "label": [x["label"] for x in q], "other": c, "total": d[:, ix].sum(1), "n": len(ix)}) for c, ix in other.groupby(other).groups.items()]
                yield pa.RecordBatch.from_pandas(pd.concat(parts), schema=schema, preserve_index=False)

    return pairs.select("q_rows", "f_rows").mapInArrow(add, f"id {id_t}, label {l_t}, other {l_t}, total double, n long").groupBy("id", "label", "other").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def within(rows: DataFrame, radius: float, metric: str = "euclidean") -> DataFrame:
    """id, other, distance of pairs within the radius (each both ways, none with itself). Inputs: (id, v)."""
    pairs = _blocks(rows, "id", "v", [], "q").crossJoin(_blocks(rows, "id", "v", [], "f"))
    t = rows.schema["id"].dataType.simpleString()

    schema = to_arrow_schema(rows.select("id", F.col("id").alias("other"), F.lit(0.0).alias("distance")).schema)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q, f = r["q_rows"], r["f_rows"]
                d = _distances(np.asarray([x["v"] for x in q], "f8"), np.asarray([x["v"] for x in f], "f8"), metric)
                qi, fi = np.asarray([x["id"] for x in q]), np.asarray([x["id"] for x in f])
                a, b = np.nonzero((d <= radius) & (qi[:, None] != fi[None, :]))
                yield pa.RecordBatch.from_pydict({"id": qi[a], "other": fi[b], "distance": d[a, b]}, schema=schema)

    return pairs.select("q_rows", "f_rows").mapInArrow(near, f"id {t}, other {t}, distance double")


def tiles(rows: DataFrame, radius: float, metric: str = "euclidean") -> DataFrame:
    """``rows`` (id, v, ...), each once for every tile (c, p, d, q) it is in: a tile has two sides of some SIDE rows (one side, if p = q and d = 0), and rows within the radius share one.

    Rows lie in cells along their widest column, at least as wide as the radius, and meet those of their own cell and the next ones.
    """
    wide, cell = None, F.lit(0).cast("long")
    reach = {"cosine": np.inf, "sqeuclidean": np.sqrt(max(radius, 0))}.get(metric, max(radius, 0)) * (1 + 1e-9)
    if np.isfinite(reach):
        x = F.when(F.abs("x") < float("inf"), F.col("x"))  # neither NaN
        sides = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count("*").alias("n")).where("lo is not null").collect()
        wide = max(sides, key=lambda r: r["hi"] - r["lo"], default=None)
    if wide is not None:
        at, width = F.get("v", F.lit(wide["i"])), max(reach, (wide["hi"] - wide["lo"]) * (SIDE / 4 / wide["n"]))
        near = F.floor((at - wide["lo"]) / width).cast("long") if width else F.lit(0).cast("long")
        cell = F.when(F.abs(at) < float("inf"), near)  # others are at no distance
    rows = rows.where("v is not null").withColumn("c", cell).where("c is not null")
    sizes = rows.groupBy("c").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("own"))
    around = [sizes.select((F.col("c") + k).alias("c"), F.col("own").alias(name)) for k, name in ((-1, "next"), (1, "last"))]
    sizes = sizes.join(around[0], "c", "left").join(around[1], "c", "left")
    upto = lambda n: F.when(F.col(n).isNull(), F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.col(n) - 1))
    tile = lambda c, p, d, q, side: F.struct(c.alias("c"), p.alias("p"), F.lit(d).alias("d"), q.alias("q"), side.cast("int").alias("side"))
    c, own = F.col("c"), F.pmod(F.xxhash64("id"), F.col("own")).cast("int")
    mine = F.transform(upto("own"), lambda k: tile(c, F.least(own, k), 0, F.greatest(own, k), own > k))
    after = F.transform(upto("next"), lambda k: tile(c, own, 1, k, F.lit(0)))
    before = F.transform(upto("last"), lambda k: tile(c - 1, k, 1, own, F.lit(1)))
    placed = rows.join(F.broadcast(sizes), "c").withColumn("tile", F.explode(F.concat(mine, after, before)))
    return placed.select("tile.*", *[x for x in rows.columns if x != "c"])


def touching(pdf: pd.DataFrame, radius: float, metric: str) -> np.ndarray:
    """Which rows of a tile are within the radius of each other across its sides; none of itself."""
    x, ids, side = matrix(pdf["v"]), pdf["id"].to_numpy(), pdf["side"].to_numpy()
    near = np.zeros((len(pdf), len(pdf)), bool)
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if pdf["d"].iloc[0] == 0 and pdf["p"].iloc[0] == pdf["q"].iloc[0]:
        b = a
    near[np.ix_(a, b)] = (_distances(x[a], x[b], metric) <= radius) & (ids[a][:, None] != ids[b][None, :])
    return near | near.T


class NearestNeighbors(BaseEstimator):
    def __init__(self, n_neighbors=5, radius=1.0, metric="euclidean"):
        self.n_neighbors, self.radius, self.metric = n_neighbors, radius, metric

    def fit(self, df: DataFrame, features, id_col: str) -> "NearestNeighbors":
        self.features_, self.id_ = features, id_col
        self.fitted_ = df.select(F.col(f"`{id_col}`").alias("id"), vector(features).alias("v"))
        return self

    def _queries(self, df):
        return df.select(F.col(f"`{self.id_}`").alias("qid"), vector(self.features_).alias("q"))

    def kneighbors(self, df: DataFrame, k: int | None = None, skip_self: bool = False) -> DataFrame:
        return nearest(self.fitted_, self._queries(df), k or self.n_neighbors, self.metric, skip_self=skip_self)

    def kneighbors_graph(self, df: DataFrame, k: int | None = None) -> DataFrame:
        """row, col, value: 1 for each neighbour."""
        return self.kneighbors(df, k).select(F.col("qid").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value"))

    def radius_neighbors(self, radius: float | None = None) -> DataFrame:
        """Pairs of fitted rows within a distance."""
        return within(self.fitted_, radius or self.radius, self.metric)


class _KNN(BaseEstimator):
    def __init__(self, n_neighbors=5, weights="uniform", metric="euclidean"):
        self.n_neighbors, self.weights, self.metric = n_neighbors, weights, metric

    def _fitted(self, df, features, label, id_col):
        self.features_, self.label_, self.id_ = features, label, id_col
        self.fitted_ = df.select(F.col(f"`{id_col}`").alias("id"), vector(features).alias("v"), F.col(f"`{label}`").alias("y"))

    def _near(self, df):
        q = df.select(F.col(f"`{self.id_}`").alias("qid"), vector(self.features_).alias("q"))
        w = F.lit(1.0) if self.weights == "uniform" else 1 / F.greatest("distance", F.lit(1e-12))
        return nearest(self.fitted_, q, self.n_neighbors, self.metric, carry="y").withColumn("w", w)


class KNeighborsClassifier(_KNN, _Classifier):
    """The class of most weight among the nearest; ties to the smaller class."""

    def fit(self, df, features, label, id_col):
        self._classes(df, features, label)
        self._fitted(df, features, label, id_col)
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        votes = self._near(df).groupBy("qid", "y").agg(F.sum("w").alias("s"))
        best = votes.groupBy("qid").agg(F.min(F.struct((-F.col("s")).alias("s"), "y")).alias("b")).select(F.col("qid").alias("q_"), F.col("b.y").alias(out))
        return df.join(best, F.col(f"`{self.id_}`") == F.col("q_"), "left").drop("q_")

    def predict_proba(self, df: DataFrame) -> DataFrame:
        near = self._near(df)
        share = F.array(*[F.sum(F.when(F.col("y") == F.lit(c), F.col("w")).otherwise(0.0)) / F.sum("w") for c in self.classes_])
        p = near.groupBy(F.col("qid").alias("q_")).agg(share.alias("probability"))
        return df.join(p, F.col(f"`{self.id_}`") == F.col("q_"), "left").drop("q_")


class KNeighborsRegressor(_KNN, RegressorMixin):
    def fit(self, df, features, label, id_col):
        self._fitted(df, features, label, id_col)
        return self

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        p = self._near(df).groupBy(F.col("qid").alias("q_")).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias(out))
        return df.join(p, F.col(f"`{self.id_}`") == F.col("q_"), "left").drop("q_")
