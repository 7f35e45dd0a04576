"""Clusterings. Centres and labels are small; rows stay distributed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import BaseEstimator, ClusterMixin, matrix, moments, scored, vector
from .linear import assembled
from .tables import cut


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1), 0)


def assign(df: DataFrame, features, centers: np.ndarray, out: str = "cluster") -> DataFrame:
    """Nearest centre by expressions alone; the first on ties."""
    from .metrics import distance

    cs = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in centers])
    d = F.transform(cs, lambda c: distance(vector(features), c, "sqeuclidean"))
    return df.withColumn(out, (F.array_position(d, F.array_min(d)) - 1).cast("int"))


class KMeans(BaseEstimator, ClusterMixin):
    """Parallel k-means++ and Lloyd by MLlib, the best of several starts."""

    def __init__(self, n_clusters=8, n_init=10, max_iter=300, tol=1e-4, seed=0):
        self.n_clusters, self.n_init, self.max_iter, self.tol, self.seed = n_clusters, n_init, max_iter, tol, seed

    def fit(self, df: DataFrame, features) -> "KMeans":
        from pyspark.ml.clustering import KMeans as Fit

        if self.n_clusters == 1:  # MLlib takes two at least; one is the mean
            n, s, _ = moments(df, features)
            spread = moments(df, features, center=s / n)[2]
            self.features_, self.cluster_centers_, self.inertia_ = features, (s / n)[None, :], float(np.trace(spread))
            return self
        data = assembled(df, features).select("features_").cache()
        best = None
        for k in range(self.n_init):
            m = Fit(featuresCol="features_", k=self.n_clusters, maxIter=self.max_iter, tol=self.tol, seed=self.seed + k).fit(data)
            if best is None or m.summary.trainingCost < best.summary.trainingCost:
                best = m
        self.features_, self.cluster_centers_, self.inertia_ = features, np.asarray(best.clusterCenters()), best.summary.trainingCost
        data.unpersist()
        return self

    def predict(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        self._check_fitted()
        c = self.cluster_centers_
        return scored(df, self.features_, lambda x: squared(x, c).argmin(1), out, "int")

    def transform(self, df: DataFrame, out: str = "distances") -> DataFrame:
        c = self.cluster_centers_
        return scored(df, self.features_, lambda x: np.sqrt(squared(x, c)), out, "array<double>")

    def score(self, df: DataFrame) -> float:
        c = self.cluster_centers_
        return -(scored(df, self.features_, lambda x: squared(x, c).min(1), "d_").agg(F.sum("d_")).first()[0] or 0.0)


class MiniBatchKMeans(KMeans):
    """Centres move by running means over random batches of rows."""

    def __init__(self, n_clusters=8, batch_size=256, max_iter=50, seed=0):
        self.n_clusters, self.batch_size, self.max_iter, self.seed = n_clusters, batch_size, max_iter, seed

    def fit(self, df: DataFrame, features) -> "MiniBatchKMeans":
        data = df.select(vector(features).alias("v")).withColumn("h_", F.rand(self.seed)).cache()
        n, rng = data.count(), np.random.default_rng(self.seed)
        share = min(1.0, max(self.batch_size, 3 * self.n_clusters) / max(n, 1))
        take = lambda k: matrix(data.sample(False, min(1.0, share * 1.2), self.seed + k).select("v").limit(max(self.batch_size, 3 * self.n_clusters)).toPandas()["v"])  # noqa: E731  a batch
        first = take(0)
        centers = first[rng.choice(len(first), self.n_clusters, replace=len(first) < self.n_clusters)].astype(float)
        counts = np.zeros(self.n_clusters)
        for k in range(self.max_iter):
            x = take(k + 1)
            if not len(x):
                continue
            to = squared(x, centers).argmin(1)
            for j in np.unique(to):
                mine = x[to == j]
                counts[j] += len(mine)
                centers[j] += (mine.mean(0) - centers[j]) * len(mine) / counts[j]
        data.unpersist()
        self.features_, self.cluster_centers_ = features, centers
        return self


class Birch(MiniBatchKMeans):
    def __init__(self, n_clusters=3, batch_size=256, max_iter=50, seed=0):
        super().__init__(n_clusters, batch_size, max_iter, seed)


def components(edges: DataFrame) -> DataFrame:
    """node, root: least node of each connected component of (a, b). Labels spread and jump until none changes; lineage is cut each round."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    both = cut(both)
    labels = cut(both.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("low"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("root", "low").alias("root"), F.col("root").alias("old"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(step.join(jump, "root", "left").select("node", F.least("root", F.coalesce("far", "root")).alias("root"), "old"))
        if not new.where("root <> old").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")


def _joins(pdf, near: np.ndarray):
    """Of a tile whose rows touch as ``near`` says: (core, core, true) that joins its groups of cores, (row, core, false) of other rows and each group they touch."""
    import pandas as pd

    core = pdf["core"].to_numpy("bool")
    among = near[:, core].any(1)
    group = np.where(core, -1, -2)
    lone = core & ~among
    group[lone] = np.flatnonzero(lone)
    for s in np.flatnonzero(core & among):
        if group[s] < 0:
            front = np.asarray([s])
            while len(front):
                group[front] = s
                front = np.flatnonzero(near[front].any(0) & (group == -1))
    members = np.flatnonzero(core & (group != np.arange(len(pdf))))
    others, cores = np.flatnonzero(~core & among), np.flatnonzero(core)
    a, b = np.nonzero(near[np.ix_(others, cores)])
    pairs = np.unique(others[a] * len(pdf) + group[cores[b]])
    ids = pdf["id"].to_numpy()
    return pd.DataFrame({"id": ids[np.append(members, pairs // len(pdf))], "other": ids[np.append(group[members], pairs % len(pdf))], "link": np.arange(len(members) + len(pairs)) < len(members)})


class DBSCAN(BaseEstimator, ClusterMixin):
    """Rows with enough neighbours within eps (themselves counted) are cores; linked cores are a cluster, numbered by least row id; others join the first cluster that reaches them, or none (-1).

    Rows meet in tiles. A tile returns how many neighbours its rows have; then, of cores, links enough to join those that it joins, and for other rows one core of each group of its own. No pairs are kept.
    """

    def __init__(self, eps=0.5, min_samples=5, metric="euclidean"):
        self.eps, self.min_samples, self.metric = eps, min_samples, metric

    def fit_predict(self, df: DataFrame, features, id_col: str, out: str = "cluster") -> DataFrame:
        from .neighbors import tiles, touching
        from .split import running_count

        eps, metric, tile = self.eps, self.metric, ["c", "p", "d", "q"]
        rows = df.select(F.col(f"`{id_col}`").alias("id"), vector(features).alias("v"))
        kind = rows.schema["id"].dataType.simpleString()

        def count(pdf):
            return pdf[["id"]].assign(k=touching(pdf, eps, metric).sum(1))

        def join(pdf):
            return _joins(pdf, touching(pdf, eps, metric))

        near = tiles(rows, eps, metric).groupBy(*tile).applyInPandas(count, f"id {kind}, k long").groupBy("id").agg(F.sum("k").alias("k"))
        degrees = cut(rows.select("id").join(near, "id", "left").select("id", (F.coalesce("k", F.lit(0)) + 1).alias("k")))
        core = degrees.where(F.col("k") >= self.min_samples).select("id")
        some = rows.join(degrees.where((F.col("k") > 1) | (F.col("k") >= self.min_samples)).select("id", (F.col("k") >= self.min_samples).alias("core")), "id")
        found = cut(tiles(some, eps, metric).groupBy(*tile).applyInPandas(join, f"id {kind}, other {kind}, link boolean"))
        comps = components(found.where("link").select(F.col("id").alias("a"), F.col("other").alias("b")))
        root = core.join(comps, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
        number = running_count(root.select("root").distinct(), "root").withColumnRenamed("before", "c_")
        cored = root.join(number, "root").select("id", "c_")
        border = found.where("not link").select("id", "other").join(cored.select(F.col("id").alias("other"), "c_"), "other").groupBy("id").agg(F.min("c_").alias("c_"))
        found = cored.unionByName(border).withColumnRenamed("id", "i_")
        return df.join(found, F.col(f"`{id_col}`") == F.col("i_"), "left").withColumn(out, F.coalesce("c_", F.lit(-1)).cast("int")).drop("i_", "c_")

    def fit(self, df, features, id_col):
        self.labels_ = self.fit_predict(df, features, id_col)
        return self


class OPTICS(DBSCAN):
    """DBSCAN at the largest distance. Where that spans the whole table, all rows are neighbours and one aggregation tells the answer."""

    def __init__(self, max_eps=1e12, min_samples=5, metric="euclidean"):
        super().__init__(max_eps, min_samples, metric)
        self.max_eps = max_eps

    def fit_predict(self, df: DataFrame, features, id_col: str, out: str = "cluster") -> DataFrame:
        sides = df.select(F.posexplode(vector(features)).alias("i", "x")).groupBy("i").agg((F.max("x") - F.min("x")).alias("side"))
        span = sides.agg(F.coalesce(F.sum("side"), F.lit(0.0))).first()[0]  # no distance of the usual metrics is larger
        if self.metric != "cosine" and span <= self.max_eps:
            return df.withColumn(out, F.lit(0 if df.count() >= self.min_samples else -1))
        return super().fit_predict(df, features, id_col, out)


class AgglomerativeClustering(BaseEstimator, ClusterMixin):
    """Merges of the two nearest clusters, all of them told without a matrix of rows x rows: chains of nearest neighbours (single linkage: the least spanning tree).

    The driver holds the rows. Time grows with their square; complete and average linkage compare all rows of two clusters anew. Only where ``max_rows`` is given are more rows refused.
    """

    def __init__(self, n_clusters=2, linkage="ward", max_rows=None):
        self.n_clusters, self.linkage, self.max_rows = n_clusters, linkage, max_rows

    def fit_predict(self, df: DataFrame, features, id_col: str, out: str = "cluster") -> DataFrame:
        ids, x = bounded(df, features, id_col, self.max_rows)
        if not np.isfinite(x).all():
            raise ValueError("rows hold missing or infinite values")
        merges = _tree_merges(x) if self.linkage == "single" else _chain_merges(_Centroids(x) if self.linkage == "ward" else _Members(x, self.linkage))
        up = np.arange(len(x))

        def root(i: int) -> int:
            while up[i] != i:
                up[i] = i = up[up[i]]
            return i

        order = np.argsort([h for _, _, h in merges], kind="stable") if merges else []
        for k in order[: max(0, len(x) - self.n_clusters)]:
            i, j = sorted((root(merges[k][0]), root(merges[k][1])))
            up[j] = i
        member = np.asarray([root(i) for i in range(len(x))], "i8")
        return joined(df, id_col, ids, np.unique(member, return_inverse=True)[1], out)


def _tree_merges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """(row, row, distance) of the least spanning tree."""
    n, merges = len(x), []
    best, to, left = np.full(n, np.inf), np.zeros(n, "i8"), np.ones(n, bool)
    at = 0
    for _ in range(n - 1):
        left[at] = False
        d = ((x - x[at]) ** 2).sum(1)
        nearer = left & (d < best)
        best[nearer], to[nearer] = d[nearer], at
        best[at] = np.inf
        at = int(best.argmin()) if np.isfinite(best).any() else int(left.argmax())
        merges.append((int(to[at]), at, float(np.sqrt(best[at]))))
    return merges


class _Centroids:
    """Ward's distances from sizes and means alone. Merged clusters leave the arrays once they are a quarter of them."""

    def __init__(self, x: np.ndarray) -> None:
        self.c, self.inverse, self.row = x.T.copy(), np.ones(len(x)), np.arange(len(x))
        self.d, self.part = np.empty(len(x)), np.empty(len(x))

    def distances(self, a: int) -> np.ndarray:
        n = len(self.row)
        d, part = self.d[:n], self.part[:n]
        d.fill(0)
        for c in self.c:
            np.subtract(c, c[a], out=part)
            part *= part
            d += part
        np.add(self.inverse, self.inverse[a], out=part)
        d /= part
        d[a] = np.inf
        return d

    def merge(self, a: int, b: int) -> None:
        """``a`` takes ``b``, which is at an infinite distance from then on."""
        size = 1 / self.inverse[[a, b]]
        self.c[:, a] = (self.c[:, [a, b]] * size).sum(1) / size.sum()
        self.inverse[a] = 1 / size.sum()
        self.c[:, b] = np.inf

    def compact(self, alive: np.ndarray) -> None:
        self.c, self.inverse, self.row = np.ascontiguousarray(self.c[:, alive]), self.inverse[alive], self.row[alive]


class _Members:
    """Largest or mean distance between the rows of two clusters, from the rows."""

    def __init__(self, x: np.ndarray, linkage: str) -> None:
        if linkage not in ("complete", "average"):
            raise ValueError(f"no linkage {linkage}")
        self.x, self.row, self.mean = x, np.arange(len(x)), linkage == "average"
        self.of, self.rows, self.gone = np.arange(len(x)), [np.asarray([i]) for i in range(len(x))], np.zeros(len(x), bool)

    def distances(self, a: int) -> np.ndarray:
        far = np.zeros(len(self.x))
        for lo in range(0, len(self.rows[a]), 64):
            d = np.sqrt(squared(self.x, self.x[self.rows[a][lo : lo + 64]]))
            far = far + d.sum(1) if self.mean else np.maximum(far, d.max(1))
        if self.mean:
            n = np.bincount(self.of, minlength=len(self.row))
            out = np.bincount(self.of, far, len(self.row)) / np.maximum(n * len(self.rows[a]), 1)
        else:
            out = np.zeros(len(self.row))
            np.maximum.at(out, self.of, far)
        out[self.gone] = np.inf
        out[a] = np.inf
        return out

    def merge(self, a: int, b: int) -> None:
        self.of[self.rows[b]] = a
        self.rows[a], self.rows[b], self.gone[b] = np.concatenate([self.rows[a], self.rows[b]]), None, True

    def compact(self, alive: np.ndarray) -> None:
        at = np.cumsum(alive) - 1
        self.of, self.rows, self.row, self.gone = at[self.of], [r for r, k in zip(self.rows, alive) if k], self.row[alive], self.gone[alive]


def _chain_merges(space) -> list[tuple[int, int, float]]:
    """(row, row, height) of all merges. From any cluster, step to the nearest until two are nearest to each other: they merge in the whole tree too, as no merge of these linkages comes nearer to others than its parts. A merge is no lower than those below it."""
    n = len(space.row)
    merges, chain, alive, height, first = [], [], np.ones(n, bool), np.zeros(n), 0
    while len(merges) < n - 1:
        if not chain:
            while not alive[first]:
                first += 1
            chain.append(first)
        a = chain[-1]
        d = space.distances(a)
        b = int(d.argmin())
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            b = chain[-2]
        if len(chain) < 2 or b != chain[-2]:
            chain.append(b)
            continue
        del chain[-2:]
        low = float(d[b])
        a, b = min(a, b), max(a, b)
        height[a] = max(low, height[a], height[b])
        merges.append((int(space.row[a]), int(space.row[b]), height[a]))
        space.merge(a, b)
        alive[b] = False
        if 4 * (n - len(merges)) < 3 * len(alive):
            at = np.cumsum(alive) - 1
            chain, first = [int(at[k]) for k in chain], 0
            space.compact(alive)
            height, alive = height[alive], np.ones(n - len(merges), bool)
    return merges


class MeanShift(BaseEstimator, ClusterMixin):
    """Every row climbs to a mode of a Gaussian density over all rows; modes nearer than the bandwidth are one. Only where ``max_seeds`` is given does a sample of so many rows climb instead.

    Where cells of a quarter of the bandwidth are few against the rows, the density is that of the cells' moments, expanded until what is left out is below rounding; tasks climb with that table. Else a round weighs rows x rows, in blocks. The driver holds the climbed rows.
    """

    def __init__(self, bandwidth=1.0, max_iter=50, max_seeds=None, seed=0):
        self.bandwidth, self.max_iter, self.max_seeds, self.seed = bandwidth, max_iter, max_seeds, seed

    def fit(self, df: DataFrame, features) -> "MeanShift":
        data = df.select(vector(features).alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("n")).cache()  # equal rows climb alike
        order = F.xxhash64("v", F.lit(self.seed)).alias("h")
        starts = data.select(order, "v") if self.max_seeds is None else df.select(vector(features).alias("v")).select(order, "v").orderBy("h").limit(self.max_seeds)
        seeds = self._by_cells(data, starts)
        if seeds is None:
            seeds = self._by_rows(data, matrix(starts.orderBy("h").toPandas()["v"]))
        data.unpersist()
        modes: list[np.ndarray] = []
        while len(seeds):
            modes.append(seeds[0])
            seeds = seeds[np.linalg.norm(seeds - seeds[0], axis=1) > self.bandwidth]
        self.features_, self.cluster_centers_ = features, np.asarray(modes)
        return self

    def _by_rows(self, data: DataFrame, seeds: np.ndarray) -> np.ndarray:
        h = 2 * self.bandwidth**2
        for _ in range(self.max_iter):
            at = seeds
            sums = data.mapInPandas(lambda it, at=at: _shift(((matrix(b["v"]), b["n"].to_numpy()) for b in it if len(b)), at, h), "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas().sort_values("cell")["x"].to_numpy().reshape(len(seeds), -1)
            seeds = sums[:, :-1] / np.maximum(sums[:, -1:], 1e-300)
            if np.abs(seeds - at).max() < 1e-4 * self.bandwidth:
                break
        return seeds

    def _by_cells(self, data: DataFrame, starts: DataFrame) -> np.ndarray | None:
        """The climbed rows in order of their hash; none where cells save nothing."""
        import pandas as pd

        sides = data.select("n", F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).orderBy("i").collect()
        lo, hi = (np.asarray([r[k] for r in sides], "f8") for k in ("lo", "hi"))
        if not len(lo) or not (np.isfinite(lo) & np.isfinite(hi)).all() or len({r["n"] for r in sides}) > 1:
            return None
        rows, steps, moves, unit = sides[0]["n"], self.max_iter, np.flatnonzero(hi > lo), self.bandwidth
        terms = _powers(len(moves), _order(len(moves)))
        width = 1 + len(moves)
        if len(terms) * 4 >= rows or ((hi - lo) / unit > 2.0**40).any():
            return None
        cell = F.array(*[F.floor((F.get("v", F.lit(int(i))) - float(lo[i])) / (unit * CELL)).cast("long") for i in moves], F.lit(0).cast("long"))
        cells = data.select(cell.alias("c")).distinct().limit(rows // len(terms) + 1).count()
        if cells * len(terms) >= rows:
            return None

        def add(batches):
            sums: dict = {}
            for whole in batches:
                for k in range(0, len(whole), step := max(1, MOST // (len(terms) * width))):
                    b = whole[k : k + step]
                    at = (matrix(b["v"])[:, moves] - lo[moves]) / unit
                    cs = np.asarray(b["c"].tolist(), "i8").reshape(len(b), -1)
                    u = at - (cs[:, :-1] + 0.5) * CELL
                    m = b["n"].to_numpy() * np.exp(-(u * u).sum(1) / 2)
                    mono = np.stack(_monomials(u, terms, True), 1) * m[:, None]
                    full = np.concatenate([mono[:, :, None], mono[:, :, None] * u[:, None, :]], 2).reshape(len(b), -1)
                    keys, of = np.unique(cs, axis=0, return_inverse=True)
                    by = np.argsort(of.ravel(), kind="stable")
                    parts = np.add.reduceat(full[by], np.searchsorted(of.ravel()[by], np.arange(len(keys))))
                    for key, x in zip(map(tuple, keys.tolist()), parts):
                        sums[key] = sums.get(key, 0) + x
            for key, x in sums.items():
                yield pd.DataFrame({"c": [list(key)] * len(x), "term": np.arange(len(x)), "x": x})

        table = data.select("v", "n", cell.alias("c")).mapInPandas(add, "c array<long>, term int, x double").groupBy("c", "term").agg(F.sum("x").alias("x")).orderBy("c", "term").toPandas()
        per = len(terms) * width
        centers = (np.asarray(table["c"].tolist()[::per], "f8").reshape(-1, len(moves) + 1)[:, :-1] + 0.5) * CELL
        sums = table["x"].to_numpy().reshape(len(centers), len(terms), width).copy()
        sums[:, :, 1:] += sums[:, :, :1] * centers[:, None, :]
        held = data.sparkSession.sparkContext.broadcast((centers, sums))

        def climb(batches):
            for b in batches:
                if len(b):
                    x = matrix(b["v"])
                    at = (x[:, moves] - lo[moves]) / unit
                    for _ in range(steps):
                        was, at = at, _density(at, *held.value, terms)
                        if np.abs(at - was).max(initial=0) < 1e-4:
                            break
                    x[:, moves] = lo[moves] + at * unit
                    yield pd.DataFrame({"h": b["h"], "v": list(x)})

        work = rows * cells * len(terms)
        tasks = int(min(max(1, work // 2**24), 8 * data.sparkSession.sparkContext.defaultParallelism))
        got = starts.repartition(tasks).mapInPandas(climb, "h long, v array<double>").orderBy("h", "v").toPandas()
        held.unpersist()
        return matrix(got["v"])

    predict = KMeans.predict


#: Side of a cell in bandwidths, and what the expansion may leave out of a row's weight.
CELL, LEFT_OUT = 0.25, 1e-16
#: Numbers that a step of the expansion holds.
MOST = 1 << 21


def _order(d: int) -> int:
    """Powers needed in ``d`` columns: the rest of the series of e^(r u), u half a cell's diagonal, times e^(-r^2/2), at any distance r."""
    from math import factorial

    u, r = CELL / 2 * np.sqrt(d), np.linspace(0, 40, 4001)
    p = 1
    while (np.exp(r * u - r * r / 2) * (r * u) ** p).max() / factorial(p) > LEFT_OUT:
        p += 1
    return p


def _powers(d: int, order: int) -> list[tuple[int, int, int]]:
    """Monomials of ``d`` columns below ``order``: (the one it extends, by which column, that column's power); the first is 1."""
    out, last = [(-1, -1, 0)], [(0, 0, 0)]
    for _ in range(1, order):
        new = []
        for k, first, p in last:
            for j in range(first, d):
                n = p + 1 if j == first and k else 1
                out.append((k, j, n))
                new.append((len(out) - 1, j, n))
        last = new
    return out


def _monomials(u: np.ndarray, terms: list[tuple[int, int, int]], scaled: bool = False) -> list[np.ndarray]:
    """Each monomial of the last axis; ``scaled`` by its factorials."""
    out = [np.ones(u.shape[:-1])]
    for k, j, n in terms[1:]:
        out.append(out[k] * u[..., j] / n if scaled else out[k] * u[..., j])
    return out


def _density(at: np.ndarray, centers: np.ndarray, sums: np.ndarray, terms: list[tuple[int, int, int]]) -> np.ndarray:
    """The mean of all rows, weighed by their distance from each place."""
    out, step = np.empty_like(at), max(1, MOST // (len(centers) * len(terms)))
    for lo in range(0, len(at), step):
        d = at[lo : lo + step, None, :] - centers[None]
        w = np.exp(-(d * d).sum(2) / 2)
        total = sum((w * m) @ sums[:, k] for k, m in enumerate(_monomials(d, terms)))
        out[lo : lo + step] = total[:, 1:] / total[:, :1]
    return out


def _shift(blocks, at, h, most=512):
    """Weighted sums of a task's rows (and how often they occur) around each place of ``at``, ``most`` places at a time."""
    import pandas as pd

    d = at.shape[1] + 1
    sums = np.zeros((len(at), d))
    for x, n in blocks:
        for lo in range(0, len(at), most):
            w = np.exp(-squared(at[lo : lo + most], x) / h) * n
            sums[lo : lo + most] += np.concatenate([w @ x, w.sum(1, keepdims=True)], 1)
    for lo in range(0, len(at), most):
        out = sums[lo : lo + most].ravel()
        yield pd.DataFrame({"cell": lo * d + np.arange(len(out)), "x": out})


def bounded(df: DataFrame, features, id_col: str, most: int | None) -> tuple[list, np.ndarray]:
    """Ids and matrix on the driver, in order of the id; an error beyond ``most`` rows, if given. For methods defined by all distances."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), vector(features).alias("v")).orderBy("id")
    got = (rows if most is None else rows.limit(most + 1)).toPandas()
    if most is not None and len(got) > most:
        raise ValueError(f"more than {most} rows; this method holds a matrix of rows x rows")
    return got["id"].tolist(), matrix(got["v"])


def joined(df: DataFrame, id_col: str, ids: list, values, out: str, kind: str = "int") -> DataFrame:
    """``df`` with a value for each id, made on the driver."""
    t = df.schema[id_col].dataType.simpleString()
    rows = [(i, v.tolist() if isinstance(v, np.ndarray) else v.item() if isinstance(v, np.generic) else v) for i, v in zip(ids, values)]
    small = df.sparkSession.createDataFrame(rows, f"i_ {t}, {out} {kind}")
    return df.join(F.broadcast(small), F.col(f"`{id_col}`") == F.col("i_")).drop("i_")


class GaussianMixture(BaseEstimator, ClusterMixin):
    """Expectation maximisation: each round is one pass that sums weighted moments, whatever the shape of covariances (full, tied, diag, spherical)."""

    def __init__(self, n_components=1, covariance_type="full", tol=1e-3, reg_covar=1e-6, max_iter=100, seed=0):
        self.n_components, self.covariance_type, self.tol, self.reg_covar, self.max_iter, self.seed = n_components, covariance_type, tol, reg_covar, max_iter, seed

    def fit(self, df: DataFrame, features) -> "GaussianMixture":
        import pandas as pd

        data = df.select(vector(features).alias("v")).cache()
        self.features_, k = features, self.n_components
        km = KMeans(k, n_init=1, seed=self.seed).fit(data, "v")
        n, s, g = moments(data, "v")
        self.n_, d = n, len(s)
        cov = g / n - np.outer(s, s) / n**2
        self.means_, self.weights_ = km.cluster_centers_.copy(), np.full(k, 1 / k)
        self.covariances_ = np.stack([self._shape(cov)] * k)
        before, self.converged_ = -np.inf, False
        for self.n_iter_ in range(1, self.max_iter + 1):
            m = (self.means_, self.weights_, self.covariances_)

            def add(batches, m=m):
                for b in batches:
                    if len(b):
                        x = matrix(b["v"])
                        lp = log_density(x, *m)
                        top = lp.max(1, keepdims=True)
                        total = np.log(np.exp(lp - top).sum(1, keepdims=True)) + top
                        r = np.exp(lp - total)
                        out = np.concatenate([[total.sum()], r.sum(0), (r.T @ x).ravel(), np.einsum("nk,ni,nj->kij", r, x, x).ravel()])
                        yield pd.DataFrame({"cell": np.arange(len(out)), "x": out})

            got = data.mapInPandas(add, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas().sort_values("cell")["x"].to_numpy()
            ll, nk = got[0] / n, np.maximum(got[1 : 1 + k], 1e-10)
            self.means_ = got[1 + k : 1 + k + k * d].reshape(k, d) / nk[:, None]
            second = got[1 + k + k * d :].reshape(k, d, d) / nk[:, None, None] - np.einsum("ki,kj->kij", self.means_, self.means_)
            self.weights_ = nk / nk.sum()
            if self.covariance_type == "tied":
                second = np.stack([np.einsum("k,kij->ij", self.weights_, second)] * k)
            self.covariances_ = np.stack([self._shape(c) for c in second])
            self.lower_bound_ = ll
            if abs(ll - before) < self.tol:
                self.converged_ = True
                break
            before = ll
        data.unpersist()
        return self

    def _shape(self, c):
        eye = np.eye(len(c))
        if self.covariance_type == "diag":
            c = np.diag(np.diag(c))
        elif self.covariance_type == "spherical":
            c = eye * np.trace(c) / len(c)
        return c + self.reg_covar * eye

    def predict_proba(self, df: DataFrame, out: str = "probability") -> DataFrame:
        m = (self.means_, self.weights_, self.covariances_)

        def f(x):
            lp = log_density(x, *m)
            e = np.exp(lp - lp.max(1, keepdims=True))
            return e / e.sum(1, keepdims=True)

        return scored(df, self.features_, f, out, "array<double>")

    def predict(self, df: DataFrame, out: str = "cluster") -> DataFrame:
        m = (self.means_, self.weights_, self.covariances_)
        return scored(df, self.features_, lambda x: log_density(x, *m).argmax(1), out, "int")

    def score(self, df: DataFrame) -> float:
        m = (self.means_, self.weights_, self.covariances_)
        return scored(df, self.features_, lambda x: np.logaddexp.reduce(log_density(x, *m), 1), "l_").agg(F.avg("l_")).first()[0]

    def _free(self):
        k, d = self.means_.shape
        cov = {"full": k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": k * d, "spherical": k}[self.covariance_type]
        return cov + k * d + k - 1

    def bic(self, df):
        n = df.count()
        return -2 * self.score(df) * n + self._free() * np.log(n)

    def aic(self, df):
        return -2 * self.score(df) * df.count() + 2 * self._free()

    def sample(self, n: int = 1, seed: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed if seed is None else seed)
        y = rng.choice(len(self.weights_), n, p=self.weights_)
        return np.asarray([rng.multivariate_normal(self.means_[c], self.covariances_[c]) for c in y]), y


def log_density(x, means, weights, covs):
    out = []
    for m, w, c in zip(means, weights, covs):
        half = np.linalg.cholesky(c)
        z = np.linalg.solve(half, (x - m).T)
        out.append(np.log(max(w, 1e-300)) - 0.5 * ((z * z).sum(0) + x.shape[1] * np.log(2 * np.pi)) - np.log(np.diag(half)).sum())
    return np.stack(out, 1)
