"""Metrics of predictions and clusterings; each is one aggregation, or a few over grouped counts.

Functions that end in ``_df`` return one-row (or few-row) DataFrames; the others the number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import vector
from .quantiles import quantiles


def _w(weight: str | None) -> Column:
    return F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _first(df: DataFrame) -> float | None:
    v = df.first()[0]
    return None if v is None else float(v)


def cells(df: DataFrame, y: str, p: str, weight: str | None = None) -> DataFrame:
    """y, p, n: the contingency table, a row for each pair that occurs."""
    return df.groupBy(_c(y).alias("y"), _c(p).alias("p")).agg(F.sum(_w(weight)).alias("n"))


def accuracy_score(df, y, p, weight=None, normalize=True):
    hit = F.sum(_w(weight) * F.coalesce((_c(y) == _c(p)).cast("double"), F.lit(0.0)))
    return _first(df.agg((hit / F.sum(_w(weight)) if normalize else hit).alias("v"))) or 0.0


def zero_one_loss(df, y, p, normalize=True):
    return 1 - accuracy_score(df, y, p) if normalize else df.count() - accuracy_score(df, y, p, normalize=False)


def confusion_df(df, y, p, labels=None, weight=None, normalize=None) -> DataFrame:
    """y, p, n of all pairs of labels, zeros included; shares of the row (true), column (pred) or whole (all)."""
    c = cells(df, y, p, weight)
    known = c.select(F.col("y").alias("l")).union(c.select("p")).distinct() if labels is None else df.sparkSession.createDataFrame([(x,) for x in labels], ["l"])
    grid = known.select(F.col("l").alias("y")).crossJoin(known.select(F.col("l").alias("p")))
    full = grid.join(c, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0.0)).alias("n"))
    if normalize:
        w = {"true": Window.partitionBy("y"), "pred": Window.partitionBy("p"), "all": Window.partitionBy()}[normalize]
        full = full.withColumn("n", F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(w)), F.lit(0.0)))
    return full


def prf_df(df, y, p, weight=None, zero_division: float = 0.0) -> DataFrame:
    """label, precision, recall, f1, support by label."""
    c = cells(df, y, p, weight)
    each = c.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0.0).alias("tp"), F.col("n").alias("t"), F.lit(0.0).alias("q")), F.struct(F.col("p").alias("label"), F.lit(0.0).alias("tp"), F.lit(0.0).alias("t"), F.col("n").alias("q")))).alias("x")).select("x.*")
    s = each.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("q").alias("pred"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(float(zero_division)))
    s = s.withColumn("precision", div(F.col("tp"), F.col("pred"))).withColumn("recall", div(F.col("tp"), F.col("support")))
    return s.withColumn("f1", div(2 * F.col("tp"), F.col("pred") + F.col("support"))).select("label", "precision", "recall", "f1", "support", "tp", "pred")


def prf_average_df(df, y, p, average="macro", zero_division: float = 0.0) -> DataFrame:
    e = prf_df(df, y, p, zero_division=zero_division)
    if average == "micro":
        r = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
        return e.agg(r("tp", "pred").alias("precision"), r("tp", "support").alias("recall"), F.coalesce(F.try_divide(2 * F.sum("tp"), F.sum(F.col("pred") + F.col("support"))), F.lit(0.0)).alias("f1"))
    w = F.col("support") if average == "weighted" else F.lit(1.0)
    return e.agg(*[F.coalesce(F.try_divide(F.sum(F.col(m) * w), F.sum(w)), F.lit(0.0)).alias(m) for m in ("precision", "recall", "f1")])


def precision_recall_fscore_support(df, y, p, average=None, zero_division=0.0):
    return (prf_df(df, y, p, zero_division=zero_division) if average is None else prf_average_df(df, y, p, average, zero_division)).collect()


def _prf(df, y, p, m, average, pos_label):
    if average == "binary":
        r = prf_df(df, y, p).where(F.col("label") == F.lit(pos_label)).select(m).first()
        return float(r[0]) if r else 0.0
    return float(prf_average_df(df, y, p, average).select(m).first()[0])


def precision_score(df, y, p, average="binary", pos_label=1):
    return _prf(df, y, p, "precision", average, pos_label)


def recall_score(df, y, p, average="binary", pos_label=1):
    return _prf(df, y, p, "recall", average, pos_label)


def f1_score(df, y, p, average="binary", pos_label=1):
    return _prf(df, y, p, "f1", average, pos_label)


def balanced_accuracy_score(df, y, p):
    return _first(prf_df(df, y, p).where("support > 0").agg(F.avg("recall")))


def matthews_df(df, y, p) -> DataFrame:
    """The correlation of K classes from marginal and diagonal sums."""
    s = prf_df(df, y, p).agg(F.sum("tp").alias("c"), F.sum("support").alias("s"), F.sum(F.col("support") * F.col("pred")).alias("tp"), F.sum(F.col("support") ** 2).alias("tt"), F.sum(F.col("pred") ** 2).alias("pp"))
    return s.select(F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), F.sqrt((F.col("s") ** 2 - F.col("pp")) * (F.col("s") ** 2 - F.col("tt")))), F.lit(0.0)).alias("mcc"))


def matthews_corrcoef(df, y, p):
    return _first(matthews_df(df, y, p))


def score_steps(df, y, score, pos_label=1) -> DataFrame:
    """score, pos, neg, and tp, fp up to and with that score, best first: a row for each distinct score."""
    from .split import running_count

    g = df.groupBy(_c(score).alias("score")).agg(F.sum((_c(y) == F.lit(pos_label)).cast("long")).alias("pos"), F.count("*").alias("n")).withColumn("neg", F.col("n") - F.col("pos")).withColumn("k", -F.col("score"))
    tp = running_count(g, "k", "pos").withColumn("tp", F.col("before") + F.col("pos")).drop("before")
    return running_count(tp, "k", "neg").withColumn("fp", F.col("before") + F.col("neg")).select("score", "pos", "neg", "tp", "fp")


def roc_auc_df(df, y, score, pos_label=1) -> DataFrame:
    """Area by trapezoids over distinct scores; 0.5 with a single class."""
    s = score_steps(df, y, score, pos_label)
    area = F.sum((F.col("tp") - F.col("pos") / 2) * F.col("neg"))
    return s.agg(F.coalesce(F.try_divide(area.cast("double"), (F.sum("pos") * F.sum("neg")).cast("double")), F.lit(0.5)).alias("auc"))


def roc_auc_score(df, y, score, pos_label=1, classes=None):
    """With ``classes``, ``score`` is a list of columns and the result the mean of one class against the rest."""
    if classes:
        each = [roc_auc_score(df.withColumn("is_", (_c(y) == F.lit(c)).cast("int")), "is_", s) for c, s in zip(classes, score)]
        return sum(each) / len(each)
    return _first(roc_auc_df(df, y, score, pos_label))


def roc_curve(df, y, score, pos_label=1) -> DataFrame:
    """threshold, fpr, tpr by distinct score; the last row of ties counts. A start (inf, 0, 0) comes first."""
    s = score_steps(df, y, score, pos_label)
    t = s.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    out = s.crossJoin(F.broadcast(t)).select(F.col("score").cast("double").alias("threshold"), F.coalesce(F.try_divide(F.col("fp"), F.col("N")), F.lit(0.0)).alias("fpr"), F.coalesce(F.try_divide(F.col("tp"), F.col("P")), F.lit(0.0)).alias("tpr"))
    return out.union(df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], out.schema))


def precision_recall_curve(df, y, score, pos_label=1) -> DataFrame:
    s = score_steps(df, y, score, pos_label)
    t = s.agg(F.sum("pos").alias("P"))
    return s.crossJoin(F.broadcast(t)).select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("P")), F.lit(0.0)).alias("recall"))


def average_precision_df(df, y, score, pos_label=1) -> DataFrame:
    s = score_steps(df, y, score, pos_label)
    return s.agg(F.coalesce(F.try_divide(F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))), F.sum("pos").cast("double")), F.lit(0.0)).alias("ap"))


def average_precision_score(df, y, score, pos_label=1):
    return _first(average_precision_df(df, y, score, pos_label))


def log_loss(df, y, proba, eps=1e-15, classes=None):
    """Of one probability column, or of columns in the order of ``classes``."""
    clipped = lambda c: F.least(F.greatest(c, F.lit(eps)), F.lit(1 - eps))
    if classes:
        total = sum((_c(p) for p in proba), F.lit(0.0))
        hit = F.coalesce(*[F.when(_c(y) == F.lit(c), _c(p)) for c, p in zip(classes, proba)])
        return _first(df.agg(F.avg(-F.log(clipped(hit / total)))))
    q = clipped(_c(proba))
    return _first(df.agg(F.avg(-F.when(_c(y) == 1, F.log(q)).otherwise(F.log(1 - q)))))


def hinge_loss(df, y, decision):
    return _first(df.agg(F.avg(F.greatest(F.lit(0.0), 1 - F.when(_c(y) > 0, 1.0).otherwise(-1.0) * _c(decision)))))


def brier_score_loss(df, y, proba):
    return _first(df.agg(F.avg((_c(proba) - _c(y)) ** 2)))


def top_k_accuracy_score(df, y, probas, classes, k=2):
    own = F.coalesce(*[F.when(_c(y) == F.lit(c), _c(p)) for c, p in zip(classes, probas)])
    better = sum(((_c(p) > own).cast("int") for p in probas), F.lit(0))
    return _first(df.agg(F.avg((better < k).cast("double"))))


def regression_df(df, y, p, weight=None) -> DataFrame:
    """mse, rmse, mae, medae, max_error, r2, explained_variance, mape, msle in a few passes."""
    a, b, w = _c(y).cast("double"), _c(p).cast("double"), _w(weight)
    d = a - b
    mean = lambda e: F.sum(w * e) / F.sum(w)
    m = df.agg(mean(a).alias("m_"), mean(d).alias("d_"))
    half = quantiles(df, {"d": F.abs(d)}, [0.5])["d"]
    r = df.crossJoin(F.broadcast(m)).agg(
        mean(d * d).alias("mse"), F.sqrt(mean(d * d)).alias("rmse"), mean(F.abs(d)).alias("mae"), F.lit(half and half[0]).cast("double").alias("medae"), F.max(F.abs(d)).alias("max_error"),
        F.coalesce(1 - F.try_divide(F.sum(w * d * d), F.sum(w * (a - F.col("m_")) ** 2)), F.when(F.sum(w * d * d) == 0, 1.0).otherwise(0.0)).alias("r2"),
        F.coalesce(1 - F.try_divide(F.sum(w * (d - F.col("d_")) ** 2), F.sum(w * (a - F.col("m_")) ** 2)), F.when(F.sum(w * (d - F.col("d_")) ** 2) == 0, 1.0).otherwise(0.0)).alias("explained_variance"),
        F.avg(F.when(a != 0, F.abs(d / a))).alias("mape"), F.avg((F.log1p(F.when(a >= 0, a)) - F.log1p(F.when(b >= 0, b))) ** 2).alias("msle"), F.min(F.least(a, b)).alias("least"),
    )
    return r


def mean_squared_error(df, y, p, weight=None, squared=True):
    return float(regression_df(df, y, p, weight).select("mse" if squared else "rmse").first()[0])


def root_mean_squared_error(df, y, p):
    return mean_squared_error(df, y, p, squared=False)


def mean_absolute_error(df, y, p, weight=None):
    return float(regression_df(df, y, p, weight).select("mae").first()[0])


def median_absolute_error(df, y, p):
    return float(regression_df(df, y, p).select("medae").first()[0])


def max_error(df, y, p):
    return float(regression_df(df, y, p).select("max_error").first()[0])


def r2_score(df, y, p, weight=None):
    if isinstance(y, (list, tuple)):
        return [r2_score(df, a, b, weight) for a, b in zip(y, p)]
    return float(regression_df(df, y, p, weight).select("r2").first()[0])


def explained_variance_score(df, y, p):
    return float(regression_df(df, y, p).select("explained_variance").first()[0])


def mean_absolute_percentage_error(df, y, p):
    return float(regression_df(df, y, p).select("mape").first()[0] or 0.0)


def mean_squared_log_error(df, y, p):
    r = regression_df(df, y, p).select("msle", "least").first()
    if r["least"] < 0:
        raise ValueError("negative values have no logarithm here")
    return float(r["msle"])


def distance(a: Column, b: Column, metric: str = "euclidean") -> Column:
    """Of two array columns."""
    add = lambda f: F.aggregate(F.zip_with(a, b, f), F.lit(0.0), lambda s, x: s + x)
    if metric == "cosine":
        return 1 - F.try_divide(add(lambda x, y: x * y), F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x) * F.aggregate(b, F.lit(0.0), lambda s, x: s + x * x)))
    if metric == "manhattan":
        return add(lambda x, y: F.abs(x - y))
    sq = add(lambda x, y: (x - y) * (x - y))
    return sq if metric == "sqeuclidean" else F.sqrt(sq)


def pairwise_distances(a: DataFrame, b: DataFrame, features, id_col: str, metric: str = "euclidean") -> DataFrame:
    """a, b, distance of all pairs of two tables: what is asked for is that product."""
    left = a.select(_c(id_col).alias("a"), vector(features).alias("x"))
    right = b.select(_c(id_col).alias("b"), vector(features).alias("y"))
    return left.crossJoin(right).select("a", "b", distance(F.col("x"), F.col("y"), metric).alias("distance"))


def _choose2(c) -> Column:
    return F.sum(F.col(c) * (F.col(c) - 1) / 2)


def cluster_pairs_df(df, a, b) -> DataFrame:
    """Entropies and numbers of pairs of two labellings, in one row, from the contingency table."""
    c = cells(df, a, b)
    h = lambda t: F.sum(-F.col("n") / F.col("t_") * F.log(F.col("n") / F.col("t_"))).alias(t)
    t = c.agg(F.sum("n").alias("t_"))
    part = lambda g, e, q: c.groupBy(g).agg(F.sum("n").alias("n")).crossJoin(F.broadcast(t)).agg(h(e), _choose2("n").alias(q))
    joint = c.crossJoin(F.broadcast(t)).agg(h("h_ab"), _choose2("n").alias("s_ab"), F.first("t_").alias("t"))
    return joint.crossJoin(part("y", "h_a", "s_a")).crossJoin(part("p", "h_b", "s_b"))


def cluster_scores_df(df, a, b) -> DataFrame:
    """ari, fowlkes_mallows, mutual_info, homogeneity, completeness, v_measure."""
    r = cluster_pairs_df(df, a, b)
    c = F.col
    exp = c("s_a") * c("s_b") / (c("t") * (c("t") - 1) / 2)
    half = 0.5 * (c("s_a") + c("s_b"))
    mi = F.greatest(c("h_a") + c("h_b") - c("h_ab"), F.lit(0.0))
    hom = F.when(c("h_a") > 1e-15, mi / c("h_a")).otherwise(1.0)
    com = F.when(c("h_b") > 1e-15, mi / c("h_b")).otherwise(1.0)
    r = r.select(F.coalesce(F.try_divide(c("s_ab") - exp, half - exp), F.lit(1.0)).alias("ari"), F.coalesce(F.try_divide(c("s_ab"), F.sqrt(c("s_a") * c("s_b"))), F.lit(0.0)).alias("fowlkes_mallows"), mi.alias("mutual_info"), hom.alias("homogeneity"), com.alias("completeness"))
    return r.withColumn("v_measure", F.coalesce(F.try_divide(2 * c("homogeneity") * c("completeness"), c("homogeneity") + c("completeness")), F.lit(0.0)))


def _cluster(df, a, b, name):
    return float(cluster_scores_df(df, a, b).select(name).first()[0])


def adjusted_rand_score(df, a, b):
    return _cluster(df, a, b, "ari")


def fowlkes_mallows_score(df, a, b):
    return _cluster(df, a, b, "fowlkes_mallows")


def mutual_info_score(df, a, b):
    return _cluster(df, a, b, "mutual_info")


def homogeneity_completeness_v_measure(df, a, b):
    return tuple(float(x) for x in cluster_scores_df(df, a, b).select("homogeneity", "completeness", "v_measure").first())


def homogeneity_score(df, a, b):
    return _cluster(df, a, b, "homogeneity")


def completeness_score(df, a, b):
    return _cluster(df, a, b, "completeness")


def v_measure_score(df, a, b):
    return _cluster(df, a, b, "v_measure")


def centroids(df, features, label) -> DataFrame:
    """label, n, center: means of each component."""
    x = df.select(_c(label).alias("label"), F.posexplode(vector(features)).alias("i", "x"))
    return x.groupBy("label", "i").agg(F.avg("x").alias("m"), F.count("*").alias("n")).groupBy("label").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("center"))


def calinski_harabasz_df(df, features, label) -> DataFrame:
    cents = centroids(df, features, label)
    n_k = cents.agg(F.sum("n").alias("n"), F.count("*").alias("k"))
    whole = F.broadcast(centroids(df.withColumn("one_", F.lit(0)), features, "one_").select(F.col("center").alias("g")))
    b = cents.crossJoin(whole).agg(F.sum(F.col("n") * distance(F.col("center"), F.col("g"), "sqeuclidean")).alias("b"))
    w = df.select(_c(label).alias("label"), vector(features).alias("v")).join(cents, "label").agg(F.sum(distance(F.col("v"), F.col("center"), "sqeuclidean")).alias("w"))
    return b.crossJoin(w).crossJoin(n_k).select(F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def davies_bouldin_df(df, features, label) -> DataFrame:
    cents = centroids(df, features, label)
    s = df.select(_c(label).alias("label"), vector(features).alias("v")).join(cents, "label").groupBy("label").agg(F.avg(distance(F.col("v"), F.col("center"))).alias("s"), F.first("center").alias("c"))
    l, r = s.select("label", "s", "c"), s.select(F.col("label").alias("l2"), F.col("s").alias("s2"), F.col("c").alias("c2"))
    return l.join(r, F.col("label") != F.col("l2")).groupBy("label").agg(F.max(F.coalesce(F.try_divide(F.col("s") + F.col("s2"), distance(F.col("c"), F.col("c2"))), F.lit(float("inf")))).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def calinski_harabasz_score(df, features, label):
    return _first(calinski_harabasz_df(df, features, label))


def davies_bouldin_score(df, features, label):
    return _first(davies_bouldin_df(df, features, label))


def silhouette_samples(df, features, label, id_col) -> DataFrame:
    """id, silhouette. Its definition is all pairs: rows meet in blocks, and only sums by cluster leave a block."""
    from .neighbors import block_sums

    sums = block_sums(df.select(_c(id_col).alias("id"), _c(label).alias("label"), vector(features).alias("v")))
    own = F.col("label") == F.col("other")
    a = F.sum(F.when(own, F.col("total"))) / F.greatest(F.max(F.when(own, F.col("n"))) - 1, F.lit(1))
    b = F.min(F.when(~own, F.col("total") / F.col("n")))
    s = sums.groupBy("id", "label").agg(a.alias("a"), b.alias("b"))
    return s.select("id", F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)).alias("silhouette"))


def silhouette_score(df, features, label, id_col):
    return _first(silhouette_samples(df, features, label, id_col).agg(F.avg("silhouette")))


def dcg_df(df, query, relevance, score, k=None, id_col=None) -> DataFrame:
    """query, dcg, ideal."""
    tie = [_c(id_col)] if id_col else []

    def gains(order, name):
        r = F.row_number().over(Window.partitionBy(_c(query)).orderBy(F.desc(f"`{order}`"), *tie))
        top = df.select(_c(query).alias("query"), _c(relevance).cast("double").alias("g"), r.alias("r"))
        return (top.where(F.col("r") <= k) if k else top).groupBy("query").agg(F.sum(F.col("g") / F.log2(F.col("r") + 1)).alias(name))

    return gains(score, "dcg").join(gains(relevance, "ideal"), "query")


def dcg_score(df, query, relevance, score, k=None, id_col=None):
    return _first(dcg_df(df, query, relevance, score, k, id_col).agg(F.avg("dcg")))


def ndcg_score(df, query, relevance, score, k=None, id_col=None):
    """Mean gain over mean ideal gain."""
    return _first(dcg_df(df, query, relevance, score, k, id_col).agg(F.coalesce(F.try_divide(F.avg("dcg"), F.avg("ideal")), F.lit(0.0)))) or 0.0


def get_scorer(name):
    """scorer(fitted, df, label)."""
    if callable(name):
        return name

    def averaged(m):
        def f(est, df, y):
            out = est.predict(df)
            many = out.select(_c(y)).distinct().limit(3).count() > 2
            return globals()[m](out, y, "prediction", **({"average": "weighted"} if many else {}))

        return f

    table = {
        "accuracy": lambda e, d, y: accuracy_score(e.predict(d), y, "prediction"),
        "f1": averaged("f1_score"),
        "precision": averaged("precision_score"),
        "recall": averaged("recall_score"),
        "roc_auc": lambda e, d, y: roc_auc_score(e.predict_proba(d).withColumn("s_", F.element_at("probability", -1)), y, "s_"),
        "neg_mean_squared_error": lambda e, d, y: -mean_squared_error(e.predict(d), y, "prediction"),
        "neg_mean_absolute_error": lambda e, d, y: -mean_absolute_error(e.predict(d), y, "prediction"),
        "r2": lambda e, d, y: r2_score(e.predict(d), y, "prediction"),
    }
    if name not in table:
        raise ValueError(f"unknown scorer {name}; known: {', '.join(sorted(table))}")
    return table[name]
