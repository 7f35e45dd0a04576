"""Operators against closed forms, invariants and odd inputs, on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.text import clean_text, normalize_arabic
from millrace.operators import bayes, cluster, decompose, encode, linear, meta, metrics, neighbors, prepare, profile, select, series, split, tables, trees, words
from millrace.operators.base import NotFittedError, check_array, clone, moments
from millrace.plans import automl, compose
from millrace.sources import files, synthetic
from millrace.sources.database import Database, QueryBuilder, translate


@pytest.fixture(scope="module")
def cls(spark):
    rng = np.random.RandomState(0)
    x = rng.randn(200, 4)
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.2 * rng.randn(200) > 0).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, x3 double, y int").cache(), x, y


@pytest.fixture(scope="module")
def reg(spark):
    rng = np.random.RandomState(1)
    x = rng.randn(200, 4)
    y = x @ np.arange(4) + 100 + rng.randn(200)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double, x2 double, x3 double, y double").cache(), x, y


X = ["x0", "x1", "x2", "x3"]


def test_database(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 0), (5.0, 6.0, 1), (1.5, 2.5, 0)], "a double, b double, label int")
    df.createOrReplaceTempView("t")
    db = Database(spark)
    assert db.count("t") == 3 and "t" in db.list_tables() and db.profile("t").n_rows == 3
    assert db.query(QueryBuilder("t").select("a").where("a > 1").limit(10).build()).count() == 2
    assert [r["name"] for r in db.table_info("t").collect()] == ["a", "b", "label"]
    x, names = db.load_X_y("SELECT a, b, 'bad' AS c, label FROM t", "label")
    assert names == ["a", "b", "c"] and {r["c"] for r in x.collect()} == {0.0}
    train, test = db.train_test_from_sql("SELECT * FROM t", "label", ["a"], 0.34)
    assert test.count() == 1 and train.count() == 2
    assert db.query("SELECT * FROM t WHERE a > ?", [2.0]).count() == 1
    assert translate("select * from read_parquet('x/y.parquet')") == "select * from parquet.`x/y.parquet`"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b;label\n1;2;0\n3;;1\n5;6;1\n")
    df = files.load_any(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["a", "b", "label"] and df.count() == 3
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "d.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert files.load_any(spark, str(tmp_path / "l.jsonl")).count() == files.load_any(spark, str(tmp_path / "d.json")).count() == 2
    for kind in ("parquet", "json", "csv", "orc"):
        files.save_dataset(df, str(tmp_path / f"out.{kind}"))
        assert files.load_any(spark, str(tmp_path / f"out.{kind}")).count() == 3
    assert [len(c) for c in files.chunked_csv(spark, str(tmp_path / "a.csv"), 2)] == [2, 1]
    assert files.detect_format("x.tsv") == "csv" and files.detect_format("x.what") == "csv"


def test_profile_edges(spark):
    df = spark.createDataFrame([(1.0, None, "a", 5), (float("nan"), 2.0, None, 5), (3.0, float("nan"), "a", 5), (3.0, float("nan"), "a", 5)], "x double, y double, s string, c int")
    got = {r["column"]: r for r in profile.missing_report(df).collect()}
    assert (got["x"]["n_missing"], got["y"]["n_missing"], got["s"]["n_missing"], got["c"]["n_missing"]) == (1, 3, 1, 0)
    assert profile.missing_report(df).first()["column"] == "y"
    d = {r["column"]: r for r in profile.describe(df).collect()}
    assert d["x"]["count"] == 3 and abs(d["x"]["mean"] - 7 / 3) < 1e-12 and d["c"]["std"] == 0
    c = {(r["a"], r["b"]): r["corr"] for r in profile.correlation_matrix(df, ["x", "c"]).collect()}
    assert c[("x", "c")] is None and abs(c[("x", "x")] - 1) < 1e-12
    rep = profile.profile(df)
    assert rep["duplicates"] == 1 and "<table>" in profile.to_html(rep)
    empty = df.where("false")
    assert profile.missing_report(empty).count() == 4 and profile.duplicate_count(empty).first()["n_duplicates"] == 0


def test_cleaner_and_imputers(spark):
    df = spark.createDataFrame([(1.0, None, "a"), (1.0, None, "a"), (2.0, 4.0, None), (100.0, float("inf"), "b"), (3.0, 5.0, "a")], "x double, y double, s string")
    out = prepare.DataCleaner(outlier_clip="iqr").fit_transform(df)
    assert out.count() == 4 and out.where("x is null or y is null or s is null or y = double('infinity')").count() == 0
    assert {r[0] for r in prepare.SimpleImputer("most_frequent").fit(df, ["s"]).transform(df).select("s").collect()} == {"a", "b"}
    k = prepare.KNNImputer(1).fit(df.where("y < 10"), ["x", "y"]).transform(df.withColumn("id", F.monotonically_increasing_id()), "id")
    assert k.where("y is null").count() == 0


def test_scalers_and_back(reg):
    df, x, _ = reg
    for s in (prepare.StandardScaler(), prepare.MinMaxScaler((-1, 2)), prepare.RobustScaler(), prepare.MaxAbsScaler()):
        out = s.fit_transform(df, X)
        back = s.inverse_transform(out).orderBy("id").toPandas()[X].to_numpy()
        assert np.allclose(back, x)
    z = prepare.StandardScaler().fit_transform(df, X).toPandas()[X].to_numpy()
    assert np.allclose(z.mean(0), 0) and np.allclose(z.std(0), 1)
    one = df.withColumn("x0", F.lit(3.0))
    assert prepare.MinMaxScaler().fit_transform(one, ["x0"]).first()["x0"] == 0 and prepare.StandardScaler().fit_transform(one, ["x0"]).first()["x0"] == 0


def test_encoders(spark):
    df = spark.createDataFrame([(c, float(i), i % 2) for i, c in enumerate("aababbaa")], "c string, x double, y int")
    new = spark.createDataFrame([("a", 0.0, 0), ("z", 0.0, 0), (None, 0.0, 0)], "c string, x double, y int")
    assert [r["c"] for r in encode.OrdinalEncoder().fit(df, ["c"]).transform(new).orderBy("c").collect()] == [-1, -1, 0]
    with pytest.raises(Exception, match="unknown"):
        encode.OneHotEncoder().fit(df, ["c"]).transform(new).collect()
    assert encode.OneHotEncoder("ignore").fit(df, ["c"]).transform(new).where("c_a + c_b = 0").count() == 2
    le = encode.LabelEncoder().fit(df, "c")
    assert le.inverse_transform(le.transform(df)).where("c = 'a'").count() == 5
    lb = encode.LabelBinarizer().fit(df, "c")
    assert lb.inverse_transform(lb.transform(df)).where("label = c").count() == 8
    b = encode.NumericBinner(3).fit_transform(spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "x double"), ["x"])
    assert sorted(r[0] for r in b.collect()) == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 2]
    d = encode.DateFeaturizer("d").fit_transform(spark.createDataFrame([("2024-02-03",), ("nope",)], "d string")).collect()
    assert (d[0]["d_dow"], d[0]["d_weekend"], d[1]["d_year"]) == (5, 1, 0)
    assert len(encode.auto_featurize(df, "y")[1]) == 3


def test_splits(cls):
    df, _, y = cls
    train, test = split.train_test_split(df, order_by="id", test_size=0.25, shuffle=True)
    assert test.count() == 50 and train.join(test, "id").count() == 0 and train.count() == 150
    folds = split.KFold(7).folds(df, "id").groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [28] * 3 + [29] * 4
    s = split.StratifiedKFold(5).folds(df, "id", "y").groupBy("y", "fold").count().collect()
    assert max(r["count"] for r in s if r["y"] == 1) - min(r["count"] for r in s if r["y"] == 1) <= 1
    a, b = split.train_test_split(df, order_by="id", test_size=0.2, stratify="y")
    assert b.where("y = 1").count() == int(y.sum() * 0.2)
    assert len(list(split.ShuffleSplit(2, 0.1).split(df, ["id"]))) == 2
    with pytest.raises(ValueError):
        next(split.LeaveOneOut(10).split(df, ["id"]))


def test_metrics_hand(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (0, 1, 0.9), (1, 0, 0.4), (0, 0, 0.1)], "y int, p int, s double")
    assert metrics.accuracy_score(df, "y", "p") == 0.5 and metrics.f1_score(df, "y", "p") == 0.5
    assert abs(metrics.roc_auc_score(df, "y", "s") - 0.625) < 1e-12 and metrics.matthews_corrcoef(df, "y", "p") == 0
    assert abs(metrics.average_precision_score(df, "y", "s") - (0.5 * 0.5 + 0.5 * 2 / 3)) < 1e-12
    assert metrics.roc_auc_score(df.where("y = 1"), "y", "s") == 0.5
    assert abs(metrics.log_loss(df, "y", "s") - np.mean([-math.log(0.9), -math.log(0.1), -math.log(0.4), -math.log(0.9)])) < 1e-9
    assert metrics.adjusted_rand_score(df, "y", "y") == 1 and metrics.v_measure_score(df, "y", "y") == 1
    assert metrics.r2_score(df, "y", "y") == 1 and metrics.mean_squared_error(df, "y", "p") == 0.5
    assert metrics.roc_curve(df, "y", "s").count() == 4


def test_linear_closed_forms(reg):
    df, x, y = reg
    a = np.c_[x, np.ones(len(x))]
    want = np.linalg.lstsq(a, y, rcond=None)[0]
    m = linear.LinearRegression().fit(df, X, "y")
    assert np.allclose(m.coef_, want[:-1], atol=1e-9) and abs(m.intercept_ - want[-1]) < 1e-9 and m.score(df) > 0.8
    xc, yc = x - x.mean(0), y - y.mean()
    assert np.allclose(linear.Ridge(7.0).fit(df, X, "y").coef_, np.linalg.solve(xc.T @ xc + 7 * np.eye(4), xc.T @ yc), atol=1e-9)
    lasso = linear.Lasso(0.1, scaled=False, tol=1e-10).fit(df, X, "y").coef_
    slope = xc.T @ (yc - xc @ lasso) / len(x)
    assert all(abs(s - 0.1 * np.sign(w)) < 1e-6 if w else abs(s) <= 0.1 + 1e-6 for s, w in zip(slope, lasso))
    pos = linear.LinearRegression(positive=True).fit(df.withColumn("y", -F.col("y")), X, "y")
    assert (pos.coef_ >= 0).all()
    assert linear.BayesianRidge().fit(df, X, "y").score(df) > 0.8
    assert linear.SGDRegressor(max_iter=30).fit(df, X, "y").score(df) > 0.5
    n, s, g = moments(df, X)
    assert n == 200 and np.allclose(s, x.sum(0)) and np.allclose(g, x.T @ x)


def test_classifiers(cls):
    df, x, y = cls
    for m in (linear.LogisticRegression(), linear.RidgeClassifier(), linear.SGDClassifier("log"), linear.Perceptron(), linear.PassiveAggressiveClassifier(), bayes.GaussianNB(), trees.DecisionTreeClassifier(4), trees.RandomForestClassifier(5, 4), trees.GradientBoostingClassifier(3), meta.LinearSVC()):
        m.fit(df, X, "y")
        out = m.predict_proba(df).select(F.aggregate("probability", F.lit(0.0), lambda a, b: a + b).alias("s")).collect()
        assert all(abs(r["s"] - 1) < 1e-6 for r in out), m
        assert m.score(df) > 0.75, m
    nb = bayes.GaussianNB().fit(df, X, "y")
    assert np.allclose(nb.theta_[1], x[y == 1].mean(0)) and np.allclose(nb.var_[0], x[y == 0].var(0), rtol=1e-6)
    pos = df.select("y", *[(F.abs(c) + 0.1).alias(c) for c in X])
    for m in (bayes.MultinomialNB(), bayes.ComplementNB(), bayes.BernoulliNB(binarize=0.5)):
        assert 0 <= m.fit(pos, X, "y").score(pos) <= 1
    with pytest.raises(NotFittedError):
        trees.RandomForestClassifier().predict(df)
    assert clone(trees.RandomForestClassifier(7)).n_estimators == 7


def test_wrappers(cls):
    df, _, _ = cls
    three = df.withColumn("k", F.when(F.col("x0") > 0.5, "c").when(F.col("x1") > 0, "b").otherwise("a"))
    for m in (meta.OneVsRestClassifier(), meta.OneVsOneClassifier(), linear.LogisticRegression()):
        assert m.fit(three, X, "k").score(three) > 0.6, m
    members = [("a", linear.LogisticRegression()), ("b", bayes.GaussianNB())]
    for m in (trees.VotingClassifier(members), trees.VotingClassifier(members, "soft"), trees.StackingClassifier(members, cv=3, order_by=["id"]), trees.BaggingClassifier(n_estimators=3), trees.AdaBoostClassifier(4), meta.CalibratedClassifierCV(cv=3, order_by=["id"]), meta.CalibratedClassifierCV(method="isotonic", cv=3, order_by=["id"])):
        assert m.fit(df, X, "y").score(df) > 0.7, m
    chain = meta.ClassifierChain().fit(df.withColumn("z", 1 - F.col("y")), X, ["y", "z"]).predict(df)
    assert {"prediction_y", "prediction_z"} <= set(chain.columns)
    for s in ("prior", "most_frequent", "uniform"):
        assert meta.DummyClassifier(s).fit(df, X, "y").predict(df).where("prediction is null").count() == 0
    assert meta.OneClassSVM(0.1).fit(df, X).predict(df).where("prediction = 1").count() == 180


def test_regressors(reg):
    df, _, _ = reg
    pair = [("a", linear.Ridge()), ("b", trees.DecisionTreeRegressor(3))]
    for m in (trees.RandomForestRegressor(5, 6), trees.GradientBoostingRegressor(10), meta.LinearSVR(10.0), meta.MLPRegressor((16,), max_iter=30), trees.VotingRegressor(pair), trees.StackingRegressor(pair, cv=3, order_by=["id"]), trees.BaggingRegressor(n_estimators=3), trees.AdaBoostRegressor(3), meta.TransformedTargetRegressor(linear.Ridge(), F.log, F.exp), neighbors_reg()):
        m.fit(df, X, "y", "id") if isinstance(m, neighbors.KNeighborsRegressor) else m.fit(df, X, "y")
        assert m.score(df) > 0.4, m


def neighbors_reg():
    return neighbors.KNeighborsRegressor(3)


def test_clusters(spark):
    df = synthetic.make_blobs(spark, 90, 2, 3, 0.3, seed=3).cache()
    f = ["x0", "x1"]
    assert metrics.adjusted_rand_score(cluster.KMeans(3, n_init=2).fit(df, f).predict(df), "label", "cluster") > 0.9
    for m in (cluster.DBSCAN(1.5, 3), cluster.AgglomerativeClustering(3)):
        assert metrics.adjusted_rand_score(m.fit_predict(df, f, "id"), "label", "cluster") > 0.9, m
    g = cluster.GaussianMixture(3).fit(df, f)
    assert metrics.adjusted_rand_score(g.predict(df), "label", "cluster") > 0.9 and g.bic(df) > g.aic(df) and g.sample(5)[0].shape == (5, 2)
    assert len(cluster.MeanShift(1.0).fit(df, f).cluster_centers_) == 3
    assert cluster.MiniBatchKMeans(3, max_iter=10).fit(df, f).predict(df).where("cluster between 0 and 2").count() == 90
    assert metrics.silhouette_score(df, f, "label", "id") > 0.7 and metrics.davies_bouldin_score(df, f, "label") < 0.5 and metrics.calinski_harabasz_score(df, f, "label") > 100


@pytest.mark.parametrize("linkage", ["ward", "single", "complete", "average"])
def test_agglomerative_merges_the_nearest(spark, linkage):
    x = np.random.default_rng(5).standard_normal((40, 2))
    groups = [[i] for i in range(40)]

    def apart(a, b):
        d = np.linalg.norm(x[a][:, None] - x[b][None], axis=2)
        return {"ward": len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum(), "single": d.min(), "complete": d.max(), "average": d.mean()}[linkage]

    while len(groups) > 6:
        _, i, j = min((apart(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        groups[j] += groups.pop(i)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())], "id long, x0 double, x1 double")
    found = cluster.AgglomerativeClustering(6, linkage).fit_predict(df, ["x0", "x1"], "id").groupBy("cluster").agg(F.collect_set("id").alias("ids")).collect()
    assert {frozenset(r["ids"]) for r in found} == {frozenset(g) for g in groups}


def test_agglomerative_takes_all_rows(spark):
    df = spark.range(5500).select("id", (F.col("id") % 2 * 1000 + F.col("id") / 100).alias("x0"))
    assert cluster.AgglomerativeClustering(2).fit_predict(df, ["x0"], "id").where("cluster = id % 2").count() == 5500
    with pytest.raises(ValueError):
        cluster.AgglomerativeClustering(2, max_rows=100).fit_predict(df, ["x0"], "id")


@pytest.mark.parametrize("metric, eps", [("euclidean", 0.3), ("sqeuclidean", 0.09), ("manhattan", 0.35), ("cosine", 0.001)])
def test_dbscan_by_tiles(spark, metric, eps, monkeypatch):
    monkeypatch.setattr(neighbors, "SIDE", 16)  # many tiles, cells of many parts
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal((150, 2)) * 2, np.repeat([[0.5, 0.5]], 40, 0)])
    d = neighbors._distances(x, x, metric)
    near = (d <= eps) & ~np.eye(len(x), dtype=bool)
    core = near.sum(1) + 1 >= 4
    want, clusters = np.full(len(x), -1), 0
    for s in range(len(x)):
        if core[s] and want[s] < 0:
            todo = [s]
            while todo:
                k = todo.pop()
                if want[k] < 0:
                    want[k] = clusters
                    todo += np.flatnonzero(near[k] & core).tolist()
            clusters += 1
    for k in np.flatnonzero(~core):
        reach = want[near[k] & core]
        want[k] = reach.min() if len(reach) else -1
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(x.tolist())] + [(900, float("nan"), 0.0), (901, None, 0.0)], "id long, x0 double, x1 double")
    found = cluster.DBSCAN(eps, 4, metric).fit_predict(df, ["x0", "x1"], "id").select("id", "cluster").toPandas().set_index("id")["cluster"]
    assert found.loc[range(len(x))].tolist() == want.tolist() and found.loc[[900, 901]].tolist() == [-1, -1] and clusters > 1


def test_cut_forgets_estimates(spark):
    df = spark.range(5).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for _ in range(14):  # digits of an estimate that is kept double each round
        df = tables.cut(df.join(df.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
    assert df.count() == 5 and len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 40


def test_mean_shift_climbs_from_every_row(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 0.3, (700, 2)), [[20.0, 20.0], [-20.0, 20.0], [20.0, -20.0], [-20.0, -20.0]]])
    df = spark.createDataFrame(x.tolist(), "x0 double, x1 double").repartition(3)
    found = cluster.MeanShift(1.0).fit(df, ["x0", "x1"]).cluster_centers_
    assert len(found) == 5 and all(np.linalg.norm(found - m, axis=1).min() < 1e-6 for m in x[700:])
    assert len(cluster.MeanShift(1.0, max_seeds=1).fit(df, ["x0", "x1"]).cluster_centers_) == 1


@pytest.mark.parametrize("d", [1, 2])
def test_mean_shift_by_cells_weighs_all_rows(spark, d):
    rng = np.random.default_rng(4)
    spread = 0.4 if d == 1 else 0.05
    x = np.concatenate([rng.normal(0, spread, (4000, d)), rng.normal(6, spread, (2000, d)), np.full((500, d), 6.0)])
    df = spark.createDataFrame([(*r, 7.0) for r in x.tolist()], ", ".join(f"x{i} double" for i in range(d + 1))).repartition(3)
    m = cluster.MeanShift(1.0, max_iter=6)
    data = df.select(F.array("*").alias("v")).groupBy("v").agg(F.count("*").cast("double").alias("n")).cache()
    starts = data.select(F.xxhash64("v").alias("h"), "v").orderBy("h").limit(300)
    found = m._by_cells(data, starts)
    at = np.asarray([r["v"] for r in starts.orderBy("h", "v").collect()])
    assert found is not None and np.abs(m._by_rows(data, at) - found).max() < 1e-4
    for _ in range(6):
        w = np.exp(-((at[:, None, :d] - x[None]) ** 2).sum(2) / 2)
        was, at = at, np.column_stack([w @ x / w.sum(1, keepdims=True), at[:, d:]])
    assert np.abs(at - found).max() < 2e-4
    got = cluster.MeanShift(1.0).fit(df, [f"x{i}" for i in range(d + 1)]).cluster_centers_
    assert len(got) == 2 and np.abs(np.sort(got[:, 0]) - [0, 6]).max() < 0.1 and (got[:, d] == 7).all()


def test_kernel_pca_takes_all_rows_or_refuses(spark):
    x = np.random.default_rng(2).standard_normal((2100, 3))
    df = spark.createDataFrame(x.tolist(), "x0 double, x1 double, x2 double")
    p = decompose.KernelPCA(2, kernel="linear").fit(df, ["x0", "x1", "x2"])
    assert np.allclose(p.values_, np.linalg.svd(x - x.mean(0))[1][:2] ** 2)
    with pytest.raises(ValueError):
        decompose.KernelPCA(2).fit(df.union(df), ["x0", "x1", "x2"])


def test_projections(reg, spark):
    df, x, _ = reg
    p = decompose.PCA(2).fit(df, X)
    u, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    z = p.transform(df).orderBy("id").toPandas()["components"]
    assert np.allclose(np.abs(np.stack(z)), np.abs((x - x.mean(0)) @ vt[:2].T), atol=1e-8) and np.allclose(p.explained_variance_, s[:2] ** 2 / 199)
    full = decompose.PCA(whiten=True).fit(df, X)
    back = full.inverse_transform(full.transform(df)).orderBy("id").toPandas()["restored"]
    assert np.allclose(np.stack(back), x, atol=1e-8)
    t = decompose.TruncatedSVD(2).fit(df, X)
    assert np.allclose(t.singular_values_, np.linalg.svd(x)[1][:2])
    small = df.limit(60)
    for m in (decompose.FactorAnalysis(2), decompose.FastICA(2, 20), decompose.RBFSampler(n_components=8), decompose.Nystroem(n_components=8), decompose.KernelPCA(2, max_rows=50)):
        assert m.fit(small, X).transform(small).count() == 60, m
    assert decompose.NMF(2, 5).fit(small.select(*[F.abs(c).alias(c) for c in X]), X).components_.min() >= 0
    for m in (decompose.MDS(), decompose.Isomap(), decompose.SpectralEmbedding(), decompose.TSNE(max_iter=20)):
        assert m.fit_transform(small, X, "id").where("size(embedding) = 2").count() == 60, m
    with pytest.raises(ValueError):
        decompose.MDS(max_rows=10).fit_transform(df, X, "id")


def test_selection(cls):
    df, x, y = cls
    f, p = select.f_classif(df, X, "y")
    groups = [x[y == 0], x[y == 1]]
    b = sum(len(g) * (g.mean(0) - x.mean(0)) ** 2 for g in groups)
    w = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups)
    assert np.allclose(f, b / (w / 198)) and p[0] < 1e-6
    assert select.SelectKBest(k=2).fit(df, X, "y").selected_[0] == "x0"
    assert select.SelectPercentile(percentile=25).fit(df, X, "y").selected_ == ["x0"]
    assert set(select.RFE(linear.Ridge(), 2).fit(df, X, "y").selected_) == {"x0", "x1"}
    assert "x0" in select.SelectFromModel(trees.RandomForestClassifier(5, 4)).fit(df, X, "y").selected_
    assert select.chi2(df.select("y", *[F.abs(c).alias(c) for c in X]), X, "y")[1].shape == (4,)


def test_series(spark):
    y = [i + math.sin(i) for i in range(30)]
    df = spark.createDataFrame(list(enumerate(y)), "t int, y double")
    last = lambda m: [r["forecast"] for r in m.fit(df, "t", "y").predict(7).orderBy("h").collect()]
    assert last(series.NaiveForecaster()) == [y[-1]] * 7 and last(series.SeasonalNaiveForecaster(3))[:4] == [*y[-3:], y[-3]]
    level = y[0]
    for v in y[1:]:
        level = 0.3 * v + 0.7 * level
    assert abs(last(series.ExponentialSmoothingForecaster(0.3))[0] - level) < 1e-9
    assert abs(last(series.ARForecaster(3))[0] - (30 + math.sin(30))) < 1.5
    train, test = series.temporal_split(df, "t", 0.2)
    assert (train.count(), test.count()) == (24, 6)
    d = {r["t"]: r for r in series.seasonal_decompose(df, "t", "y", 7).collect()}
    want = np.convolve(y, np.ones(7) / 7, "same")
    assert all(abs(d[i]["trend"] - want[i]) < 1e-9 and abs(d[i]["trend"] + d[i]["seasonal"] + d[i]["resid"] - y[i]) < 1e-9 for i in range(30))
    assert len(series.rolling_origin_cv(df, "t", "y", series.NaiveForecaster(), 3, 2)) == 2


def test_text(spark):
    df = spark.createDataFrame([(0, "Hello @you, see https://x.y/z?q=1 #tag 123 naïve café_x!", 1), (1, "أإآ السلام عليكم", 0), (2, None, 1), (3, "مُحَمَّد hello", 0)], "id int, text string, y int")
    got = {r["id"]: r["c"] for r in df.select("id", clean_text(F.col("text")).alias("c")).collect()}
    assert got[0] == "hello see naïve café_x" and got[1] == "ااا السلام عليكم" and got[2] == ""
    assert df.select(normalize_arabic(F.col("text"))).count() == 4
    v = words.TfidfVectorizer(20).fit(df, "id", "text")
    norms = v.transform(df).groupBy("id").agg(F.sum(F.col("value") ** 2).alias("n")).collect()
    assert all(abs(r["n"] - 1) < 1e-9 for r in norms) and v.get_feature_names_out()[0] == "hello"
    c = words.TextClassifier(50, (1, 1)).fit(df, "id", "text", "y").predict(df)
    assert {r["prediction"] for r in c.collect()} <= {0, 1}


def test_pipeline_search_automl(cls, tmp_path):
    df, _, _ = cls
    pipe = compose.make_pipeline(prepare.StandardScaler(), linear.LogisticRegression())
    assert compose.cross_val_score(pipe, df, X, "y", order_by=["id"], cv=3).mean() > 0.8
    g = compose.GridSearchCV(pipe, {"logisticregression__C": [0.01, 10.0]}, cv=2).fit(df, X, "y", order_by=["id"])
    assert "logisticregression__C" in g.best_params_ and g.score(df) > 0.8
    assert compose.cross_val_predict(linear.LogisticRegression(), df, X, "y", order_by=["id"], cv=2).count() == 200
    u = compose.make_union(decompose.PCA(2), decompose.TruncatedSVD(1)).fit_transform(df, X)
    assert u.where("size(components) = 3").count() == 200
    best, board = automl.find_best(df, X, "y", order_by=["id"], cv=2, candidates=[("a", linear.LogisticRegression()), ("b", bayes.GaussianNB())])
    assert board[0]["mean"] >= board[1]["mean"]
    rep = automl.model_report(best, df, X, "y", order_by=["id"])
    assert rep["top_features"][0][0] == "x0"
    assert automl.partial_dependence(best, df, "x0", n_points=5).count() == 5
    reg_ = automl.ModelRegistry(str(tmp_path))
    assert [reg_.register("m", trees.RandomForestClassifier(3, 3).fit(df, X, "y")), reg_.register("m", best)] == ["v1", "v2"]
    assert reg_.list() == ["m/v1", "m/v2"] and reg_.latest("m").predict(df).count() == 200 and reg_.load("m", "v1").score(df) > 0.7
    assert automl.detect_task(df, "y") == "classification" and automl.detect_task(df, "x0") == "regression"


def test_checks_and_synthetic(spark):
    with pytest.raises(ValueError):
        check_array(spark.createDataFrame([(1.0,), (None,)], "x double"), ["x"])
    for df in (synthetic.make_classification(spark, 50, 5), synthetic.make_moons(spark, 50), synthetic.make_circles(spark, 50), synthetic.make_regression(spark, 50, 5, 2)):
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.repartition(3).collect()))
