"""Named queries over models, validation, series, metrics and files, with SQL of their closed forms.

Fits whose result has a closed form in few moments (lines, stumps, class sums, spectra of two
columns, groups far apart) are run as they are; SQL works the same numbers out its own way.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.columns import text_of
from .operators import bayes, cluster, decompose, linear, meta, metrics, prepare, select, series, split, trees
from .operators.tables import scratch_path
from .plans import automl, compose
from .queries import query, rounded, sql_query, t, views
from .sources import files, synthetic
from .sources.database import Database

X, Y = "l_quantity", "worth"
LINES = "(SELECT *, l_extendedprice + 1000 * l_quantity AS worth, ceil(l_quantity / 5) AS fives FROM lineitem) lineitem"
LINE = f"SELECT count(*) AS n, avg({X}) AS mx, avg({Y}) AS my, regr_sxx({Y}, {X}) AS sxx, regr_sxy({Y}, {X}) AS sxy FROM {LINES}"
DEAR = f"({Y} > 78000)"


def lines(spark, sf) -> DataFrame:
    return t(spark, sf, "lineitem").withColumn("worth", F.col("l_extendedprice") + 1000 * F.col("l_quantity")).withColumn("fives", F.ceil(F.col("l_quantity") / 5).cast("double"))


def dear(spark, sf) -> DataFrame:
    return lines(spark, sf).withColumn("dear", (F.col(Y) > 78000).cast("int"))


def one(spark, schema: str, *values) -> DataFrame:
    return spark.createDataFrame([values], schema)


def line(spark, est, digits: int = 4) -> DataFrame:
    return one(spark, "slope double, intercept double", round(float(est.coef_[0]), digits), round(float(est.intercept_), digits))


# --- lines ----------------------------------------------------------------------------


@query(f"WITH m AS ({LINE}), w AS (SELECT *, greatest(sxy / sqrt(sxx) - 10 * n, 0) / sqrt(sxx) AS b FROM m) SELECT round(b, 4) AS slope, round(my - b * mx, 4) AS intercept FROM w")
def lasso_1d(spark, sf):
    return line(spark, linear.Lasso(10.0).fit(lines(spark, sf), [X], Y))


@query(f"WITH m AS ({LINE}), w AS (SELECT *, sign(sxy) * greatest(abs(sxy) - 50.0 * n, 0) / (sxx + 50.0 * n) AS b FROM m) SELECT round(b, 4) AS slope, round(my - b * mx, 4) AS intercept FROM w")
def elastic_net_1d(spark, sf):
    return line(spark, linear.ElasticNet(100.0, 0.5).fit(lines(spark, sf), [X], Y))


@query(f"SELECT round(regr_sxy({Y}, {X}) / count(*), 2) AS sxy FROM {LINES}")
def bayesian_ridge_fixed_point(spark, sf):
    """At the end of the iteration slope x (lambda / alpha + Sxx) is Sxy."""
    df = lines(spark, sf)
    m = linear.BayesianRidge().fit(df, [X], Y)
    sxx, n = df.agg(F.regr_sxx(F.col(Y), F.col(X)), F.count("*")).first()
    return one(spark, "sxy double", round(float(m.coef_[0]) * (m.lambda_ / m.alpha_ + sxx) / n, 2))


@query(f"SELECT round(avg({DEAR}::INT), 3) AS share, round(avg({X} * {DEAR}::INT), 2) AS moment FROM {LINES}")
def logistic_gradient(spark, sf):
    """At the optimum probabilities have the labels' mean and their moment with the feature."""
    m = linear.LogisticRegression(penalty=None, max_iter=200).fit(dear(spark, sf), [X], "dear")
    p = F.element_at("probability", 2)
    return rounded(rounded(m.predict_proba(dear(spark, sf)).agg(F.avg(p).alias("share"), F.avg(p * F.col(X)).alias("moment")), "share", digits=3), "moment", digits=2)


@query(f"WITH d AS (SELECT {X} AS x, {DEAR}::INT AS c, 2 * {DEAR}::INT - 1 AS y FROM {LINES}), m AS (SELECT avg(x) AS mx, avg(y) AS my, regr_sxy(y, x) / (regr_sxx(y, x) + 1) AS b FROM d) SELECT c AS dear, (my + b * (x - mx) > 0)::INT AS prediction, count(*) AS n FROM d, m GROUP BY 1, 2")
def ridge_classifier_1d(spark, sf):
    m = linear.RidgeClassifier(1.0).fit(dear(spark, sf), [X], "dear")
    return m.predict(dear(spark, sf)).groupBy("dear", "prediction").agg(F.count("*").alias("n"))


@query(f"SELECT l_linenumber AS k, round(avg(regr_slope) , 4) AS slope FROM (SELECT 1 AS l_linenumber, regr_slope({Y}, {X}) AS regr_slope FROM {LINES} UNION ALL SELECT 2, regr_slope(l_tax * 1000, {X}) FROM {LINES}) GROUP BY 1")
def multi_output_lines(spark, sf):
    df = lines(spark, sf).withColumn("tax", F.col("l_tax") * 1000)
    m = meta.MultiOutputRegressor(linear.LinearRegression()).fit(df, [X], [Y, "tax"])
    return spark.createDataFrame([(i + 1, round(float(e.coef_[0]), 4)) for i, e in enumerate(m.members_)], "k int, slope double")


@query("WITH m AS (SELECT regr_slope(ln(p_retailprice), p_size) AS b, regr_intercept(ln(p_retailprice), p_size) AS a FROM part) SELECT p_partkey, round(exp(a + b * p_size), 4) AS prediction FROM part, m")
def transformed_target(spark, sf):
    p = t(spark, sf, "part")
    m = meta.TransformedTargetRegressor(linear.LinearRegression(), F.log, F.exp).fit(p, ["p_size"], "p_retailprice")
    return rounded(m.predict(p).select("p_partkey", "prediction"), "prediction", digits=4)


PART_LINE = "SELECT regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a, corr(p_retailprice, p_size) AS r FROM part"


@query(f"WITH m AS ({PART_LINE}) SELECT p_partkey, round(a + b * p_size, 4) AS prediction FROM part, m")
def pipeline_scaled_line(spark, sf):
    p = t(spark, sf, "part")
    m = compose.make_pipeline(prepare.StandardScaler(), linear.LinearRegression()).fit(p, ["p_size"], "p_retailprice")
    return rounded(m.predict(p).select("p_partkey", "prediction"), "prediction", digits=4)


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS p_size, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS p_retailprice FROM part")
def column_transformer(spark, sf):
    p = t(spark, sf, "part").withColumn("p_size", F.col("p_size").cast("double"))
    made = compose.ColumnTransformer([("a", prepare.StandardScaler(), ["p_size"]), ("b", prepare.MinMaxScaler(), ["p_retailprice"])], keep=["p_partkey"]).fit(p).transform(p)
    return rounded(made, "p_size", "p_retailprice").select("p_partkey", "p_size", "p_retailprice")


@query("SELECT p_partkey, round(p_size - avg(p_size) OVER (), 6) AS a, round(2 * (p_size - avg(p_size) OVER ()), 6) AS b FROM part")
def feature_union(spark, sf):
    p = t(spark, sf, "part")
    made = compose.FeatureUnion([("one", decompose.PCA(1)), ("two", decompose.PCA(1))], {"two": 2.0}).fit(p, ["p_size"]).transform(p)
    return rounded(made.select("p_partkey", F.get("components", F.lit(0)).alias("a"), F.get("components", F.lit(1)).alias("b")), "a", "b")


@query(f"WITH m AS ({PART_LINE}) SELECT v::DOUBLE AS value, round(a + b * v, 4) AS mean FROM m, (VALUES (10), (20), (30)) x(v)")
def partial_dependence_line(spark, sf):
    p = t(spark, sf, "part")
    m = linear.LinearRegression().fit(p, ["p_size"], "p_retailprice")
    return rounded(automl.partial_dependence(m, p, "p_size", grid=[10.0, 20.0, 30.0]), "mean", digits=4)


@query(f"WITH m AS ({PART_LINE}) SELECT 'regression' AS task, round(sqrt(avg((p_retailprice - a - b * p_size) ** 2)), 4) AS rmse, round(max(r * r), 6) AS r2 FROM part, m")
def model_report_line(spark, sf):
    p = t(spark, sf, "part")
    rep = automl.model_report(linear.LinearRegression().fit(p, ["p_size"], "p_retailprice"), p, ["p_size"], "p_retailprice", order_by=["p_partkey"])
    return one(spark, "task string, rmse double, r2 double", rep["task"], round(rep["rmse"], 4), round(rep["r2"], 6))


@query(f"WITH m AS ({PART_LINE}) SELECT 'r2' AS scorer, round(r * r, 6) AS score FROM m UNION ALL SELECT 'neg_mean_squared_error', round(-avg((p_retailprice - a - b * p_size) ** 2), 4) FROM part, m UNION ALL SELECT 'neg_mean_absolute_error', round(-avg(abs(p_retailprice - a - b * p_size)), 4) FROM part, m")
def scorers_of_a_line(spark, sf):
    p = t(spark, sf, "part")
    m = linear.LinearRegression().fit(p, ["p_size"], "p_retailprice")
    return spark.createDataFrame([(n, round(metrics.get_scorer(n)(m, p, "p_retailprice"), d)) for n, d in (("r2", 6), ("neg_mean_squared_error", 4), ("neg_mean_absolute_error", 4))], "scorer string, score double")


@query(f"WITH m AS ({LINE}) SELECT round(sxy / (sxx + 1), 4) AS slope, round(my - sxy / (sxx + 1) * mx, 4) AS intercept FROM m")
def train_sql_ridge(spark, sf):
    views(spark, sf, "lineitem")
    return line(spark, Database(spark).train_sql(f"SELECT {X}, l_extendedprice + 1000 * l_quantity AS worth FROM lineitem", Y, linear.Ridge(1.0)))


@query(f"WITH m AS ({PART_LINE}) SELECT p_partkey, round(a + b * p_size, 4) AS first, round(a + b * p_size, 4) AS latest, 2 AS versions FROM part, m")
def saved_and_registered_model(spark, sf):
    """Predictions of a model that was saved and loaded, and of the latest of two registered versions."""
    p = t(spark, sf, "part")
    m = linear.LinearRegression().fit(p, ["p_size"], "p_retailprice")
    with tempfile.TemporaryDirectory() as at:  # the registry is a folder of the driver
        automl.save_model(m, f"{at}/m")
        reg = automl.ModelRegistry(f"{at}/r")
        reg.register("line", linear.Ridge(1e6).fit(p, ["p_size"], "p_retailprice"))
        reg.register("line", m)
        a, b, n = automl.load_model(f"{at}/m"), reg.latest("line"), len(reg.list("line"))
    return rounded(b.predict(a.predict(p, "first"), "latest").select("p_partkey", "first", "latest", F.lit(n).alias("versions")), "first", "latest", digits=4)


BOTH = f"SELECT covar_pop({X}, {X}) AS aa, covar_pop(l_tax, l_tax) AS bb, covar_pop({X}, l_tax) AS ab, covar_pop({X}, {Y}) AS ay, covar_pop(l_tax, {Y}) AS bz FROM {LINES}"
LARGER = f"WITH c AS ({BOTH}), w AS (SELECT abs(ay * bb - bz * ab) AS a, abs(bz * aa - ay * ab) AS b FROM c) SELECT CASE WHEN a >= b THEN '{X}' ELSE 'l_tax' END AS selected FROM w"


@query(LARGER)
def select_from_model(spark, sf):
    return spark.createDataFrame([(c,) for c in select.SelectFromModel(linear.LinearRegression()).fit(lines(spark, sf), [X, "l_tax"], Y).selected_], "selected string")


@query(LARGER)
def rfe_of_two(spark, sf):
    return spark.createDataFrame([(c,) for c in select.RFE(linear.LinearRegression(), 1).fit(lines(spark, sf), [X, "l_tax"], Y).selected_], "selected string")


@query(f"SELECT CASE WHEN abs(corr({X}, {Y})) >= abs(corr(l_tax, {Y})) THEN '{X}' ELSE 'l_tax' END AS selected FROM {LINES}")
def select_k_best(spark, sf):
    return spark.createDataFrame([(c,) for c in select.SelectKBest(select.f_regression, 1).fit(lines(spark, sf), [X, "l_tax"], Y).selected_], "selected string")


# --- stumps -----------------------------------------------------------------------------


def stump(x: str, y: str, out: str) -> str:
    """The best split of x by squared error, and a value of either side, for each x."""
    return f"WITH g AS (SELECT {x} AS x, count(*) AS n, sum({y}) AS s FROM {LINES} GROUP BY 1), c AS (SELECT x, sum(n) OVER (ORDER BY x) AS ln, sum(s) OVER (ORDER BY x) AS ls, sum(n) OVER () AS n, sum(s) OVER () AS s, lead(x) OVER (ORDER BY x) AS nx FROM g), b AS (SELECT x AS edge, ls / ln AS lo, (s - ls) / (n - ln) AS hi FROM c WHERE nx IS NOT NULL ORDER BY ls * ls / ln + (s - ls) * (s - ls) / (n - ln) DESC LIMIT 1), p AS (SELECT x, CASE WHEN x <= edge THEN lo ELSE hi END AS v FROM g, b) SELECT x AS {x}, {out} FROM p"


def each(df: DataFrame, x: str) -> DataFrame:
    return df.select(x).distinct()


def _stump_regressor(name: str, est, x: str) -> None:
    def run(spark, sf):
        m = est().fit(lines(spark, sf), [x], Y)
        return rounded(m.predict(each(lines(spark, sf), x)).select(x, "prediction"), "prediction", digits=3)

    run.__name__ = name
    query(stump(x, Y, "round(v, 3) AS prediction"))(run)


def _stump_classifier(name: str, est, x: str, chance: str = "v") -> None:
    def run(spark, sf):
        m = est().fit(dear(spark, sf), [x], "dear")
        return rounded(m.predict_proba(each(lines(spark, sf), x)).select(x, F.element_at("probability", 2).alias("chance")), "chance", digits=5)

    run.__name__ = name
    query(stump(x, f"{DEAR}::INT", f"round({chance}, 5) AS chance"))(run)


_stump_regressor("tree_regressor_stump", lambda: trees.DecisionTreeRegressor(1), X)
_stump_regressor("forest_regressor_stump", lambda: trees.RandomForestRegressor(3, 1, bootstrap=False), X)
_stump_regressor("extra_tree_regressor_stump", lambda: trees.ExtraTreeRegressor(1), "fives")
_stump_regressor("extra_trees_regressor_stump", lambda: trees.ExtraTreesRegressor(3, 1, bootstrap=False), "fives")
_stump_regressor("boosting_regressor_stump", lambda: trees.GradientBoostingRegressor(1, 1.0, 1), "fives")
_stump_regressor("hist_boosting_regressor_stump", lambda: trees.HistGradientBoostingRegressor(1, 1.0, 1), "fives")
_stump_classifier("tree_classifier_stump", lambda: trees.DecisionTreeClassifier(1), X)
_stump_classifier("forest_classifier_stump", lambda: trees.RandomForestClassifier(3, 1, bootstrap=False), X)
_stump_classifier("extra_tree_classifier_stump", lambda: trees.ExtraTreeClassifier(1), "fives")
_stump_classifier("extra_trees_classifier_stump", lambda: trees.ExtraTreesClassifier(3, 1), "fives")
_stump_classifier("boosting_classifier_stump", lambda: trees.GradientBoostingClassifier(1, 1.0, 1), "fives", "1 / (1 + exp(-2 * (2 * v - 1)))")


@query(stump(X, f"{DEAR}::INT", "(v > 0.5)::INT AS prediction"))
def adaboost_classifier_stump(spark, sf):
    m = trees.AdaBoostClassifier(1, max_depth=1).fit(dear(spark, sf), [X], "dear")
    return m.predict(each(lines(spark, sf), X)).select(X, F.col("prediction").cast("int").alias("prediction"))


_stump_regressor("adaboost_regressor_stump", lambda: trees.AdaBoostRegressor(1, max_depth=1), X)


# --- classes ------------------------------------------------------------------------------

COUNTS = ["l_quantity", "l_linenumber", "pct"]
COUNTED = "SELECT l_returnflag AS c, l_quantity::DOUBLE AS f0, l_linenumber::DOUBLE AS f1, round(l_discount * 100) AS f2 FROM lineitem"


def counted(spark, sf):
    return lines(spark, sf).withColumn("pct", F.round(F.col("l_discount") * 100))


def log_probabilities(spark, m, table) -> DataFrame:
    return spark.createDataFrame([(str(c), i, round(float(v), 6)) for c, r in zip(m.classes_, table) for i, v in enumerate(r)], "label string, feature int, log_prob double")


def _unpivoted(sql: str) -> str:
    return " UNION ALL ".join(f"SELECT c AS label, {i} AS feature, round({sql.replace('#', str(i))}, 6) AS log_prob FROM s" for i in range(3))


@query(f"WITH x AS ({COUNTED}), s AS (SELECT c, sum(f0) + 1 AS s0, sum(f1) + 1 AS s1, sum(f2) + 1 AS s2 FROM x GROUP BY c) {_unpivoted('ln(s#) - ln(s0 + s1 + s2)')}")
def multinomial_nb(spark, sf):
    m = bayes.MultinomialNB().fit(counted(spark, sf), COUNTS, "l_returnflag")
    return log_probabilities(spark, m, m.feature_log_prob_)


@query(f"WITH x AS ({COUNTED}), a AS (SELECT sum(f0) AS t0, sum(f1) AS t1, sum(f2) AS t2 FROM x), s AS (SELECT c, any_value(t0) - sum(f0) + 1 AS s0, any_value(t1) - sum(f1) + 1 AS s1, any_value(t2) - sum(f2) + 1 AS s2 FROM x, a GROUP BY c) {_unpivoted('ln(s0 + s1 + s2) - ln(s#)')}")
def complement_nb(spark, sf):
    m = bayes.ComplementNB().fit(counted(spark, sf), COUNTS, "l_returnflag")
    return log_probabilities(spark, m, m.feature_log_prob_)


@query(f"WITH x AS ({COUNTED}), s AS (SELECT c, count(*) AS n, sum((f0 > 4)::INT) AS s0, sum((f1 > 4)::INT) AS s1, sum((f2 > 4)::INT) AS s2 FROM x GROUP BY c) {_unpivoted('ln((s# + 1) / (n + 2))')}")
def bernoulli_nb(spark, sf):
    m = bayes.BernoulliNB(binarize=4.0).fit(counted(spark, sf), COUNTS, "l_returnflag")
    return log_probabilities(spark, m, m.feature_log_prob_)


@query("SELECT l_returnflag AS label, round(count(*) / sum(count(*)) OVER (), 6) AS prior FROM lineitem GROUP BY 1")
def dummy_prior(spark, sf):
    m = meta.DummyClassifier("prior").fit(lines(spark, sf), [X], "l_returnflag")
    return spark.createDataFrame([(str(c), round(float(p), 6)) for c, p in zip(m.classes_, m.class_prior_)], "label string, prior double")


@query(f"SELECT round(avg({Y}), 4) AS mean, round(quantile_cont({Y}, 0.5), 4) AS median FROM {LINES}")
def dummy_regressors(spark, sf):
    got = [meta.DummyRegressor(s).fit(lines(spark, sf), [X], Y).predict(lines(spark, sf).limit(1)).first()["prediction"] for s in ("mean", "median")]
    return one(spark, "mean double, median double", *[round(x, 4) for x in got])


SCORED = "SELECT quality AS y, toxic AS p, (doc_id % 97 + 1) / 99.0 AS q FROM labels"


def guessed(spark, sf):
    return t(spark, sf, "labels").withColumn("q", (F.col("doc_id") % 97 + 1) / 99.0).withColumn("margin", 4 * F.col("q") - 2)


@query(f"WITH x AS ({SCORED}), c AS (SELECT sum((y = 1 AND p = 1)::INT) AS tp, sum((y = 0 AND p = 1)::INT) AS fp, sum((y = 1 AND p = 0)::INT) AS fn, sum((y = 0 AND p = 0)::INT) AS tn FROM x) SELECT round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round((fp + fn) / (tp + tn + fp + fn), 6) AS zero_one, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS prec, round(tp / (tp + fn), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced FROM c")
def binary_scores(spark, sf):
    d = guessed(spark, sf)
    got = [m(d, "quality", "toxic") for m in (metrics.accuracy_score, metrics.zero_one_loss, metrics.precision_score, metrics.recall_score, metrics.f1_score, metrics.balanced_accuracy_score)]
    return one(spark, "accuracy double, zero_one double, prec double, recall double, f1 double, balanced double", *[round(float(x), 6) for x in got])


@query(f"WITH x AS ({SCORED}) SELECT round(-avg(CASE WHEN y = 1 THEN ln(q) ELSE ln(1 - q) END), 6) AS log_loss, round(avg((q - y) ** 2), 6) AS brier, round(avg(greatest(0, 1 - (2 * y - 1) * (4 * q - 2))), 6) AS hinge FROM x")
def probability_losses(spark, sf):
    d = guessed(spark, sf)
    got = metrics.log_loss(d, "quality", "q"), metrics.brier_score_loss(d, "quality", "q"), metrics.hinge_loss(d, "quality", "margin")
    return one(spark, "log_loss double, brier double, hinge double", *[round(float(x), 6) for x in got])


@query("WITH x AS (SELECT label % 3 AS y, [(vec_id * 7) % 11, (vec_id * 5) % 13 + 0.5, (vec_id * 3) % 17 + 0.25] AS p FROM embeddings) SELECT round(avg((len(list_filter(p, lambda v: v > p[y + 1])) < 2)::INT), 6) AS top2 FROM x")
def top_two_accuracy(spark, sf):
    e = t(spark, sf, "embeddings").select((F.col("label") % 3).alias("y"), (F.col("vec_id") * 7 % 11).cast("double").alias("p0"), (F.col("vec_id") * 5 % 13 + 0.5).alias("p1"), (F.col("vec_id") * 3 % 17 + 0.25).alias("p2"))
    return one(spark, "top2 double", round(metrics.top_k_accuracy_score(e, "y", ["p0", "p1", "p2"], [0, 1, 2], 2), 6))


TYPED = "SELECT p_type AS k, p_size::DOUBLE AS a, p_retailprice / 100 AS b FROM part"


def typed(spark, sf):
    return t(spark, sf, "part").select("p_type", F.col("p_size").cast("double").alias("a"), (F.col("p_retailprice") / 100).alias("b"))


@query(f"WITH x AS ({TYPED}), c AS (SELECT k, count(*) AS n, avg(a) AS ca, avg(b) AS cb FROM x GROUP BY k), m AS (SELECT avg(a) AS ma, avg(b) AS mb, count(*) AS n FROM x), s AS (SELECT c.k, any_value(ca) AS ca, any_value(cb) AS cb, avg(sqrt((a - ca) ** 2 + (b - cb) ** 2)) AS s, sum((a - ca) ** 2 + (b - cb) ** 2) AS w FROM x JOIN c ON x.k = c.k GROUP BY c.k), ch AS (SELECT (SELECT sum(c.n * ((ca - ma) ** 2 + (cb - mb) ** 2)) FROM c, m) / (SELECT count(*) - 1 FROM c) / ((SELECT sum(w) FROM s) / ((SELECT n FROM m) - (SELECT count(*) FROM c))) AS v), db AS (SELECT avg(r) AS v FROM (SELECT p.k, max((p.s + q.s) / sqrt((p.ca - q.ca) ** 2 + (p.cb - q.cb) ** 2)) AS r FROM s p JOIN s q ON p.k <> q.k GROUP BY p.k)) SELECT round(ch.v, 4) AS calinski_harabasz, round(db.v, 4) AS davies_bouldin FROM ch, db")
def cluster_separation(spark, sf):
    x = typed(spark, sf)
    return one(spark, "calinski_harabasz double, davies_bouldin double", round(metrics.calinski_harabasz_score(x, ["a", "b"], "p_type"), 4), round(metrics.davies_bouldin_score(x, ["a", "b"], "p_type"), 4))


# --- groups far apart --------------------------------------------------------------------

GROUPED = "SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_suppkey % 2) AS least FROM supplier"


def apart(spark, sf):
    return t(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") % 2 * 1000 + F.col("s_suppkey") / 100).alias("x"), F.lit(1.0).alias("y"))


def least_of_cluster(df: DataFrame) -> DataFrame:
    return df.select("s_suppkey", F.min("s_suppkey").over(Window.partitionBy("cluster")).alias("least"))


def _fitted_groups(name: str, est) -> None:
    def run(spark, sf):
        return least_of_cluster(est().fit(apart(spark, sf), ["x", "y"]).predict(apart(spark, sf)))

    run.__name__ = name
    query(GROUPED)(run)


def _labelled_groups(name: str, est) -> None:
    def run(spark, sf):
        return least_of_cluster(est().fit_predict(apart(spark, sf), ["x", "y"], "s_suppkey"))

    run.__name__ = name
    query(GROUPED)(run)


_fitted_groups("kmeans_groups", lambda: cluster.KMeans(2, n_init=2))
_fitted_groups("minibatch_kmeans_groups", lambda: cluster.MiniBatchKMeans(2))
_fitted_groups("birch_groups", lambda: cluster.Birch(2))
_fitted_groups("mean_shift_groups", lambda: cluster.MeanShift(100.0))
_fitted_groups("gaussian_mixture_groups", lambda: cluster.GaussianMixture(2))
_labelled_groups("dbscan_groups", lambda: cluster.DBSCAN(50.0, 2))
_labelled_groups("optics_groups", lambda: cluster.OPTICS(50.0, 2))
_labelled_groups("agglomerative_groups", lambda: cluster.AgglomerativeClustering(2))


@query("SELECT s_suppkey, min(s_suppkey) OVER () AS least FROM supplier")
def optics_everything(spark, sf):
    """With no bound on the distance all rows reach each other."""
    return least_of_cluster(cluster.OPTICS(min_samples=2).fit_predict(apart(spark, sf), ["x", "y"], "s_suppkey"))


@query("SELECT s_suppkey % 2 AS side, round(avg(s_suppkey % 2 * 1000 + s_suppkey / 100), 4) AS center FROM supplier GROUP BY 1")
def kmeans_centers(spark, sf):
    m = cluster.KMeans(2, n_init=2).fit(apart(spark, sf), ["x", "y"])
    return spark.createDataFrame([(int(c[0] > 500), round(float(c[0]), 4)) for c in m.cluster_centers_], "side long, center double")


@query("SELECT round(avg(p_size), 4) AS mean, round(var_pop(p_size), 3) AS var FROM part")
def gaussian_moments(spark, sf):
    m = cluster.GaussianMixture(1).fit(t(spark, sf, "part"), ["p_size"])
    return one(spark, "mean double, var double", round(float(m.means_[0][0]), 4), round(float(m.covariances_[0][0][0]), 3))


# --- spectra -----------------------------------------------------------------------------


def two(spark, sf):
    return lines(spark, sf).select(X, (F.col("l_extendedprice") / 1000).alias("k"))


def spectrum(spark, values) -> DataFrame:
    return spark.createDataFrame([(i + 1, round(float(v), 4)) for i, v in enumerate(values)], "i int, value double")


@query(f"WITH c AS (SELECT var_samp({X}) AS a, var_samp(l_extendedprice / 1000) AS d, covar_samp({X}, l_extendedprice / 1000) AS b FROM lineitem) SELECT 1 AS i, round((a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b), 4) AS value FROM c UNION ALL SELECT 2, round((a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b), 4) FROM c")
def pca_variances(spark, sf):
    return spectrum(spark, decompose.PCA().fit(two(spark, sf), [X, "k"]).explained_variance_)


@query(f"WITH c AS (SELECT sum({X} * {X}) AS a, sum(l_extendedprice * l_extendedprice / 1e6) AS d, sum({X} * l_extendedprice / 1000) AS b FROM lineitem) SELECT 1 AS i, round(sqrt((a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b)), 4) AS value FROM c UNION ALL SELECT 2, round(sqrt((a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b)), 4) FROM c")
def truncated_svd_values(spark, sf):
    return spectrum(spark, decompose.TruncatedSVD(2).fit(two(spark, sf), [X, "k"]).singular_values_)


@query("SELECT p_partkey, p_size::DOUBLE AS a, 2.0::DOUBLE * p_size AS b FROM part")
def nmf_rank_one(spark, sf):
    """A table of rank one comes back whole."""
    p = t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), (2.0 * F.col("p_size")).alias("b"))
    m = decompose.NMF(1).fit(p, ["a", "b"])
    w = F.get("components", F.lit(0))
    return rounded(m.transform(p).select("p_partkey", (w * float(m.components_[0][0])).alias("a"), (w * float(m.components_[0][1])).alias("b")), "a", "b", digits=4)


CENTRED = "SELECT n_nationkey, round(abs(n_nationkey - avg(n_nationkey) OVER ()), 4) AS off FROM nation"


def nations(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", F.col("n_nationkey").cast("double").alias("x"))


@query(CENTRED)
def kernel_pca_linear(spark, sf):
    n = nations(spark, sf)
    m = decompose.KernelPCA(1, "linear").fit(n, ["x"])
    return rounded(m.transform(n).select("n_nationkey", F.abs(F.get("components", F.lit(0))).alias("off")), "off", digits=4)


@query(CENTRED)
def mds_of_a_line(spark, sf):
    return rounded(decompose.MDS(1).fit_transform(nations(spark, sf), ["x"], "n_nationkey").select("n_nationkey", F.abs(F.get("embedding", F.lit(0))).alias("off")), "off", digits=4)


@query(CENTRED)
def isomap_of_a_line(spark, sf):
    return rounded(decompose.Isomap(1).fit_transform(nations(spark, sf), ["x"], "n_nationkey").select("n_nationkey", F.abs(F.get("embedding", F.lit(0))).alias("off")), "off", digits=4)


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, round(exp(-1.0 * (a.n_nationkey - b.n_nationkey) ** 2), 5) AS k FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey")
def nystroem_kernel(spark, sf):
    """With all rows as landmarks products of the features are the kernel."""
    n = nations(spark, sf)
    z = decompose.Nystroem("rbf", 1.0, 25).fit(n, ["x"]).transform(n)
    a, b = z.select(F.col("n_nationkey").alias("a"), F.col("components").alias("u")), z.select(F.col("n_nationkey").alias("b"), F.col("components").alias("v"))
    dot = F.aggregate(F.zip_with("u", "v", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return rounded(a.join(b, F.col("a") < F.col("b")).select("a", "b", dot.alias("k")), "k", digits=5)


@query("SELECT i, CASE i WHEN 0 THEN 1.0 ELSE 0.64 END AS r2, 500::BIGINT AS n FROM range(2) x(i)")
def circles(spark, sf):
    c = synthetic.make_circles(spark, 1000, 0.0, 0.8)
    return c.groupBy(F.col("label").cast("long").alias("i"), F.round(F.col("x0") ** 2 + F.col("x1") ** 2, 6).alias("r2")).agg(F.count("*").alias("n"))


# --- validation ---------------------------------------------------------------------------

FOLDED = "SELECT *, ntile(4) OVER (ORDER BY p_partkey) - 1 AS f FROM part"


@query(f"WITH x AS ({FOLDED}), m AS (SELECT a.f, avg(b.p_retailprice) AS m FROM (SELECT DISTINCT f FROM x) a JOIN x b ON a.f <> b.f GROUP BY a.f) SELECT x.f::INT AS fold, round(-avg((p_retailprice - m) ** 2), 4) AS score FROM x JOIN m ON x.f = m.f GROUP BY x.f")
def cross_validated_mean(spark, sf):
    got = compose.cross_val_score(meta.DummyRegressor(), t(spark, sf, "part"), ["p_size"], "p_retailprice", order_by=["p_partkey"], cv=4, scoring="neg_mean_squared_error")
    return spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(got)], "fold int, score double")


@query(f"WITH x AS ({FOLDED}), m AS (SELECT a.f, avg(b.p_retailprice) AS m, quantile_cont(b.p_retailprice, 0.5) AS h FROM (SELECT DISTINCT f FROM x) a JOIN x b ON a.f <> b.f GROUP BY a.f), s AS (SELECT x.f, -avg(abs(p_retailprice - m)) AS mean, -avg(abs(p_retailprice - h)) AS median FROM x JOIN m ON x.f = m.f GROUP BY x.f) SELECT CASE WHEN avg(mean) >= avg(median) THEN 'mean' ELSE 'median' END AS strategy, round(greatest(avg(mean), avg(median)), 4) AS score FROM s")
def grid_search_dummy(spark, sf):
    g = compose.GridSearchCV(meta.DummyRegressor(), {"strategy": ["mean", "median"]}, cv=4, scoring="neg_mean_absolute_error").fit(t(spark, sf, "part"), ["p_size"], "p_retailprice", order_by=["p_partkey"])
    return one(spark, "strategy string, score double", g.best_params_["strategy"], round(float(g.best_score_), 4))


@query("SELECT i::INT AS split, (n - floor(n * 0.2))::BIGINT AS train, floor(n * 0.2)::BIGINT AS test, 0::BIGINT AS shared FROM range(3) r(i), (SELECT count(*) AS n FROM part)")
def shuffle_split_sizes(spark, sf):
    rows = []
    for i, (a, b) in enumerate(split.ShuffleSplit(3, 0.2).split(t(spark, sf, "part").select("p_partkey"), ["p_partkey"])):
        rows.append((i, a.count(), b.count(), a.join(b, "p_partkey").count()))
    return spark.createDataFrame(rows, "split int, train long, test long, shared long")


@query("SELECT r_regionkey::BIGINT AS left_out, (SELECT count(*) FROM region) - 1 AS train FROM region")
def leave_one_out(spark, sf):
    return spark.createDataFrame([(int(b.first()["r_regionkey"]), a.count()) for a, b in split.LeaveOneOut().split(t(spark, sf, "region"), ["r_regionkey"])], "left_out long, train long")


@query("SELECT p_partkey FROM part")
def shuffled_rows(spark, sf):
    return split.shuffle(t(spark, sf, "part").select("p_partkey"), ["p_partkey"], 3)


# --- preparing -----------------------------------------------------------------------------

HOLES = "SELECT n_nationkey AS k, n_nationkey + 0.01 * n_nationkey * n_nationkey AS x, CASE WHEN n_nationkey % 7 <> 0 THEN 3.0 * n_nationkey END AS y FROM nation"


@query(f"WITH t AS ({HOLES}), m AS (SELECT avg(y) AS m FROM t), d AS (SELECT a.k, b.y, row_number() OVER (PARTITION BY a.k ORDER BY (a.x - b.x) ** 2 + (m - b.y) ** 2) AS r FROM t a, t b, m WHERE a.y IS NULL AND b.y IS NOT NULL) SELECT k, round(avg(y), 4) AS y FROM d WHERE r <= 3 GROUP BY k UNION ALL SELECT k, round(y, 4) FROM t WHERE y IS NOT NULL")
def knn_impute(spark, sf):
    n = t(spark, sf, "nation")
    k = F.col("n_nationkey")
    d = n.select(k.alias("k"), (k + 0.01 * k * k).alias("x"), F.when(k % 7 != 0, 3.0 * k).alias("y"))
    return rounded(prepare.KNNImputer(3).fit(d, ["x", "y"]).transform(d, "k").select("k", "y"), "y", digits=4)


@query("WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS s FROM customer), m AS (SELECT s FROM x WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1) SELECT c_custkey, coalesce(x.s, m.s) AS s FROM x, m")
def impute_mode(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("s"))
    return prepare.SimpleImputer("most_frequent").fit(c, ["s"]).transform(c)


@query("SELECT d.doc_id, coalesce(lang, 'None') AS lang, coalesce(quality::VARCHAR, 'None') AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def stringified(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", "lang").join(t(spark, sf, "labels"), "doc_id", "left")
    return d.select("doc_id", text_of(d, "lang").alias("lang"), text_of(d, "quality").alias("quality"))


# --- series ---------------------------------------------------------------------------------

DAILY = "SELECT date_trunc('day', ts)::DATE AS d, count(*)::DOUBLE AS y FROM events GROUP BY 1"


def days(spark, sf):
    return t(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count("*").cast("double").alias("y"))


@query(f"WITH s AS ({DAILY}), l AS (SELECT y, lag(y) OVER (ORDER BY d) AS z FROM s), m AS (SELECT regr_slope(y, z) AS b, regr_intercept(y, z) AS a, (SELECT y FROM s ORDER BY d DESC LIMIT 1) AS last FROM l) SELECT 1 AS h, round(a + b * last, 4) AS forecast FROM m UNION ALL SELECT 2, round(a + b * (a + b * last), 4) FROM m UNION ALL SELECT 3, round(a + b * (a + b * (a + b * last)), 4) FROM m")
def ar_forecast(spark, sf):
    return rounded(series.ARForecaster(1).fit(days(spark, sf), "d", "y").predict(3).select("h", "forecast"), "forecast", digits=4)


@query(f"WITH s AS ({DAILY}), r AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS k, count(*) OVER () AS n FROM s) SELECT d, k <= floor(n * 0.2) AS test FROM r")
def temporal_tail(spark, sf):
    a, b = series.temporal_split(days(spark, sf), "d", 0.2)
    return a.select("d", F.lit(False).alias("test")).union(b.select("d", F.lit(True).alias("test")))


@query(f"WITH s AS ({DAILY}), r AS (SELECT y, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS n FROM s), e AS (SELECT f, (SELECT y FROM r WHERE k = n - 3 * (2 - f)) AS last FROM range(2) x(f)) SELECT f::INT AS fold, round(avg(abs(y - last)), 4) AS mae FROM e, r WHERE k > n - 3 * (2 - f) AND k <= n - 3 * (2 - f) + 3 GROUP BY f")
def rolling_naive(spark, sf):
    got = series.rolling_origin_cv(days(spark, sf), "d", "y", series.NaiveForecaster(), horizon=3, folds=2)
    return spark.createDataFrame([(i, round(float(v), 4)) for i, v in enumerate(got)], "fold int, mae double")


@query(f"WITH s AS ({DAILY}), m AS (SELECT avg(y) AS m FROM s), g AS (SELECT avg(abs(y - z)) AS g FROM (SELECT y, lag(y) OVER (ORDER BY d) AS z FROM s)) SELECT round(avg(abs(y - m)) / any_value(g), 6) AS mase FROM s, m, g")
def mase_of_the_mean(spark, sf):
    s = days(spark, sf)
    return one(spark, "mase double", round(series.mase(s, s.crossJoin(s.agg(F.avg("y").alias("m"))), "d", "y", "y", "m"), 6))


# --- tables and files ---------------------------------------------------------------------


def _round_trip(kind: str) -> None:
    def run(spark, sf):
        n = t(spark, sf, "nation")
        at = f"{scratch_path(spark, 'nation')}.{kind}"
        files.save_dataset(n, at)
        return files.load_any(spark, at).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))

    run.__name__ = f"{kind}_round_trip"
    query("SELECT n_nationkey, n_name, n_regionkey FROM nation")(run)


for _kind in ("csv", "json", "parquet"):
    _round_trip(_kind)


@query("SELECT 0 AS chunk, 10::BIGINT AS n UNION ALL SELECT 1, 10 UNION ALL SELECT 2, count(*) - 20 FROM nation")
def csv_chunks(spark, sf):
    at = f"{scratch_path(spark, 'nation')}.csv"
    files.save_dataset(t(spark, sf, "nation"), at)
    return spark.createDataFrame([(i, len(c)) for i, c in enumerate(files.chunked_csv(spark, at, 10))], "chunk int, n long")


@query("SELECT * FROM (VALUES (0, 'n_nationkey', 'int', 25), (1, 'n_name', 'string', 25), (2, 'n_regionkey', 'int', 25)) x(cid, name, type, n_rows)")
def table_info_and_profile(spark, sf):
    db = Database.from_uri(spark, sf)
    return db.table_info("nation").select("cid", "name", "type", F.lit(db.profile("nation").n_rows).cast("int").alias("n_rows"))


@query("SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS name")
def listed_tables(spark, sf):
    db = Database(spark)
    known = db.register_folder(sf)
    return spark.createDataFrame([(n,) for n in db.list_tables() if n in known], "name string")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 5")
def query_with_parameters(spark, sf):
    views(spark, sf, "nation")
    return Database(spark).query("SELECT n_name FROM nation WHERE n_regionkey = ? AND n_nationkey > ?", [2, 5])


@query("SELECT 'p_brand' AS col, 'classification' AS task UNION ALL SELECT 'p_retailprice', 'regression'")
def detected_tasks(spark, sf):
    p = t(spark, sf, "part")
    return spark.createDataFrame([(c, automl.detect_task(p, c)) for c in ("p_brand", "p_retailprice")], "col string, task string")


sql_query("sql_cross_join", "SELECT n_name, r_name FROM nation CROSS JOIN region", "nation", "region")
sql_query("sql_theta_join", "SELECT a.s_suppkey AS a, count(*) AS richer FROM supplier a JOIN supplier b ON b.s_acctbal > a.s_acctbal GROUP BY a.s_suppkey", "supplier")
sql_query("sql_right_join", "SELECT n_name, count(s_suppkey) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name", "supplier", "nation")
sql_query("sql_approx_distinct", "SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types FROM part", "part", spark_text="SELECT approx_count_distinct(p_brand, 0.01) AS brands, approx_count_distinct(p_type, 0.01) AS types FROM part")
