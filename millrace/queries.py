"""Named queries over the test tables, one for each family of operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.columns import clip, number
from .functions.text import clean_text, ngrams, normalize_arabic, tokens
from .operators import bayes, cluster, encode, linear, metrics, neighbors, prepare, profile, select, series, split, trees, words

from .plans import automl
from .sources.database import Database, QueryBuilder, numeric_matrix
from .streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def views(spark: SparkSession, sf: str, *names: str) -> None:
    for n in names:
        t(spark, sf, n).createOrReplaceTempView(n)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def sql_query(name: str, text: str, *tables: str, spark_text: str | None = None) -> None:
    """The same text for both engines, unless Spark spells it differently."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        views(spark, sf, *tables)
        return Database(spark).query(spark_text or text)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, text


# --- SELECT builder and pass-through SQL -------------------------------------------

BUILT = QueryBuilder("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice").where("l_quantity > 45").where("l_returnflag = 'R'").order_by("l_extendedprice DESC, l_orderkey, l_linenumber").limit(50).offset(5)


@query(BUILT.build().rstrip(";"))
def qb_filter_topk(spark, sf):
    views(spark, sf, "lineitem")
    return BUILT.to_df(spark)


sql_query("sql_join_agg_revenue", "SELECT n_name, year(o_orderdate) AS o_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_shipdate >= DATE '1996-01-01' GROUP BY n_name, year(o_orderdate)", "lineitem", "orders", "customer", "nation")
sql_query("sql_left_join_orders", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", "customer", "orders")
sql_query("sql_full_join_nations", "SELECT coalesce(c.k, s.k) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey) s ON c.k = s.k", "customer", "supplier")
sql_query("sql_left_anti_customers", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)", "customer", "orders")
sql_query("sql_semi_parts", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)", "part", "lineitem")
sql_query("sql_range_join", "SELECT r.r_name, count(*) AS n FROM region r JOIN nation a ON a.n_regionkey = r.r_regionkey JOIN nation b ON b.n_regionkey = r.r_regionkey AND a.n_nationkey < b.n_nationkey GROUP BY r.r_name", "region", "nation")
sql_query("sql_rollup_flags", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g1, grouping(l_linestatus) AS g2, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
sql_query("sql_cube_orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
sql_query("sql_grouping_sets", "SELECT p_brand, p_type, count(*) AS n, max(p_size) AS top FROM part GROUP BY GROUPING SETS ((p_brand), (p_type), ())", "part")
sql_query("sql_having_distinct", "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 5", "lineitem")
sql_query("sql_window_rank", "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS rk, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 4) AS step, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM orders", "orders")
sql_query("sql_set_ops", "(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1", "customer", "supplier", "nation")
sql_query("sql_recursive_cte", "WITH RECURSIVE steps(i, total) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, total + i + 1 FROM steps WHERE i < 20) SELECT i, total FROM steps", "region")
sql_query("sql_correlated_subquery", "SELECT p_partkey, p_retailprice FROM part p WHERE p_retailprice > (SELECT avg(q.p_retailprice) * 1.05 FROM part q WHERE q.p_brand = p.p_brand)", "part")
sql_query("sql_json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type", "events", spark_text="SELECT event_type, count(*) AS n, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type")


@query("SELECT e.event_id, p.event_id AS last_view, (epoch_us(e.ts) - epoch_us(p.ts)) // 1000000 AS age FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND p.ts <= e.ts")
def sql_asof_events(spark, sf):
    """As-of join by one sort of both sides together: no pairs are made."""
    e = t(spark, sf, "events")
    views_ = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("v")).select("user_id", "ts", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("event_id"), F.struct("v", "ts").alias("seen"))
    buys = e.where("event_type = 'purchase'").select("user_id", "ts", F.lit(1).alias("kind"), "event_id", F.lit(None).cast("struct<v:long,ts:timestamp_ntz>").alias("seen"))
    w = Window.partitionBy("user_id").orderBy("ts", "kind").rowsBetween(Window.unboundedPreceding, 0)
    out = views_.union(buys).withColumn("last", F.last("seen", True).over(w)).where("kind = 1")
    return out.select("event_id", F.col("last.v").alias("last_view"), F.expr("timestampdiff(SECOND, last.ts, ts)").alias("age"))


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_shipdate < DATE '1995-02-01'")
def read_parquet_filter(spark, sf):
    return Database(spark).read_parquet(f"{sf}/lineitem.parquet", "l_shipdate < date'1995-02-01'").select("l_orderkey", "l_quantity")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def table_count(spark, sf):
    views(spark, sf, "orders")
    return spark.createDataFrame([(Database(spark).count("orders", "o_orderstatus = 'O'"),)], "n long")


@query("SELECT coalesce(try_cast(p_partkey AS DOUBLE), 0) AS p_partkey, coalesce(try_cast(p_name AS DOUBLE), 0) AS p_name, coalesce(try_cast(p_size AS DOUBLE), 0) AS p_size, p_brand FROM part")
def load_xy_part(spark, sf):
    return numeric_matrix(t(spark, sf, "part").select("p_partkey", "p_name", "p_size", "p_brand"), "p_brand")[0]


@query("SELECT o_orderkey, pos FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) WHERE pos IN (0, 7, 99, 1000)")
def safe_indexing(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey")
    pos = spark.createDataFrame([(i,) for i in (0, 7, 99, 1000)], "pos long")
    return split.positions(split.take_rows(o, pos, "o_orderkey"), "o_orderkey", "nth").join(split.positions(o, "o_orderkey"), "o_orderkey").select("o_orderkey", "pos")


# --- profiling ----------------------------------------------------------------------

LABELLED = "SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def labelled(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "lang", "n_chars").join(t(spark, sf, "labels"), "doc_id", "left")


@query(f"WITH x AS ({LABELLED}) SELECT 'lang' AS \"column\", count(*) FILTER (lang IS NULL) AS n_missing, round(100.0 * count(*) FILTER (lang IS NULL) / count(*), 2) AS pct FROM x UNION ALL SELECT 'quality', count(*) FILTER (quality IS NULL), round(100.0 * count(*) FILTER (quality IS NULL) / count(*), 2) FROM x UNION ALL SELECT 'toxic', count(*) FILTER (toxic IS NULL), round(100.0 * count(*) FILTER (toxic IS NULL) / count(*), 2) FROM x")
def missing_report(spark, sf):
    return profile.missing_report(labelled(spark, sf).select("lang", "quality", "toxic"))


NUMS = ["l_quantity", "l_extendedprice", "l_discount"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.5), 6) AS median FROM lineitem" for c in NUMS))
def describe(spark, sf):
    return rounded(profile.describe(t(spark, sf, "lineitem").select(*NUMS)), "mean", "std", "median")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a in NUMS for b in NUMS))
def corr_matrix(spark, sf):
    return rounded(profile.correlation_matrix(t(spark, sf, "lineitem").select(*NUMS)), "corr")


def _ranked(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@query(f"WITH r AS (SELECT {_ranked('p_size')} AS x, {_ranked('p_retailprice')} AS y FROM part) SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(x, y), 6) AS corr FROM r UNION ALL SELECT 'p_retailprice', 'p_size', round(corr(x, y), 6) FROM r UNION ALL SELECT 'p_size', 'p_size', 1.0 UNION ALL SELECT 'p_retailprice', 'p_retailprice', 1.0")
def corr_spearman(spark, sf):
    return rounded(profile.correlation_matrix(t(spark, sf, "part").select("p_size", "p_retailprice"), method="spearman"), "corr")


@query("WITH e AS (SELECT label AS x, vec_id % 7 AS y FROM embeddings), p AS (SELECT sum(sign(l.x - r.x) * sign(l.y - r.y)) AS s, sum(CAST(l.x <> r.x AS INT)) AS dx, sum(CAST(l.y <> r.y AS INT)) AS dy FROM e l, e r) SELECT 'x' AS a, 'y' AS b, round(s / sqrt(CAST(dx AS DOUBLE) * dy), 6) AS corr FROM p UNION ALL SELECT 'y', 'x', round(s / sqrt(CAST(dx AS DOUBLE) * dy), 6) FROM p UNION ALL SELECT 'x', 'x', 1.0 UNION ALL SELECT 'y', 'y', 1.0")
def corr_kendall(spark, sf):
    return rounded(profile.correlation_matrix(t(spark, sf, "embeddings").select(F.col("label").alias("x"), (F.col("vec_id") % 7).alias("y")), method="kendall"), "corr")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_outliers FROM {tb}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {tb})" for c, tb in (("value", "events"),)))
def outliers_iqr(spark, sf):
    return profile.outlier_report(t(spark, sf, "events").select("value"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (abs({c} - m) / s > 1.5) AS n_outliers FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM lineitem)" for c in NUMS))
def outliers_zscore(spark, sf):
    return profile.outlier_report(t(spark, sf, "lineitem").select(*NUMS), method="zscore")


@query("SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand ORDER BY count DESC, value LIMIT 10")
def value_counts(spark, sf):
    return profile.value_counts(t(spark, sf, "part"), "p_brand", 10)


@query("SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey, l_returnflag, l_linestatus)")
def duplicate_count(spark, sf):
    return profile.duplicate_count(t(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus"))


# --- cleaning, scaling, encoding ------------------------------------------------------


@query(f"WITH x AS (SELECT DISTINCT l_suppkey, l_quantity, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS p FROM lineitem), a AS (SELECT l_suppkey, l_quantity, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS p FROM lineitem), m AS (SELECT quantile_cont(p, 0.5) AS med FROM a), b AS (SELECT {', '.join(f'quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_lo, quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_hi' for c in ('l_suppkey', 'l_quantity', 'p'))} FROM (SELECT l_suppkey, l_quantity, coalesce(p, med) AS p FROM a, m)) SELECT {', '.join(f'round(least(greatest({e}, {c}_lo), {c}_hi), 4) AS {c}' for c, e in (('l_suppkey', 'CAST(l_suppkey AS DOUBLE)'), ('l_quantity', 'l_quantity'), ('p', 'coalesce(p, med)')))} FROM x, m, b")
def data_cleaner_iqr(spark, sf):
    x = t(spark, sf, "lineitem").select("l_suppkey", "l_quantity", F.when(F.col("l_partkey") % 11 != 0, F.col("l_extendedprice")).alias("p"), F.lit("same").alias("c"))
    return rounded(prepare.DataCleaner(outlier_clip="iqr").fit_transform(x), "l_suppkey", "l_quantity", "p", digits=4)


@query(f"WITH x AS ({LABELLED}) SELECT doc_id, coalesce(quality, (SELECT quantile_cont(quality, 0.5) FROM x))::DOUBLE AS quality, coalesce(toxic, (SELECT quantile_cont(toxic, 0.5) FROM x))::DOUBLE AS toxic FROM x")
def impute_median(spark, sf):
    x = labelled(spark, sf).select("doc_id", F.col("quality").cast("double"), F.col("toxic").cast("double"))
    return prepare.SimpleImputer("median").fit(x, ["quality", "toxic"]).transform(x)


def _scaled(name, shift, scale):
    return f"SELECT l_orderkey, l_linenumber, round((l_quantity - {shift}) / {scale}, 6) AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi, max(abs(l_quantity)) AS ma, quantile_cont(l_quantity, 0.5) AS med, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS iqr FROM lineitem)"


def _scale(name, scaler):
    def run(spark, sf):
        x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
        return rounded(scaler.clone().fit_transform(x, ["l_quantity"]), "l_quantity")

    run.__name__ = name
    return run


for _n, _s, _shift, _by in (("standard_scale", prepare.StandardScaler(), "m", "s"), ("minmax_scale", prepare.MinMaxScaler(), "lo", "(hi - lo)"), ("maxabs_scale", prepare.MaxAbsScaler(), "0", "ma"), ("robust_scale", prepare.RobustScaler(), "med", "iqr")):
    query(_scaled(_n, _shift, _by))(_scale(_n, _s))


@query("SELECT vec_id, round(embedding[1] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS e1, round(embedding[64] / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS e64 FROM embeddings")
def normalize_l2(spark, sf):
    e = prepare.Normalizer("l2").fit_transform(t(spark, sf, "embeddings"), "embedding")
    return rounded(e.select("vec_id", F.col("embedding")[0].alias("e1"), F.col("embedding")[63].alias("e64")), "e1", "e64")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS l_quantity FROM lineitem")
def binarize(spark, sf):
    return prepare.binarize(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity"], 25)


@query("SELECT p_partkey, 1.0::DOUBLE AS p0, p_size::DOUBLE AS p1, p_retailprice AS p2, round(p_size::DOUBLE * p_size, 4) AS p3, round(p_size * p_retailprice, 4) AS p4, round(p_retailprice * p_retailprice, 4) AS p5 FROM part")
def poly_features(spark, sf):
    p = prepare.PolynomialFeatures(2).fit_transform(t(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return rounded(p.drop("p_size", "p_retailprice"), "p3", "p4", "p5", digits=4)


@query("SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN l_returnflag = '{c}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"l_returnflag_{c}\"" for c in "ANR") + " FROM lineitem")
def one_hot(spark, sf):
    return encode.OneHotEncoder().fit_transform(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), ["l_returnflag"]).drop("l_returnflag")


@query("SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size < 10) THEN (SELECT count(DISTINCT q.p_brand) FROM part q WHERE q.p_size < 10 AND q.p_brand < part.p_brand)::INT ELSE -1 END AS p_brand FROM part")
def ordinal(spark, sf):
    p = t(spark, sf, "part").select("p_partkey", "p_brand", "p_size")
    return encode.OrdinalEncoder().fit(p.where("p_size < 10"), ["p_brand"]).transform(p).drop("p_size")


@query("SELECT c_custkey, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INT AS c_mktsegment FROM customer")
def label_encode(spark, sf):
    c = t(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return encode.LabelEncoder().fit(c, "c_mktsegment").transform(c)


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = (SELECT max(l_linestatus) FROM lineitem) THEN 1 ELSE 0 END AS last_status FROM lineitem")
def label_binarize(spark, sf):
    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    out = encode.LabelBinarizer().fit(x, "l_linestatus").transform(x)
    return out.select("l_orderkey", "l_linenumber", F.col(out.columns[-1]).alias("last_status"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS d_year, month(o_orderdate)::INT AS d_month, day(o_orderdate)::INT AS d_day, (isodow(o_orderdate) - 1)::INT AS d_dow, quarter(o_orderdate)::INT AS d_quarter, (isodow(o_orderdate) >= 6)::INT AS d_weekend FROM orders")
def date_features(spark, sf):
    return encode.DateFeaturizer("d").fit_transform(t(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").alias("d")))


@query("SELECT o_orderkey, round(e, 6) AS o_orderpriority FROM orders JOIN (SELECT o_orderpriority AS k, (sum(o_totalprice) + 10 * (SELECT avg(o_totalprice) FROM orders)) / (count(*) + 10) AS e FROM orders GROUP BY o_orderpriority) ON o_orderpriority = k")
def target_encode(spark, sf):
    x = t(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(encode.TargetEncoder().fit(x, ["o_orderpriority"], "o_totalprice").transform(x).drop("o_totalprice"), "o_orderpriority")


@query("SELECT o_orderkey, round(count(*) OVER (PARTITION BY o_orderstatus) / (count(*) OVER ()), 6) AS o_orderstatus FROM orders")
def freq_encode(spark, sf):
    x = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return rounded(encode.FrequencyEncoder().fit_transform(x, ["o_orderstatus"]), "o_orderstatus")


@query("SELECT p_partkey, ((p_retailprice >= q[2])::INT + (p_retailprice >= q[3])::INT + (p_retailprice >= q[4])::INT) AS p_retailprice FROM part, (SELECT quantile_cont(p_retailprice, [0, 0.25, 0.5, 0.75, 1]) AS q FROM part)")
def quantile_bin(spark, sf):
    x = t(spark, sf, "part").select("p_partkey", "p_retailprice")
    return encode.NumericBinner(4).fit_transform(x, ["p_retailprice"])


@query("SELECT p_partkey, " + " + ".join(f"(p_size >= lo + (hi - lo) * {k}::DOUBLE / 5)::INT" for k in range(1, 5)) + " AS p_size FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part)")
def uniform_bin(spark, sf):
    x = t(spark, sf, "part").select("p_partkey", "p_size")
    return encode.NumericBinner(5, "uniform").fit_transform(x, ["p_size"])


@query("SELECT s_suppkey, s_acctbal AS s_acctbal, " + ", ".join(f"(s_nationkey % 3 = {k})::INT::DOUBLE AS \"n={k}\"" for k in range(3)) + " FROM supplier")
def auto_featurize(spark, sf):
    x = t(spark, sf, "supplier").select("s_suppkey", "s_acctbal", (F.col("s_nationkey") % 3).cast("string").alias("n"))
    out = encode.auto_featurize(x, keep=["s_suppkey"])[0]
    missing = [f"n={k}" for k in range(3) if f"n={k}" not in out.columns]
    return out.withColumns({c: F.lit(0.0) for c in missing}).select("s_suppkey", "s_acctbal", *[f"`n={k}`" for k in range(3)])


@query("SELECT o_orderkey, coalesce(try_cast(o_orderstatus AS DOUBLE), 0) AS num, CASE WHEN o_totalprice < 50000 THEN 50000 WHEN o_totalprice > 150000 THEN 150000 ELSE o_totalprice END AS clipped FROM orders")
def coerce_and_clip(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", number(F.col("o_orderstatus")).alias("num"), clip(F.col("o_totalprice"), 50000.0, 150000.0).alias("clipped"))


# --- selection and statistics ---------------------------------------------------------


@query("WITH g AS (SELECT l_returnflag AS y, count(*) AS n, sum(l_quantity) AS s0, sum(l_tax) AS s1 FROM lineitem GROUP BY l_returnflag), w AS (SELECT sum(n) AS nn, sum(s0) AS t0, sum(s1) AS t1 FROM g) SELECT 0 AS i, round(sum((s0 - n / nn * t0) * (s0 - n / nn * t0) / (n / nn * t0)), 5) AS chi2 FROM g, w UNION ALL SELECT 1, round(sum((s1 - n / nn * t1) * (s1 - n / nn * t1) / (n / nn * t1)), 5) FROM g, w")
def chi2_stat(spark, sf):
    return rounded(select.chi2_df(t(spark, sf, "lineitem"), ["l_quantity", "l_tax"], "l_returnflag"), "chi2", digits=5)


@query("WITH g AS (SELECT l_returnflag AS y, count(*) AS n, avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem GROUP BY l_returnflag), w AS (SELECT sum(n * m) / sum(n) AS mm FROM g) SELECT 0 AS i, round((sum(n * (m - mm) * (m - mm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 5) AS f, (count(*) - 1)::BIGINT AS dfb, (sum(n) - count(*))::BIGINT AS dfw FROM g, w")
def f_classif_stat(spark, sf):
    return rounded(select.f_classif_df(t(spark, sf, "lineitem"), ["l_quantity"], "l_returnflag"), "f", digits=5)


@query("SELECT 0 AS i, round(power(corr(l_quantity, l_extendedprice), 2) * (count(*) - 2) / (1 - power(corr(l_quantity, l_extendedprice), 2)), 4) AS f, count(*) - 2 AS dof FROM lineitem")
def f_regression_stat(spark, sf):
    return rounded(select.f_regression_df(t(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice"), "f", digits=4)


@query("SELECT 'p_size' AS feature, round(var_pop(p_size), 6) AS variance FROM part UNION ALL SELECT 'p_retailprice', round(var_pop(p_retailprice), 6) FROM part")
def variance_threshold(spark, sf):
    m = select.VarianceThreshold(0.5).fit(t(spark, sf, "part"), ["p_size", "p_retailprice"])
    return rounded(spark.createDataFrame([(c, v) for c, v in zip(m.all_, m.variances_) if c in m.selected_], "feature string, variance double"), "variance")


# --- splits ---------------------------------------------------------------------------


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) > (SELECT count(*) - floor(count(*) * 0.25) FROM orders) AS is_test FROM orders")
def train_test_tail(spark, sf):
    return split.with_test_flag(t(spark, sf, "orders").select("o_orderkey"), order_by="o_orderkey", test_size=0.25)


@query("WITH n AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) > n - least(floor(n * 0.2), n - 1) AS is_test FROM orders JOIN n ON s = o_orderstatus")
def train_test_stratified(spark, sf):
    return split.with_test_flag(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), order_by="o_orderkey", test_size=0.2, stratify="o_orderstatus")


@query("SELECT o_orderkey, (ntile(7) OVER (ORDER BY o_orderkey) - 1)::INT AS fold FROM orders")
def kfold(spark, sf):
    return split.KFold(7).folds(t(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) % 5)::INT AS fold FROM orders")
def stratified_kfold(spark, sf):
    return split.StratifiedKFold(5).folds(t(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus").drop("o_orderstatus")


# --- metrics --------------------------------------------------------------------------

PRED = "SELECT vec_id, label AS y, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS p FROM embeddings"


def predicted(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", F.col("label").alias("y"), F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("p"))


def binary(spark, sf):
    o = t(spark, sf, "orders")
    y = (F.col("o_orderstatus") == "O").cast("int")
    return o.select(F.col("o_orderkey").alias("id"), y.alias("y"), (F.pmod(F.col("o_custkey"), F.lit(40)) / 40 + y * 0.1).alias("s"))


BIN = "SELECT o_orderkey AS id, (o_orderstatus = 'O')::INT AS y, (o_custkey % 40) / 40 + (o_orderstatus = 'O')::INT * 0.1::DOUBLE AS s FROM orders"


@query(f"WITH x AS ({PRED}), l AS (SELECT DISTINCT y AS v FROM x UNION SELECT p FROM x) SELECT a.v AS y, b.v AS p, (SELECT count(*) FROM x WHERE x.y = a.v AND x.p = b.v)::DOUBLE AS n FROM l a, l b")
def confusion(spark, sf):
    return metrics.confusion_df(predicted(spark, sf), "y", "p")


@query(f"WITH x AS ({PRED}), l AS (SELECT DISTINCT y AS v FROM x UNION SELECT p FROM x), e AS (SELECT v, count(*) FILTER (y = v AND p = v) AS tp, count(*) FILTER (y = v) AS s, count(*) FILTER (p = v) AS q FROM l, x GROUP BY v) SELECT round(avg(tp / q), 6) AS precision, round(avg(tp / s), 6) AS recall, round(avg(2 * tp / (q + s)), 6) AS f1 FROM e")
def prf_macro(spark, sf):
    return rounded(metrics.prf_average_df(predicted(spark, sf), "y", "p", "macro"), "precision", "recall", "f1")


@query(f"WITH x AS ({PRED}), l AS (SELECT DISTINCT y AS v FROM x UNION SELECT p FROM x), e AS (SELECT v, count(*) FILTER (y = v AND p = v) AS tp, count(*) FILTER (y = v) AS s, count(*) FILTER (p = v) AS q FROM l, x GROUP BY v) SELECT round((sum(tp) * sum(s) - sum(s * q)) / sqrt((sum(s) * sum(s) - sum(q * q))::DOUBLE * (sum(s) * sum(s) - sum(s * s))), 6) AS mcc FROM e")
def matthews(spark, sf):
    return rounded(metrics.matthews_df(predicted(spark, sf), "y", "p"), "mcc")


@query(f"WITH x AS ({BIN}), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM x) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r")
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc_df(binary(spark, sf), "y", "s"), "auc")


@query(f"WITH x AS ({BIN}), g AS (SELECT s, sum(y) AS pos, count(*) AS n FROM x GROUP BY s), c AS (SELECT s, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM g WINDOW w AS (ORDER BY s DESC)) SELECT round(sum(pos * tp / n) / sum(pos), 6) AS ap FROM c")
def average_precision(spark, sf):
    return rounded(metrics.average_precision_df(binary(spark, sf), "y", "s"), "ap")


@query("WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem), m AS (SELECT avg(y) AS my, avg(y - p) AS md FROM x) SELECT round(avg((y - p) * (y - p)), 2) AS mse, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(quantile_cont(abs(y - p), 0.5), 4) AS medae, round(max(abs(y - p)), 4) AS max_error, round(1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 6) AS r2, round(1 - sum((y - p - md) * (y - p - md)) / sum((y - my) * (y - my)), 6) AS explained_variance, round(avg(abs((y - p) / y)), 6) AS mape, round(avg(power(ln(1 + y) - ln(1 + p), 2)), 6) AS msle FROM x, m")
def regression_metrics(spark, sf):
    x = t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))
    r = rounded(metrics.regression_df(x, "y", "p").drop("least"), "rmse", "mae", "medae", "max_error", digits=4)
    return rounded(rounded(r, "mse", digits=2), "r2", "explained_variance", "mape", "msle")


@query(f"WITH x AS ({PRED}), c AS (SELECT y, p, count(*) AS n FROM x GROUP BY y, p), a AS (SELECT sum(n) AS n FROM c GROUP BY y), b AS (SELECT sum(n) AS n FROM c GROUP BY p), t AS (SELECT sum(n) AS t FROM c), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS sc, (SELECT sum(n * (n - 1) / 2) FROM a) AS sa, (SELECT sum(n * (n - 1) / 2) FROM b) AS sb, (SELECT -sum(n / t * ln(n / t)) FROM c, t) AS hc, (SELECT -sum(n / t * ln(n / t)) FROM a, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM b, t) AS hb, t FROM t) SELECT round((sc - sa * sb / (t * (t - 1) / 2)) / (0.5 * (sa + sb) - sa * sb / (t * (t - 1) / 2)), 6) AS ari, round(sc / sqrt(sa * sb), 6) AS fowlkes_mallows, round(ha + hb - hc, 6) AS mutual_info, round((ha + hb - hc) / ha, 6) AS homogeneity, round((ha + hb - hc) / hb, 6) AS completeness, round(2 * (ha + hb - hc) / (ha + hb), 6) AS v_measure FROM s")
def cluster_agreement(spark, sf):
    r = metrics.cluster_scores_df(predicted(spark, sf), "y", "p")
    return rounded(r, *r.columns)


@query("WITH r AS (SELECT o_custkey AS q, CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END AS g, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r1, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 2 WHEN 'P' THEN 1 ELSE 0 END DESC, o_orderkey) AS r2 FROM orders) SELECT q AS query, round(sum(g / log2(r1 + 1)) FILTER (r1 <= 5), 6) AS dcg, round(sum(g / log2(r2 + 1)) FILTER (r2 <= 5), 6) AS ideal FROM r GROUP BY q")
def ndcg(spark, sf):
    x = t(spark, sf, "orders").withColumn("g", F.when(F.col("o_orderstatus") == "O", 2).when(F.col("o_orderstatus") == "P", 1).otherwise(0))
    return rounded(metrics.dcg_df(x, "o_custkey", "g", "o_totalprice", 5, "o_orderkey"), "dcg", "ideal")


DIST = "sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: power(z[1]::DOUBLE - z[2]::DOUBLE, 2))))"


@query(f"SELECT a.vec_id AS a, b.vec_id AS b, round({DIST}, 5) AS distance FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0")
def pairwise_euclidean(spark, sf):
    e = t(spark, sf, "embeddings")
    return rounded(metrics.pairwise_distances(e.where("vec_id % 100 = 0"), e, "embedding", "vec_id"), "distance", digits=5)


@query(f"WITH d AS (SELECT a.vec_id AS id, a.label AS l, b.label AS o, sum({DIST}) AS t, count(*) AS n FROM embeddings a, embeddings b GROUP BY 1, 2, 3), s AS (SELECT id, sum(t / (n - 1)) FILTER (l = o) AS a, min(t / n) FILTER (l <> o) AS b FROM d GROUP BY id) SELECT id, round((b - a) / greatest(a, b), 5) AS silhouette FROM s")
def silhouette(spark, sf):
    return rounded(metrics.silhouette_samples(t(spark, sf, "embeddings"), "embedding", "label", "vec_id"), "silhouette", digits=5)


# --- series ---------------------------------------------------------------------------

DAILY = "SELECT CAST(ts AS DATE) AS d, sum(value) AS y FROM events GROUP BY 1"


def daily(spark, sf):
    return t(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("d")).agg(F.sum("value").alias("y"))


@query(f"SELECT (range + 1)::INT AS h, round((SELECT max_by(y, d) FROM ({DAILY})), 4) AS forecast FROM range(7)")
def naive_forecast(spark, sf):
    return rounded(series.NaiveForecaster().fit(daily(spark, sf), "d", "y").predict(7), "forecast", digits=4)


@query(f"WITH x AS (SELECT y, row_number() OVER (ORDER BY d DESC) AS r FROM ({DAILY})) SELECT (range + 1)::INT AS h, round(y, 4) AS forecast FROM range(10) JOIN x ON r = 7 - range % 7")
def seasonal_naive(spark, sf):
    return rounded(series.SeasonalNaiveForecaster(7).fit(daily(spark, sf), "d", "y").predict(10), "forecast", digits=4)


@query(f"SELECT (range + 1)::INT AS h, round((SELECT avg(y) FROM (SELECT y FROM ({DAILY}) ORDER BY d DESC LIMIT 7)), 4) AS forecast FROM range(3)")
def moving_average(spark, sf):
    return rounded(series.MovingAverageForecaster(7).fit(daily(spark, sf), "d", "y").predict(3), "forecast", digits=4)


@query(f"WITH x AS (SELECT y, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM ({DAILY})) SELECT round(sum(y * power(0.7, n - 1 - i) * CASE WHEN i = 0 THEN 1 ELSE 0.3 END), 4) AS level FROM x")
def exponential_smoothing(spark, sf):
    return rounded(series.exponential_level(daily(spark, sf), "d", "y", 0.3), "level", digits=4)


@query(f"WITH x AS (SELECT d, y, row_number() OVER (ORDER BY d) - 1 AS i FROM ({DAILY})), w AS (SELECT d, y, i, sum(y) OVER (ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS trend FROM x), s AS (SELECT i % 7 AS k, avg(y - trend) AS seasonal FROM w GROUP BY 1) SELECT d AS t, round(y, 4) AS y, round(trend, 4) AS trend, round(seasonal, 4) AS seasonal, round(y - trend - seasonal, 3) AS resid FROM w JOIN s ON i % 7 = k")
def decompose(spark, sf):
    return rounded(rounded(series.seasonal_decompose(daily(spark, sf), "d", "y", 7), "y", "trend", "seasonal", digits=4), "resid", digits=3)


@query(f"WITH x AS (SELECT y, row_number() OVER (ORDER BY d) - 1 AS i FROM ({DAILY})) SELECT a.i AS pos, round(a.y, 4) AS y, round(b.y, 4) AS lag1, round(c.y, 4) AS lag2 FROM x a JOIN x b ON b.i = a.i - 1 JOIN x c ON c.i = a.i - 2")
def lag_matrix(spark, sf):
    return rounded(series.lagged(daily(spark, sf), "d", "y", 2), "y", "lag1", "lag2", digits=4)


@query("SELECT round(avg(abs(y - p)), 6) AS mae, round(100 * avg(2 * abs(p - y) / (abs(y) + abs(p) + 1e-9)), 6) AS smape FROM (SELECT l_quantity AS y, l_linenumber * 7.0 AS p FROM lineitem)")
def forecast_errors(spark, sf):
    x = t(spark, sf, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_linenumber") * 7.0).alias("p"))
    return rounded(series.errors_df(x, "y", "p"), "mae", "smape")


# --- text -------------------------------------------------------------------------------

_marks = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{06D6}-\x{06DC}\x{06DF}-\x{06E8}\x{06EA}-\x{06ED}\x{0640}]"


def clean_sql(c: str) -> str:
    out = f"translate(regexp_replace(lower(coalesce({c}, '')), '{_marks}', '', 'g'), 'أإآةىؤئ', 'اااهيوي')"
    for p in (r"https?://[^\s]+|www\.[^\s]+", r"[@#][\p{L}\p{N}_]+", "[0-9٠-٩]+", r"[^\p{L}\p{N}_\s\x{0600}-\x{06FF}]", r"\s+"):
        out = f"regexp_replace({out}, '{p}', ' ', 'g')"
    return f"trim({out})"


@query(f"SELECT doc_id, md5({clean_sql('text')}) AS digest FROM documents")
def clean_text_query(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(clean_text(F.col("text"))).alias("digest"))


TERMS = f"SELECT doc_id, unnest(list_filter(string_split({clean_sql('text')}, ' '), lambda x: x <> '')) AS term FROM documents"


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM ({TERMS}) GROUP BY term ORDER BY df DESC, term LIMIT 500")
def doc_freq_vocab(spark, sf):
    return words.CountVectorizer(500).document_frequencies(t(spark, sf, "documents"), "doc_id", "text")


@query(f"WITH c AS (SELECT doc_id, term, count(*) AS tf FROM ({TERMS}) GROUP BY 1, 2), v AS (SELECT term, count(*) AS df FROM c GROUP BY term ORDER BY df DESC, term LIMIT 100), w AS (SELECT doc_id, c.term, ln(1 + tf) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS x FROM c JOIN v ON c.term = v.term) SELECT doc_id AS id, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 6) AS value FROM w")
def tfidf(spark, sf):
    d = t(spark, sf, "documents")
    return rounded(words.TfidfVectorizer(100).fit(d, "doc_id", "text").transform(d).drop("index"), "value")


@query(f"WITH x AS (SELECT conv_id, turn, list_filter(string_split({clean_sql('text')}, ' '), lambda w: w <> '') AS w FROM conversations) SELECT conv_id, turn, (len(w) + greatest(len(w) - 1, 0))::INT AS n, w[1] || ' ' || w[2] AS first_pair FROM x")
def ngram_query(spark, sf):
    x = t(spark, sf, "conversations").select("conv_id", "turn", tokens(F.col("text")).alias("w"))
    g = ngrams(F.col("w"), 1, 2)
    return x.select("conv_id", "turn", F.size(g).alias("n"), F.get(g, F.size("w")).alias("first_pair"))


ARABIC = ["أإآ السلام عليكم", "مُحَمَّد", "مدرسة على", "شـــكرا"]


@query("WITH v AS (SELECT c_custkey, [" + ", ".join(f"'{x}'" for x in ARABIC) + "][c_custkey % 4 + 1] || ' ' || c_name AS x FROM customer) SELECT c_custkey, translate(regexp_replace(x, '" + _marks + "', '', 'g'), 'أإآةىؤئ', 'اااهيوي') AS norm FROM v")
def normalize_arabic_query(spark, sf):
    words_ = F.array(*[F.lit(x) for x in ARABIC])
    rows = t(spark, sf, "customer").select("c_custkey", F.concat(F.get(words_, (F.col("c_custkey") % 4).cast("int")), F.lit(" "), "c_name").alias("raw"))
    return rows.select("c_custkey", normalize_arabic(F.col("raw")).alias("norm"))


# --- models whose parts SQL can follow ------------------------------------------------------


@query(f"WITH d AS (SELECT a.vec_id AS q, b.label AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY {DIST}, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0), v AS (SELECT q, y, count(*) AS n FROM d WHERE r <= 5 GROUP BY q, y) SELECT q AS vec_id, arg_min(y, (-n, y)) AS prediction FROM v GROUP BY q")
def knn_classify(spark, sf):
    e = t(spark, sf, "embeddings")
    m = neighbors.KNeighborsClassifier(5).fit(e, "embedding", "label", "vec_id")
    return m.predict(e.where("vec_id % 100 = 0")).select("vec_id", "prediction")


@query(f"SELECT a.vec_id AS id, b.vec_id AS other, round({DIST}, 5) AS distance FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND {DIST} <= 1.1")
def radius_neighbors(spark, sf):
    m = neighbors.NearestNeighbors(radius=1.1).fit(t(spark, sf, "embeddings"), "embedding", "vec_id")
    return rounded(m.radius_neighbors(), "distance", digits=5)


@query("WITH x AS (SELECT label, unnest(range(0, 64))::INT AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, i, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM x GROUP BY label, i")
def gaussian_nb_stats(spark, sf):
    return rounded(bayes.gaussian_stats(t(spark, sf, "embeddings"), "embedding", "label"), "mean", "var")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem")
def ols_1d(spark, sf):
    m = linear.LinearRegression().fit(t(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(float(m.coef_[0]), 4), round(m.intercept_, 3))], "slope double, intercept double")


@query("WITH m AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem) SELECT round(sum((l_quantity - mx) * (l_extendedprice - my)) / (sum((l_quantity - mx) * (l_quantity - mx)) + 1000), 4) AS slope FROM lineitem, m")
def ridge_1d(spark, sf):
    m = linear.Ridge(1000.0).fit(t(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.createDataFrame([(round(float(m.coef_[0]), 4),)], "slope double")


FIXED = [[5.0, 1.0], [25.0, 4.0], [45.0, 6.0]]


@query("WITH d AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"power(l_quantity - {a}, 2) + power(l_linenumber - {b}, 2) AS d{i}" for i, (a, b) in enumerate(FIXED)) + " FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM d")
def kmeans_assign_fixed(spark, sf):
    return cluster.assign(t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_quantity", "l_linenumber"], FIXED).drop("l_quantity")


@query("WITH RECURSIVE n AS (SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a, supplier b WHERE abs(a.s_acctbal - b.s_acctbal) <= 60), c AS (SELECT a FROM n GROUP BY a HAVING count(*) >= 3), e AS (SELECT n.a, n.b FROM n JOIN c x ON n.a = x.a JOIN c y ON n.b = y.a), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), root AS (SELECT a, min(b) AS m FROM r GROUP BY a), k AS (SELECT a, dense_rank() OVER (ORDER BY m) - 1 AS k FROM root), z AS (SELECT n.a, min(k) AS k FROM n JOIN k ON n.b = k.a WHERE n.a NOT IN (SELECT a FROM c) GROUP BY n.a) SELECT s_suppkey, coalesce(k.k, z.k, -1)::INT AS cluster FROM supplier LEFT JOIN k ON s_suppkey = k.a LEFT JOIN z ON s_suppkey = z.a")
def dbscan_small(spark, sf):
    s = t(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return cluster.DBSCAN(60.0, 3).fit_predict(s, ["s_acctbal"], "s_suppkey").drop("s_acctbal")


@query("SELECT o_orderkey, CASE WHEN (o_orderkey % 2) + (o_orderkey % 3 > 0)::INT + (o_orderkey % 5 > 1)::INT >= 2 THEN 1 ELSE 0 END AS vote FROM orders")
def voting_combine(spark, sf):
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").select("o_orderkey", (k % 2).cast("int").alias("a"), (k % 3 > 0).cast("int").alias("b"), (k % 5 > 1).cast("int").alias("c"))
    return o.select("o_orderkey", trees.vote(["a", "b", "c"], [0, 1]).alias("vote"))


@query("WITH e AS (SELECT l_extendedprice - l_quantity * 1000 AS e FROM lineitem), r AS (SELECT min(e) AS lo, max(e) AS hi FROM e) SELECT least(floor((e - lo) / ((hi - lo) / 30)), 29)::INT AS bin, count(*) AS n FROM e, r GROUP BY 1")
def residual_histogram(spark, sf):
    x = t(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))
    return automl.residual_histogram(x, "y", "p").select("bin", "n")


# --- rows only: fitted models, streams ------------------------------------------------------


@query()
def rf_predictions(spark, sf):
    x = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    m = trees.RandomForestClassifier(10, 6).fit(x, ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag")
    return m.predict(x).select("l_orderkey", "l_linenumber", "prediction")


@query()
def kmeans_clusters(spark, sf):
    e = t(spark, sf, "embeddings")
    return cluster.KMeans(10, n_init=1).fit(e, "embedding").predict(e).select("vec_id", "cluster")


@query()
def pca_projection(spark, sf):
    from .operators.decompose import PCA

    e = t(spark, sf, "embeddings")
    return PCA(4).fit(e, "embedding").transform(e).select("vec_id", "components")


@query()
def logistic_probabilities(spark, sf):
    x = t(spark, sf, "orders").withColumn("y", (F.col("o_orderstatus") == "O").cast("int"))
    return linear.LogisticRegression().fit(x.withColumn("z", F.col("o_totalprice") / 1e5), ["z"], "y").predict_proba(x.withColumn("z", F.col("o_totalprice") / 1e5)).select("o_orderkey", "probability")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    out = stream.windowed(t(spark, sf, "events"), size="6 hours", by=["event_type"])
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), "total", digits=4)


@query("WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM x) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf):
    s = stream.sessions(t(spark, sf, "events"))
    return s.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})
