"""What a table holds: missing values, summaries, correlations, outliers, counts."""

from __future__ import annotations

import html
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_missing, numeric_columns, value
from .quantiles import quantiles


def unpivot(row: DataFrame, names: list[str], stats: list[str]) -> DataFrame:
    """One row of columns ``stat|name`` into a row for each name."""
    items = F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{s}|{c}`").alias(s) for s in stats]) for c in names])
    return row.select(F.explode(items).alias("i")).select("i.*")


def missing_report(df: DataFrame) -> DataFrame:
    """column, n_missing, pct; worst first. One pass over all columns."""
    aggs = [F.coalesce(F.sum(is_missing(df, c).cast("long")), F.lit(0)).alias(f"n_missing|{c}") for c in df.columns]
    one = df.agg(F.count("*").alias("n"), *aggs)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`n_missing|{c}`").alias("n_missing"), F.lit(i).alias("i")) for i, c in enumerate(df.columns)])
    rows = one.select("n", F.explode(items).alias("x")).select("x.*", F.round(100 * F.col("x.n_missing") / F.greatest("n", F.lit(1)), 2).alias("pct"))
    return rows.orderBy(F.desc("pct"), "i").select("column", "n_missing", "pct")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, count, mean, std (sample), min, max, median (exact) of what is not missing."""
    names = columns or numeric_columns(df)
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    aggs = [(f(value(df, c)) if s == "count" else f(value(df, c)).cast("double")).alias(f"{s}|{c}") for c in names for s, f in stats.items()]
    medians = quantiles(df, {c: value(df, c) for c in names}, [0.5])
    one = df.agg(*aggs).withColumns({f"median|{c}": F.lit(medians[c] and medians[c][0]).cast("double") for c in names})
    return unpivot(one, names, [*stats, "median"])


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """a, b, corr of each pair of columns, over rows where both are known; null where a column doesn't vary."""
    names = columns or numeric_columns(df)
    if method == "spearman":
        return _spearman(df, names)
    if method == "kendall":
        return _kendall(df, names)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    aggs = []
    for a, b in pairs:
        x, y = value(df, a).cast("double"), value(df, b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        x, y = F.when(both, x), F.when(both, y)
        aggs.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"corr|{a}|{b}"))
    one = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"`corr|{a}|{b}`").alias("corr")) for a, b in pairs for p, q in ({(a, b), (b, a)})])
    return one.select(F.explode(items).alias("i")).select("i.*")


def ranks(df: DataFrame, c: str) -> DataFrame:
    """Mean rank of each distinct value of a column: counts by value first, so ties cost nothing."""
    from .split import running_count

    counts = df.where(~is_missing(df, c)).groupBy(value(df, c).alias("v")).agg(F.count("*").alias("n"))
    return running_count(counts, "v", "n").select("v", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def _spearman(df: DataFrame, names: list[str]) -> DataFrame:
    parts = []
    for i, a in enumerate(names):
        for b in names[i:]:
            both = df.where(~is_missing(df, a) & ~is_missing(df, b)).select(value(df, a).alias("x"), value(df, b).alias("y"))
            rx, ry = ranks(both, "x").withColumnRenamed("rank", "rx"), ranks(both, "y").withColumnRenamed("rank", "ry")
            cells = both.groupBy("x", "y").agg(F.count("*").alias("w")).join(rx.withColumnRenamed("v", "x").select("x", "rx"), "x").join(ry.withColumnRenamed("v", "y").select("y", "ry"), "y")
            w = lambda e: F.sum(F.col("w") * e) / F.sum("w")
            x, y = F.col("rx"), F.col("ry")
            r = cells.agg(F.try_divide(w(x * y) - w(x) * w(y), F.sqrt((w(x * x) - w(x) * w(x)) * (w(y * y) - w(y) * w(y)))).alias("corr"))
            parts += [r.select(F.lit(p).alias("a"), F.lit(q).alias("b"), "corr") for p, q in {(a, b), (b, a)}]
    return reduce(DataFrame.union, parts)


def _kendall(df: DataFrame, names: list[str]) -> DataFrame:
    """Tau-b over cells of the contingency table: pairs of distinct values, not of rows."""
    parts = []
    for i, a in enumerate(names):
        for b in names[i:]:
            cells = df.where(~is_missing(df, a) & ~is_missing(df, b)).groupBy(value(df, a).alias("x"), value(df, b).alias("y")).agg(F.count("*").alias("w"))
            l, r = cells.alias("l"), cells.alias("r")
            s = l.join(r, F.col("l.x") < F.col("r.x")).agg(F.sum(F.col("l.w") * F.col("r.w") * F.signum((F.col("r.y") - F.col("l.y")).cast("double"))).alias("s"))
            pairs = lambda g: cells.groupBy(g).agg(F.sum("w").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias(g))
            n = cells.agg((F.sum("w") * (F.sum("w") - 1) / 2).alias("n0"))
            tau = s.crossJoin(pairs("x")).crossJoin(pairs("y")).crossJoin(n).select(F.try_divide(F.coalesce("s", F.lit(0.0)), F.sqrt((F.col("n0") - F.col("x")) * (F.col("n0") - F.col("y")))).alias("corr"))
            parts += [tau.select(F.lit(p).alias("a"), F.lit(q).alias("b"), "corr") for p, q in {(a, b), (b, a)}]
    return reduce(DataFrame.union, parts)


def outlier_report(df: DataFrame, columns: list[str] | None = None, method: str = "iqr", thresh: float = 1.5) -> DataFrame:
    """column, n_outliers. Bounds are one row of one pass, then counted in another."""
    names = columns or numeric_columns(df)
    if method == "zscore":
        bounds = df.agg(*[f(value(df, c).cast("double")).alias(f"{s}|{c}") for c in names for s, f in (("m", F.avg), ("d", F.stddev_pop))])
        out = {c: F.abs((value(df, c) - F.col(f"`m|{c}`")) / F.when(F.col(f"`d|{c}`") == 0, 1.0).otherwise(F.col(f"`d|{c}`"))) > thresh for c in names}
    else:
        found = quantiles(df, {c: value(df, c) for c in names}, [0.25, 0.75])
        q = lambda c, i: F.lit(found[c] and found[c][i]).cast("double")
        span = lambda c: thresh * (q(c, 1) - q(c, 0))
        out = {c: (value(df, c) < q(c, 0) - span(c)) | (value(df, c) > q(c, 1) + span(c)) for c in names}
    both = df.select(*[F.col(f"`{c}`") for c in names])
    if method == "zscore":
        both = both.crossJoin(F.broadcast(bounds))  # one row
    return unpivot(both.agg(*[F.coalesce(F.sum(F.coalesce(x, F.lit(False)).cast("long")), F.lit(0)).alias(f"n_outliers|{c}") for c, x in out.items()]), names, ["n_outliers"])


def value_counts(df: DataFrame, column: str, top: int | None = 10) -> DataFrame:
    """Most frequent values that aren't missing; ties by value."""
    out = df.where(~is_missing(df, column)).groupBy(F.col(f"`{column}`").alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")
    return out.limit(top) if top else out


def duplicate_count(df: DataFrame) -> DataFrame:
    """n_rows, n_duplicates: rows that equal an earlier one."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def profile(df: DataFrame, html_path: str | None = None) -> dict:
    """All of the above, small enough for the driver; optionally as HTML."""
    dup = duplicate_count(df).first()
    rep = {
        "n_rows": dup["n_rows"],
        "n_cols": len(df.columns),
        "dtypes": dict(df.dtypes),
        "duplicates": dup["n_duplicates"],
        "memory_bytes": int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())),
        "missing": [r.asDict() for r in missing_report(df).collect()],
        "numeric": [r.asDict() for r in describe(df).collect()] if numeric_columns(df) else [],
        "outliers": [r.asDict() for r in outlier_report(df).collect()] if numeric_columns(df) else [],
    }
    if html_path:
        with open(html_path, "w", encoding="utf-8") as f:
            f.write(to_html(rep))
    return rep


def to_html(rep: dict) -> str:
    def table(rows: list[dict]) -> str:
        if not rows:
            return "<p>none</p>"
        cell = lambda tag, x: f"<{tag}>{html.escape(f'{x:.6g}' if isinstance(x, float) else str(x))}</{tag}>"
        head = "".join(cell("th", k) for k in rows[0])
        return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(cell("td", v) for v in r.values()) + "</tr>" for r in rows) + "</table>"

    return f"<!doctype html><meta charset=utf-8><title>Profile</title><h1>{rep['n_rows']} rows, {rep['n_cols']} columns, {rep['duplicates']} duplicates</h1>" + "".join(f"<h2>{k.capitalize()}</h2>{table(rep[k])}" for k in ("missing", "numeric", "outliers"))
