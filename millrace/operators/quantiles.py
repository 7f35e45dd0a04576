"""Exact quantiles and modes without a task that holds a column.

A mergeable sketch brackets each wanted order statistic; a second pass counts what lies
below the bracket and, by value, what lies in it (a few ten-thousandths of the rows, or a
few values that many rows share). Brackets with too many different values are narrowed by
another sketch. The driver sees counts and at most ``HELD`` values of brackets.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of the sketch; different values in brackets that the driver may hold.
ACCURACY, HELD = 10_000, 200_000
#: Values from which on a bracket of the sketch's accuracy holds both neighbours of a quantile.
WHOLE = 100_000


def quantiles(df: DataFrame, columns: Mapping[str, Column], at: Sequence[float]) -> dict[str, list[float] | None]:
    """The quantiles ``at`` (0 to 1, linear between neighbours) of each column, nulls ignored; None for a column without values."""
    wide = 3 / ACCURACY
    edges = [min(1.0, max(0.0, q + s * wide)) for q in at for s in (-1, 1)]
    names = list(columns)
    if not names:
        return {}
    one = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(columns.values())], *[F.percentile_approx(x.cast("double"), edges, ACCURACY).alias(f"e{i}") for i, x in enumerate(columns.values())]).first()
    x = {i: columns[c].cast("double") for i, c in enumerate(names)}
    #: (column, quantile) -> bracket and the wanted positions
    open_ = {(i, k): (one[f"e{i}"][2 * k], one[f"e{i}"][2 * k + 1]) if one[f"n{i}"] >= WHOLE else (-math.inf, math.inf) for i in x if one[f"n{i}"] for k in range(len(at))}
    spot = {(i, k): q * (one[f"n{i}"] - 1) for i in x if one[f"n{i}"] for k, q in enumerate(at)}
    found: dict[tuple[int, int], float] = {}
    while open_:
        keys = list(open_)
        inside = lambda key: (x[key[0]] >= open_[key][0]) & (x[key[0]] <= open_[key][1])
        items = [F.struct(F.lit(j).alias("j"), (x[key[0]] < open_[key][0]).alias("below"), F.when(inside(key), x[key[0]]).alias("v")) for j, key in enumerate(keys)]
        some = df.select(F.explode(F.array(*items)).alias("i")).select("i.*").where("below or v is not null")
        held = some.groupBy("j", "below", "v").agg(F.count("*").alias("n")).limit(HELD * len(keys) + 1).collect()
        if len(held) > HELD * len(keys):
            open_ = _narrowed(df, x, open_, spot)
            continue
        for j, key in enumerate(keys):
            below = sum(r["n"] for r in held if r["j"] == j and r["below"])
            line = sorted((r["v"], r["n"]) for r in held if r["j"] == j and not r["below"])
            assert 0 <= math.floor(spot[key]) - below <= math.ceil(spot[key]) - below < sum(n for _, n in line), "the sketch missed its accuracy"
            lo, share = math.floor(spot[key]), spot[key] - math.floor(spot[key])
            a, b = _nth(line, lo - below), _nth(line, math.ceil(spot[key]) - below)
            found[key] = a if share == 0 or a == b else a + share * (b - a)
        break
    return {c: [found[i, k] for k in range(len(at))] if one[f"n{i}"] else None for i, c in enumerate(names)}


def _nth(line: list[tuple[float, int]], n: int) -> float:
    for v, count in line:
        n -= count
        if n < 0:
            return v
    return line[-1][0]


def _narrowed(df: DataFrame, x: Mapping[int, Column], open_: dict, spot: dict) -> dict:
    """Brackets within brackets, from sketches of what lies in them."""
    keys = list(open_)
    aggs = []
    for j, (i, k) in enumerate(keys):
        lo, hi = open_[i, k]
        aggs += [F.count(F.when(x[i] < lo, 1)).alias(f"b{j}"), F.count(F.when((x[i] >= lo) & (x[i] <= hi), 1)).alias(f"m{j}")]
    counts = df.agg(*aggs).first()
    aggs = []
    for j, (i, k) in enumerate(keys):
        lo, hi = open_[i, k]
        ends = [math.floor(spot[i, k]) - counts[f"b{j}"], math.ceil(spot[i, k]) - counts[f"b{j}"]]
        share = [min(1.0, max(0.0, ends[0] / max(1, counts[f"m{j}"]) - 3 / ACCURACY)), min(1.0, max(0.0, (ends[1] + 1) / max(1, counts[f"m{j}"]) + 3 / ACCURACY))]
        aggs.append(F.percentile_approx(F.when((x[i] >= lo) & (x[i] <= hi), x[i]), share, ACCURACY).alias(f"e{j}"))
    row = df.agg(*aggs).first()
    return {key: tuple(row[f"e{j}"]) for j, key in enumerate(keys)}


def mode(df: DataFrame, c: Column):
    """The most frequent value, nulls ignored, the least of several; None without any."""
    row = df.select(c.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "v").first()
    return row and row["v"]
