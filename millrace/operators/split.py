"""Positions, splits and folds. Order is data: every operator names the columns that give it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Sampled keys for each stretch of the order; rows from which on there are several stretches.
SAMPLED, SPLIT_FROM = 60, 20_000


def _stretches(df: DataFrame, keys: list[str]) -> tuple[int, list]:
    """(how many stretches of the order there are, the least keys of all but the first), from a bounded sample."""
    n, parts = df.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if n < SPLIT_FROM or parts < 2:
        return 1, []
    share = min(1.0, 2.0 * SAMPLED * parts / n)
    found = df.select(F.struct(*[F.col(f"`{k}`") for k in keys]).alias("k")).sample(share, 11).orderBy("k").collect()
    cuts = [found[len(found) * i // parts]["k"] for i in range(1, parts)] if found else []
    return len(cuts) + 1, [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]


def running_count(df: DataFrame, order: str | Sequence[str], n: str | None = None) -> DataFrame:
    """Add ``before``: the rows (or the sum of ``n``) before a row in the order.

    The order is cut into stretches at fixed keys, sampled once, so all steps see the same
    ones. Rows are sorted in their stretches; sums of stretches, one row each, give each its
    start. No window holds the whole table, and rows move once.
    """
    keys = [order] if isinstance(order, str) else list(order)
    size = F.col(n) if n else F.lit(1)
    _, cuts = _stretches(df, keys)
    key = F.struct(*[F.col(f"`{k}`") for k in keys])
    if cuts:
        spark, kind = df.sparkSession, df.select(key.alias("k")).schema["k"].dataType
        held = spark.createDataFrame([(cuts,)], T.StructType([T.StructField("cuts_", T.ArrayType(kind))]))
        steps = F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
        part = F.aggregate(steps, F.lit(0), lambda lo, s: F.when(lo + s <= len(cuts), F.when(F.get("cuts_", lo + s - 1) <= key, lo + s).otherwise(lo)).otherwise(lo))
        marked = df.crossJoin(F.broadcast(held)).withColumn("part_", part).drop("cuts_")  # one row
    else:
        marked = df.withColumn("part_", F.lit(0))
    w = Window.partitionBy("part_").orderBy(*keys, F.monotonically_increasing_id()).rowsBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumn("in_", F.sum(size).over(w))
    sums = marked.groupBy("part_").agg(F.sum(size).alias("n_"))
    starts = sums.withColumn("start_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part_", "start_")
    return inside.join(F.broadcast(starts), "part_").withColumn("before", F.col("start_") + F.coalesce("in_", F.lit(0))).drop("part_", "in_", "start_")


def positions(df: DataFrame, order_by: str | Sequence[str], name: str = "pos") -> DataFrame:
    return running_count(df, order_by).withColumnRenamed("before", name)


def shuffle_key(seed: int, *keys: str) -> Column:
    """A pseudo-random order that depends on the row's keys and the seed alone."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{k}`") for k in keys])


def shuffle(df: DataFrame, keys: Sequence[str], seed: int = 0) -> DataFrame:
    return df.orderBy(shuffle_key(seed, *keys), *keys)


def take_rows(df: DataFrame, index: DataFrame, order_by: str | Sequence[str]) -> DataFrame:
    """Rows at the positions in ``index.pos``."""
    return positions(df, order_by).join(index.select("pos"), "pos", "left_semi").drop("pos")


def sizes(n: int, test_size: float | int | None = 0.25, train_size: float | int | None = None) -> tuple[int, int]:
    """(train, test) rows of n; fractions are rounded down."""
    count = lambda x: int(n * x) if isinstance(x, float) else int(x)
    test = n - count(train_size) if test_size is None and train_size is not None else count(0.25 if test_size is None else test_size)
    return (count(train_size) if train_size is not None else n - test), test


def train_test_split(df: DataFrame, *, order_by: Sequence[str], test_size: float | int | None = 0.25, train_size: float | int | None = None, shuffle: bool = False, seed: int = 0, stratify: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The last rows in the order (by a hash of the keys, if shuffled) are the test; exact sizes, by class if stratified."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    out = with_test_flag(df, order_by=keys, test_size=test_size, train_size=train_size, shuffle=shuffle, seed=seed, stratify=stratify)
    return out.where("not is_test").drop("is_test"), out.where("is_test").drop("is_test")


def with_test_flag(df: DataFrame, *, order_by: Sequence[str], test_size: float | int | None = 0.25, train_size: float | int | None = None, shuffle: bool = False, seed: int = 0, stratify: str | None = None) -> DataFrame:
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if shuffle:
        df, keys, base = df.withColumn("key_", shuffle_key(seed, *keys)), ["key_", *keys], keys
    if stratify:
        found = df.groupBy(F.col(f"`{stratify}`").alias("s_")).agg(F.count("*").alias("n_")).collect()  # one row for each class
        total = sum(r["n_"] for r in found) or 1
        share = sizes(total, test_size, train_size)[1] / total if not isinstance(test_size, float) else test_size
        w = Window.partitionBy(F.col(f"`{stratify}`")).orderBy(*keys)
        need = {r["s_"]: max(0, min(int(r["n_"] * share + 1e-9), r["n_"] - 1)) for r in found}
        plan = F.broadcast(df.sparkSession.createDataFrame([(r["s_"], r["n_"] - need[r["s_"]]) for r in found], f"s_ {dict(df.dtypes)[stratify]}, from_ long"))
        out = df.withColumn("rn_", F.row_number().over(w)).join(plan, F.col(f"`{stratify}`").eqNullSafe(F.col("s_"))).withColumn("is_test", F.col("rn_") > F.col("from_")).drop("rn_", "s_", "from_")
    else:
        n = df.count()
        train, test = sizes(n, test_size, train_size)
        out = positions(df, keys, "pos_").withColumn("is_test", F.col("pos_") >= n - test)
        out = out.where(F.col("is_test") | (F.col("pos_") < train)).drop("pos_")
    return out.drop("key_") if shuffle else out


class KFold:
    """Contiguous folds; the first n % k hold one row more."""

    def __init__(self, n_splits: int = 5, shuffle: bool = False, seed: int = 0) -> None:
        self.n_splits, self.shuffle, self.seed = n_splits, shuffle, seed

    def folds(self, df: DataFrame, order_by: Sequence[str], label: str | None = None, name: str = "fold") -> DataFrame:
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        n = df.count()
        if self.shuffle:
            df, keys = df.withColumn("key_", shuffle_key(self.seed, *keys)), ["key_", *keys]
        base, more = divmod(n, self.n_splits)
        p = F.col("pos_")
        edge = more * (base + 1)
        fold = F.when(p < edge, F.floor(p / (base + 1))).otherwise(more + F.floor((p - edge) / max(base, 1)))
        return positions(df, keys, "pos_").withColumn(name, fold.cast("int")).drop("pos_", "key_")

    def split(self, df: DataFrame, order_by: Sequence[str], label: str | None = None) -> Iterator[tuple[DataFrame, DataFrame]]:
        """(train, test) by fold."""
        marked = self.folds(df, order_by, label, "fold_")
        for k in range(self.n_splits):
            yield marked.where(F.col("fold_") != k).drop("fold_"), marked.where(F.col("fold_") == k).drop("fold_")


class StratifiedKFold(KFold):
    """Rows of each class are dealt to the folds in turn."""

    def folds(self, df: DataFrame, order_by: Sequence[str], label: str | None = None, name: str = "fold") -> DataFrame:
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        order = [shuffle_key(self.seed, *keys), *keys] if self.shuffle else keys
        rn = F.row_number().over(Window.partitionBy(F.col(f"`{label}`")).orderBy(*order))
        return df.withColumn(name, ((rn - 1) % self.n_splits).cast("int"))


class ShuffleSplit:
    """Independent permutations; the first rows of each are the test."""

    def __init__(self, n_splits: int = 5, test_size: float | int = 0.2, seed: int = 0) -> None:
        self.n_splits, self.test_size, self.seed = n_splits, test_size, seed

    def split(self, df: DataFrame, order_by: Sequence[str], label: str | None = None) -> Iterator[tuple[DataFrame, DataFrame]]:
        keys = [order_by] if isinstance(order_by, str) else list(order_by)
        test = sizes(df.count(), self.test_size)[1]
        for k in range(self.n_splits):
            p = positions(df.withColumn("key_", shuffle_key(self.seed * 1009 + k, *keys)), ["key_", *keys], "pos_").drop("key_")
            yield p.where(F.col("pos_") >= test).drop("pos_"), p.where(F.col("pos_") < test).drop("pos_")


class LeaveOneOut:
    """As many fits as rows: refuses more than ``max_rows``."""

    def __init__(self, max_rows: int = 1000) -> None:
        self.max_rows = max_rows

    def split(self, df: DataFrame, order_by: Sequence[str], label: str | None = None) -> Iterator[tuple[DataFrame, DataFrame]]:
        n = df.count()
        if n > self.max_rows:
            raise ValueError(f"{n} fits; raise max_rows to allow that")
        yield from KFold(n).split(df, order_by)


def check_cv(cv, classifier: bool = False):
    if cv is None:
        cv = 5
    return (StratifiedKFold if classifier else KFold)(cv) if isinstance(cv, int) else cv
