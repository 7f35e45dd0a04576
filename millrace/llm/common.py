"""Shared folder, tables that cut lineage, and small helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts of a table that a key may hold before its rows are spread: keys with more than 1/HEAVY of the rows, so at most HEAVY of them.
HEAVY = 1000
#: Rows of a key that no task minds.
FEW = 250


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master may do without: there it is a folder of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="millrace-"))
    return sc.getCheckpointDir().rstrip("/")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing else uses; what is there goes when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    fs.mkdirs(at.getParent())
    fs.deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    return Scratch(df.sparkSession).stored(df, name)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that only intermediate steps have read."""
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


class Scratch:
    """Tables of one operator's call; ``drop`` deletes them once what is left of them is stored elsewhere."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def remove(self, table: DataFrame) -> None:
        remove(self.spark, self.paths.pop(id(table))[1])

    def drop(self, *keep: DataFrame) -> None:
        for key, (_, path) in list(self.paths.items()):
            if all(key != id(k) for k in keep):
                remove(self.spark, path)
                del self.paths[key]


def spread_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, total: int, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key and in ``rows`` how many rows of ``left`` have it.

    Keys with more than 1/HEAVY of the ``total`` rows (and FEW at least) are at most HEAVY: their
    rows stay where they are and meet a broadcast of so many rows. All others are shuffled; none
    of them is hot. Keys are told by hash, on both sides alike. ``how`` is inner or left; null
    keys join nothing.
    """
    most = max(total // HEAVY, FEW)
    out = right.drop(rows)
    if total <= most:
        return left.join(out, on, how)
    mark = F.xxhash64(*on)
    found = right.where(F.col(rows) > most).select(mark, rows).collect()  # at most HEAVY
    if not found:
        return left.join(out, on, how)
    is_heavy = mark.isin([r[0] for r in found])
    if how == "inner" and sum(r[1] for r in found) == total:
        return left.join(F.broadcast(out.where(is_heavy)), on)
    hot = left.where(is_heavy).join(F.broadcast(out.where(is_heavy)), on, how)
    return hot.unionByName(left.where(~is_heavy).join(out.where(~is_heavy), on, how))


def maybe_among(keys: DataFrame, work: Scratch) -> Callable[[Column], Column]:
    """Whether a hash (long) may be one of ``keys`` (h): true for all of them and about a hundredth of the others.

    Spark's Bloom filter, ten bits for each key (8 MB at most: beyond, more others are true). What it rules out need not be shuffled to be told apart.
    """
    spark, n = keys.sparkSession, keys.count()
    if not n:
        return lambda h: F.lit(False)
    found, raw = keys._jdf.stat().bloomFilter("h", n, 0.01), spark._jvm.java.io.ByteArrayOutputStream()
    found.writeTo(raw)
    bits = work.stored(spark.createDataFrame([(bytearray(raw.toByteArray()),)], "bits binary"), "bits")

    def test(h: Column) -> Column:
        to = spark._jvm.org.apache.spark.sql.classic.ExpressionUtils
        return Column(to.column(spark._jvm.org.apache.spark.sql.catalyst.expressions.BloomFilterMightContain(to.expression(bits.scalar()._jc), to.expression(h._jc))))

    return test


def own_columns(df: DataFrame, *names: str, prefix: str = "x_") -> DataFrame:
    """The named columns and no others, so that further columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`").alias(n) for n in names])


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores added until the frame has no such column."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def running_totals(lengths: Column, block: int = 256) -> Column:
    """For each element of an array of numbers, the sum of those before it; work is length x block, not its square."""
    starts = F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    part = lambda b: F.slice(lengths, b * block + 1, F.lit(block))
    sums = F.transform(starts, lambda b: add(part(b)))

    def inside(b: Column) -> Column:
        base = add(F.slice(sums, F.lit(1), b))
        return F.transform(part(b), lambda x, i: base + add(F.slice(part(b), F.lit(1), i)))

    return F.flatten(F.transform(starts, inside))
