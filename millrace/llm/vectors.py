"""Near duplicates among vectors: rotated binary codes, Hamming tables, then the vectors themselves.

1. Rotation. On a bounded sample of unit vectors (the first in the order of a hash of
   the id) iterative quantisation alternates codes sign(V R) and the orthogonal R that
   brings V R nearest to them. Several starts give several rotations, so that more bits
   than dimensions are at hand. A bit is set from the median of its projections on, so
   codes are balanced; where the sample shows that pairs at the threshold then differ in
   more bits (vectors that lie close around their mean), it is set from 0 on.
2. Tables. The code of every vector is cut into substrings; vectors that agree in one
   substring meet in that table. Its width grows with the logarithm of the number of
   different vectors, so a bucket stays at some hundreds; the number of tables follows
   from the width and the share of bits in which pairs at the threshold agree, measured
   on the sample: enough that such a pair meets in one with the wanted probability.
   Tables hold ids and codes, no vectors. Members of a bucket are compared by the Hamming
   distance of their whole codes, in tiles of bounded size, so a bucket of any size is a
   number of tasks; only members with a partner within the radius go on.
3. Rerank. They bring their vectors and are compared by cosine in double precision, in
   the same tiles. A pair counts in the first table where it meets, in no other; codes
   are carried, so all steps see the same ones. A tile returns numbers of links and the
   roots of its components, never its pairs.

Equal vectors are one class that counts with its size; they are links of one another.
Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing, nor do vectors of different lengths. Rows without an id are dropped: the result
has ids as keys. Rows that repeat an id with the same vector count as copies of it; with
another vector they are vectors of their own, and each row gets its own links. An empty
table gives no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join
from .graph import components

#: Most vectors that rotations are fitted on.
SAMPLE = 20_000
#: Wanted chance that a pair at the threshold meets; vectors that a bucket should hold; rows of a tile's side.
REACH, BUCKET, TILE = 0.9995, 512, 1024
#: Agreement of bits that balanced codes may cost; standard deviations beyond the mean Hamming distance of pairs at the threshold that are looked at.
BALANCE, RADIUS = 0.01, 5
#: Least sample on which agreement is measured; below it planes go through the origin, where the angle alone tells it.
MEASURED = 1000
#: Bits of a code at least; those beyond the substrings sharpen the Hamming distance.
CODE = 256


def rotations(v: np.ndarray, count: int, rounds: int = 40, seed: int = 7) -> np.ndarray:
    """count x d x d: orthogonal maps to binary codes, each from another random start."""
    rng, d, out = np.random.default_rng(seed), v.shape[1], []
    for _ in range(count):
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds if len(v) else 0):
            u, _, w = np.linalg.svd(v.T @ np.sign(v @ r + 1e-300))
            r = u @ w
        out.append(r)
    return np.asarray(out).reshape(count, d, d)


def agreement(threshold: float) -> float:
    """Share of bits in which a pair at the threshold agrees, for planes through the origin in random directions."""
    return 1 - math.acos(min(1.0, threshold)) / math.pi


def layout(n: int, agree: float) -> tuple[int, int]:
    """(bits of a substring, number of tables) for n different vectors."""
    width = max(1, min(62, math.ceil(math.log2(max(2, n) / BUCKET)))) if n > BUCKET else 1
    meet = min(agree, 1 - 1e-9) ** width
    return width, max(1, math.ceil(math.log(1 - REACH) / math.log1p(-meet)))


def quantiser(sample: np.ndarray, n: int, threshold: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int, int, int, int]:
    """(maps, offsets, width, tables, bits of a code, Hamming radius), from a sample of unit vectors."""
    d, agree = sample.shape[1], agreement(threshold)
    rng = np.random.default_rng(seed)
    across = rng.standard_normal(sample.shape)
    across -= (across * sample).sum(1, keepdims=True) * sample
    across /= np.maximum(np.sqrt((across * across).sum(1, keepdims=True)), 1e-300)
    moved = threshold * sample + math.sqrt(max(0.0, 1 - threshold**2)) * across  # at the threshold from the sample, in random directions
    while True:
        width, tables = layout(n, agree)
        bits = max(CODE, width * tables)
        maps = rotations(sample, math.ceil(bits / d))
        here, there = (np.concatenate([v @ r for r in maps], 1) for v in (sample, moved))
        offsets = np.zeros(here.shape[1])
        if len(sample) >= MEASURED:
            middle = np.median(here, 0)
            plain, balanced = (float(((here >= o) == (there >= o)).mean()) for o in (offsets, middle))
            if balanced >= plain - BALANCE:
                offsets, plain = middle, balanced
            found = min(agreement(threshold), plain - 0.002)
            if layout(n, found)[1] > tables:
                agree = found
                continue
        known = len(sample) >= MEASURED
        own = bits if known else min(bits, d)  # rotations may come out alike: a small sample doesn't show whether they did
        radius = bits * (1 - agree) + RADIUS * bits * math.sqrt(agree * (1 - agree) / own) + 3
        if known:  # no pair of the sample is lost
            radius = max(radius, int(((here >= offsets) != (there >= offsets))[:, :bits].sum(1).max()))
        return maps, offsets, width, tables, bits, min(bits, math.ceil(radius))


def codes(v: np.ndarray, maps: np.ndarray, offsets: np.ndarray, bits: int) -> np.ndarray:
    """Code of each vector as bits."""
    return (np.concatenate([v @ r for r in maps], 1) >= offsets)[:, :bits]


def substrings(bits: np.ndarray, width: int) -> np.ndarray:
    """Number of each substring of each code."""
    return bits.reshape(len(bits), -1, width).astype("i8") @ (1 << np.arange(width, dtype="i8"))


def _met(bits: np.ndarray, block: np.ndarray, cross: bool, t: int, width: int, radius: int) -> np.ndarray:
    """Pairs (row before column) within the radius that meet in table t first. With ``cross``, of different blocks only."""
    signs = np.where(bits, 1, -1).astype("f4")
    near = signs @ signs.T >= bits.shape[1] - 2 * radius
    near = np.triu(near, 1)
    if cross:
        near &= block[:, None] != block[None, :]
    if t:
        a, b = np.nonzero(near)
        keys = substrings(bits[:, : t * width], width)
        for lo in range(0, len(a), 1 << 18):
            x, y = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)]
            near[x, y] = ~(keys[x] == keys[y]).any(1)
    return near


def unit(batch: pa.ListArray, d: int) -> np.ndarray:
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, d)
    scale = np.abs(flat).max(1, keepdims=True)
    flat = flat / scale  # so that squares neither vanish nor overflow
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _roots(close: np.ndarray) -> np.ndarray:
    """Least index that each row reaches over links, by spreading the least label."""
    n = len(close)
    close = close | close.T | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(close, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_vectors(rows: DataFrame, *, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    spark = rows.sparkSession
    work, kept = Scratch(spark), Scratch(spark)
    plain = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x + 0.0)  # no negative zeros
    all_rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), plain.alias("v")).where("vec_id is not null")
    sound = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists("v", lambda x: x != 0), F.lit(False))
    good = all_rows.where(sound).withColumn("h", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(2), "v"))
    classes = work.stored(good.groupBy("h", "h2").agg(F.first("v").alias("v"), F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("node", F.struct("rep", "h")).drop("rep"), "vectors")
    sizes = [r["d"] for r in classes.select(F.size("v").alias("d")).distinct().collect()]  # lengths of vectors: one in any sound table
    node = "struct<rep:long,h:long>"
    found = spark.createDataFrame([], f"node {node}, root {node}, links long")
    for d in sorted(sizes):
        found = found.union(_links(classes.where(F.size("v") == d), d, threshold, work))
    found = work.stored(found, "tallies")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), work)
    known = classes.select("h", "h2", "m", "node").join(counts, "node", "left").join(roots, "node", "left")
    known = kept.stored(known.select("h", "h2", "m", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node")["rep"].alias("component_id")), "linked")
    work.drop()
    total = known.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    linked = spread_join(good.select("vec_id", "h", "h2"), known, ["h", "h2"], "m", total).select("vec_id", "n_links", "component_id")
    alone = all_rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(classes: DataFrame, d: int, threshold: float, work: Scratch) -> DataFrame:
    """(node, root, links) by tile: members that have links, the least member they reach in the tile, and their links' weight."""
    spark = classes.sparkSession
    n = classes.count()
    taken = classes.select("v", F.xxhash64("node").alias("x")).orderBy("x").limit(SAMPLE).toPandas()["v"]
    sample = unit(pa.array(taken.tolist(), pa.list_(pa.float64())), d) if len(taken) else np.zeros((0, d))
    maps, offsets, width, tables, bits, radius = quantiser(sample, n, threshold)
    held = spark.sparkContext.broadcast((maps, offsets))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                code = codes(unit(some.column(1), d), *held.value, bits)
                raw = pa.array([x.tobytes() for x in np.packbits(code, 1)], pa.binary())
                at = pa.array(np.repeat(np.arange(len(code)), tables))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype="i4"), len(code))), pa.array(substrings(code[:, : width * tables], width).reshape(-1)), some.column(0).take(at), raw.take(at)], ["t", "key", "node", "code"])

    placed = classes.select("node", "v").mapInArrow(place, "t int, key long, node struct<rep:long,h:long>, code binary")
    buckets = work.stored(placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / TILE).cast("int")), "buckets")
    sides = spread_join(placed, buckets, ["t", "key"], "n", n * tables).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    #: A block meets itself and each other block once: in the tile of both numbers.
    tiles = sides.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("t", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node.rep", "node.h", "code")
    names = ["t", "key", "i", "j", "block", "rep", "h", "code"]

    def unpacked(pdf: pd.DataFrame) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(pdf["code"]), "u1").reshape(len(pdf), -1), axis=1)[:, :bits].astype(bool)

    def likely(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, _, i, j = key
        met = _met(unpacked(pdf), pdf["block"].to_numpy(), i != j, int(t), width, radius)
        return pdf.loc[met.any(0) | met.any(1), names]

    few = work.stored(tiles.groupBy("t", "key", "i", "j").applyInPandas(likely, "t int, key long, i int, j int, block int, rep long, h long, code binary"), "likely")
    near = few.withColumn("node", F.struct("rep", "h")).join(classes.select("node", "m", "v"), "node").drop("node")

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, _, i, j = key
        pdf = pdf.sort_values(["rep", "h"])
        u = unit(pa.array(pdf["v"].tolist(), pa.list_(pa.float64())), d)
        m, cols = pdf["m"].to_numpy(), pdf[["rep", "h"]].to_numpy()
        met = _met(unpacked(pdf), pdf["block"].to_numpy(), i != j, int(t), width, radius)
        a, b = np.nonzero(met)
        close = np.zeros(len(a), bool)
        for lo in range(0, len(a), 1 << 16):  # row by row the same whatever else is in the tile
            close[lo : lo + (1 << 16)] = np.einsum("ij,ij->i", u[a[lo : lo + (1 << 16)]], u[b[lo : lo + (1 << 16)]]) >= threshold
        a, b = a[close], b[close]
        linked = np.zeros((len(u), len(u)), bool)
        linked[a, b] = True
        weight = np.bincount(a, m[b], len(u)) + np.bincount(b, m[a], len(u))
        some = np.unique(np.concatenate([a, b]))
        to = cols[_roots(linked)[some]]
        return pd.DataFrame({"rep": cols[some, 0], "h": cols[some, 1], "root_rep": to[:, 0], "root_h": to[:, 1], "links": weight[some].astype("i8")})

    found = near.groupBy("t", "key", "i", "j").applyInPandas(compare, "rep long, h long, root_rep long, root_h long, links long")
    return found.select(F.struct("rep", "h").alias("node"), F.struct(F.col("root_rep").alias("rep"), F.col("root_h").alias("h")).alias("root"), "links")
