"""Exact top k by inner product, with candidates in buckets of like length.

Candidates are ordered by length and cut into buckets (a block of each holds at most
``BLOCK`` of them, as one matrix); queries are dealt in blocks. A first look at a bounded
set of candidates gives each query a score that its k-th best can't fall below. With it
every bucket gets a local threshold for each query: score / (|q| x longest of the
bucket). Above 1 the whole bucket goes (length pruning of the bucket). Below, candidates
too short go (length pruning), and where the threshold is high enough the coordinates of
the query that are largest bound those of any candidate that could reach it (coordinate
pruning). What is left is multiplied out in exact integers; ties go to the smaller id.

Components are floor(64 x). A query's own row (equal id) is no candidate of it. Vectors
that are null or hold null or non-finite components take no part, nor do rows without an
id; vectors of another length than the query's are no candidates of it. A row that
repeats an id is a candidate of its own. A component x for which 64 x is no finite double
counts as non-finite. Scores are whole numbers of any size and ranked as such; one that
does not fit 64 bits is given as the nearest number that does. An empty table gives no
rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Candidates in a block, queries in a block, candidates of the first look.
BLOCK, QUERIES, LOOK = 4096, 512, 8192
#: Local cosine threshold from which on coordinates are looked at, and how many of them.
COORDINATES_FROM, FOCUS = 0.55, 3
SLACK = 1e-9


def integers(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x, len): whole-numbered doubles. From 2^52 on a double is whole as it stands; ``floor`` would cut it to 64 bits."""
    times = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x * 64)
    kept = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), times.alias("y")).where("id is not null")
    sound = F.coalesce((F.size("y") > 0) & F.forall("y", lambda y: y.isNotNull() & (F.abs(y) < float("inf")) & ~F.isnan(y)), F.lit(False))
    whole = F.transform("y", lambda y: F.when(F.abs(y) < float(2**52), F.floor(y).cast("double")).otherwise(y))
    return kept.where(sound).select("id", whole.alias("x")).withColumn("len", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, x: a + x * x)))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered doubles: by doubles where all sums stay below 2^52, by 64-bit integers below 2^62, else by Python's. Rows decide that alone, so one large row slows no other."""
    d = q.shape[1]
    q_top, c_top = np.abs(q).max(1, initial=0), np.abs(c).max(1, initial=0)
    if float(q_top.max(initial=0)) * float(c_top.max(initial=0)) * d < 2**52:
        return (q @ c.T).astype("i8")
    rows, beyond = [], False
    with np.errstate(over="ignore"):
        for x, top in zip(q, q_top):
            bound = c_top * top * d
            small, large = bound < 2.0**52, bound >= 2.0**62
            out = np.zeros(len(c), "i8")
            out[small] = (c[small] @ x).astype("i8")
            mid = ~small & ~large
            if mid.any():
                out[mid] = c[mid].astype("i8") @ x.astype("i8")
            if large.any():
                whole = [int(v) for v in x.tolist()]
                exact = [sum(a * int(b) for a, b in zip(whole, y)) for y in c[large].tolist()]
                out = out.astype(object)
                out[large] = exact
                beyond = True
            rows.append(out)
    return np.asarray(rows, dtype=object if beyond else "i8").reshape(len(q), len(c))


def below(x: int) -> float:
    """The largest double that isn't above a whole number."""
    try:
        f = float(x)
    except OverflowError:
        return sys.float_info.max if x > 0 else -math.inf
    return math.nextafter(f, -math.inf) if f > x else f


def ordinal(score: int) -> tuple[int, bytes]:
    """A score as 64 bits, and bytes that order those that don't fit."""
    if -(2**63) <= score < 2**63:
        return score, b"1"
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return (2**63 - 1, b"2" + raw) if score > 0 else (-(2**63), b"0" + bytes(255 - x for x in raw))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(ids) > 4 * k:
        few = np.sort(np.partition(scores, len(scores) - k)[-k:])[0]
        some = np.flatnonzero(scores >= few)
    else:
        some = np.arange(len(ids))
    if scores.dtype == object:
        return np.asarray(sorted(some.tolist(), key=lambda i: (-scores[i], ids[i]))[:k], "i8")
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def survivors(q: np.ndarray, q_len: float, floor: float, c: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Places in a block (longest first) of what may reach ``floor``. Bounds are wide by SLACK, so none is lost."""
    if q_len == 0 or floor <= 0 or not np.isfinite(q_len * lens[0]):
        return np.arange(len(c))
    if floor * (1 - SLACK) > q_len * lens[0] * (1 + SLACK):
        return np.empty(0, "i8")
    n = int(np.searchsorted(-lens, -floor / q_len * (1 - SLACK), "right"))
    local = floor / (q_len * lens[0]) * (1 - SLACK)
    if local < COORDINATES_FROM:
        return np.arange(n)
    keep = np.ones(n, bool)
    size = np.maximum(lens[:n], 1e-300)
    t = np.minimum(floor / (q_len * size) * (1 - SLACK), 1.0)
    for f in np.argsort(-np.abs(q))[:FOCUS]:  # a unit vector within angle t of q has coordinate f between these; the cap holds the axis itself where own >= t, its opposite where own <= -t
        own = q[f] / q_len
        reach = np.sqrt(np.maximum(1 - t * t, 0) * max(1 - own * own, 0.0)) + 1e-7
        share = c[:n, f] / size
        keep &= ((share <= own * t + reach) | (own >= t)) & ((share >= own * t - reach) | (own <= -t))
    return np.flatnonzero(keep)


def top_k(rows: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k best of ``rows``."""
    all_c = stored(integers(rows, id_col, vector_col), "candidates")
    all_q = integers(queries, id_col, vector_col)
    sizes = [r["d"] for r in all_c.select(F.size("x").alias("d")).distinct().collect()]  # lengths of vectors: one in any sound table
    parts = [_top_k(all_c.where(F.size("x") == d), all_q.where(F.size("x") == d), d, k) for d in sorted(sizes)]
    out = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long, beyond binary")
    for p in parts:
        out = out.union(p)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return out.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocked(df: DataFrame, number: str, d: int, sort: str) -> DataFrame:
    """One row for each block: ids and other numbers as arrays, vectors as one matrix."""

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([sort, "id"], ascending=[False, True])
        x = np.asarray(pdf["x"].tolist(), "f8").reshape(-1, d)
        floor = pdf["floor"].to_numpy("f8") if "floor" in pdf else np.zeros(len(pdf))
        need = floor / np.maximum(pdf["len"].to_numpy("f8"), 1e-300)
        need[(floor <= 0) | (pdf["len"] == 0)] = -np.inf
        return pd.DataFrame({"block": [key[0]], "ids": [pdf["id"].to_numpy()], "lens": [pdf["len"].to_numpy()], "floors": [floor], "x": [x.tobytes()], "longest": [float(pdf["len"].max())], "need": [float(need.min())]})

    return df.groupBy(number).applyInPandas(gather, "block long, ids array<long>, lens array<double>, floors array<double>, x binary, longest double, need double")


def _top_k(cands: DataFrame, queries: DataFrame, d: int, k: int) -> DataFrame:
    spark = cands.sparkSession
    n = cands.count()
    half = LOOK // 2
    longest = cands.orderBy(F.desc("len"), "id").limit(half)
    look = longest.union(cands.orderBy(F.xxhash64("id")).limit(half)).dropDuplicates(["id", "x"]).toPandas()  # bounded by LOOK
    look_ids = look["id"].to_numpy("i8")
    held = spark.sparkContext.broadcast((look_ids, np.asarray(look["x"].tolist(), "f8").reshape(-1, d)))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = held.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                q = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                scores, own = products(q, x), some.column(0).to_numpy()[:, None] == ids[None, :]
                floor = []
                for line, mine in zip(scores, own):
                    line = line[~mine]
                    floor.append(below(int(np.partition(line, len(line) - k)[len(line) - k])) if len(line) >= k else -np.inf)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(floor, pa.float64())], ["id", "x", "len", "floor"])

    ready = queries.mapInArrow(floors, "id long, x array<double>, len double, floor double")
    #: Buckets of like length: the range of an exact sort, cut into blocks of bounded size.
    buckets = max(1, -(-n // BLOCK))
    sorted_c = cands.repartitionByRange(buckets, F.desc("len"), "id").withColumn("part", F.spark_partition_id())
    counted = stored(sorted_c, "by-length")
    sizes = counted.groupBy("part").agg(F.count("*").alias("c"))
    cut = counted.join(sizes, "part").withColumn("number", F.col("part").cast("long") * 1_000_000 + F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("c") / BLOCK)))
    c_blocks = stored(_blocked(cut.select("number", "id", "x", "len"), "number", d, "len"), "blocks")
    n_q = max(1, -(-queries.count() // QUERIES))
    dealt = ready.withColumn("number", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n_q)))
    q_blocks = stored(_blocked(dealt, "number", d, "floor"), "queries")
    #: The stated queries against all rows, block by block; blocks that no query of a block needs are left out before anything is read.
    left = c_blocks.select(F.col("block").alias("c"), F.col("longest").alias("c_longest"))
    right = q_blocks.select(F.col("block").alias("q"), "need")
    pairs = left.join(right, F.col("c_longest") * (1 + SLACK) >= F.col("need"))
    named = lambda df, p: df.select(*[F.col(x).alias(f"{p}_{x}") for x in ("block", "ids", "lens", "floors", "x")])
    work = pairs.join(named(q_blocks, "q"), F.col("q") == F.col("q_block")).join(named(c_blocks, "c"), F.col("c") == F.col("c_block")).select("q_ids", "q_lens", "q_floors", "q_x", "c_ids", "c_lens", "c_x")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_lens, q_floors, q_x, c_ids, c_lens, c_x = (batch.column(i)[row] for i in range(7))
                arr = lambda s: s.values.to_numpy(zero_copy_only=False)
                ids, lens = arr(c_ids), arr(c_lens)
                c = np.frombuffer(c_x.as_buffer(), "f8").reshape(-1, d)
                q = np.frombuffer(q_x.as_buffer(), "f8").reshape(-1, d)
                out_q, out_v, out_s = [], [], []
                for i, (qid, ql, floor) in enumerate(zip(arr(q_ids), arr(q_lens), arr(q_floors))):
                    some = survivors(q[i], ql, floor, c, lens)
                    some = some[ids[some] != qid]
                    if not len(some):
                        continue
                    scores = products(q[i : i + 1], c[some])[0]
                    hit = np.flatnonzero((scores >= floor).astype(bool)) if floor > -np.inf else np.arange(len(some))
                    best = hit[_best(ids[some][hit], scores[hit], k)] if len(hit) else hit
                    out_q += [qid] * len(best)
                    out_v += ids[some][best].tolist()
                    out_s += [ordinal(int(x)) for x in scores[best]]
                yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_v, pa.int64()), pa.array([x for x, _ in out_s], pa.int64()), pa.array([x for _, x in out_s], pa.binary())], ["query_id", "vec_id", "score", "beyond"])

    return work.mapInArrow(verify, "query_id long, vec_id long, score long, beyond binary")
