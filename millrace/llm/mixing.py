"""Mixing sources to target weights: temperature, then budgeted block permutations.

Shares. A source with share p of the tokens gets weight p^a / sum(p^a). At a = 1 sources
keep their shares, at 0 all weigh the same. The exponent is found by bisection: the
largest whose weights reach a target entropy, or the least at which no source is
repeated more often than a limit.

Realisation. A source's weight times the budget is its token budget: so many whole
epochs, and part of a last one. In each epoch a source is one pseudo-random permutation,
in blocks: a hash of (seed, source, epoch, document) places a document in a block and
within it. Whole epochs take every block; of the last, blocks are taken in order while
they fit, and the block where the budget ends is cut by a running sum inside it. Blocks
hold about ``block_tokens`` tokens, so no task meets a whole source. Blocks of all
sources are dealt in turn by how much of their source's budget lies before them, so any
stretch of the output has about the target weights.

Passes. Tokens are counted and rows hashed once for the plan, in a table without texts;
all sums, and the hash at which a source's last epoch ends, come from that table. The
second pass decides of each row by itself, from its hash and its source's line of the
plan, so no text is shuffled for it (texts of rare sources are, where there are more than
a thousand sources). Sources may be any number: the driver sees no more than totals.

Without a budget, it is the least with which every document is used at least once; then
none is dropped. Tokens are words (runs without white space) unless a column counts them.
A null source is a source of its own; null texts have no tokens. Documents without
tokens come with each whole epoch. Rows that are equal in id, source and text share a
place and stay or go together. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free_name, spread_join

SEED = 20_240_229
#: Blocks whose sums are added up together when the end of a budget is looked for.
SPAN = 4096


def tokens_of(text: Column) -> Column:
    """Words of a text: runs without white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


class Sources:
    """Shares of the sources that have tokens: table (s, n). ``power(a)`` is (sum of p^a, sum of p^a ln p) over the shares p."""

    def __init__(self, table: DataFrame) -> None:
        found = table.where("n > 0").agg(F.sum("n").alias("all"), F.min("n").alias("least"), F.max("n").alias("most")).first()
        self.table, self.tokens = table.where("n > 0"), found["all"] or 0
        self.least, self.most = ((found[k] or 1) / (self.tokens or 1) for k in ("least", "most"))

    def powers(self, exponents: list[float]) -> list[tuple[float, float]]:
        """``power`` of all the exponents in one pass over the sources."""
        p, out = F.col("n") / F.lit(float(self.tokens or 1)), []
        for k, a in enumerate(exponents):
            out += [F.coalesce(F.sum(F.pow(p, F.lit(float(a)))), F.lit(1.0)).alias(f"z{k}"), F.coalesce(F.sum(F.pow(p, F.lit(float(a))) * F.log(p)), F.lit(0.0)).alias(f"y{k}")]
        r = self.table.agg(*out).first()
        return [(r[2 * k], r[2 * k + 1]) for k in range(len(exponents))]

    def entropy(self, a: float, power: tuple[float, float]) -> float:
        """Of the weights p^a / z."""
        z, y = power
        return math.log(z) - a * y / z

    def epochs(self, share: float, a: float, z: float, budget: float | None) -> float:
        """Epochs of a source of that share. Without a budget the largest source is a single epoch."""
        return (self.most / share) ** (1 - a) if budget is None else budget * share ** (a - 1) / (z * self.tokens)


def exponent_for(sources: Sources, *, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, steps: int = 12, points: int = 15) -> float:
    """Bisect the exponent in [0, 1], at some points at once. Both conditions grow or fall with it; what no exponent reaches gives the nearest end."""
    if not sources.tokens or (target_entropy is None and max_repeats is None):
        return 1.0

    def good(exponents: list[float]) -> list[bool]:
        if target_entropy is not None:
            return [sources.entropy(a, x) >= target_entropy for a, x in zip(exponents, sources.powers(exponents))]
        z = [1.0] * len(exponents) if budget is None else [x for x, _ in sources.powers(exponents)]
        return [sources.epochs(sources.least, a, x, budget) <= max_repeats + 1e-9 for a, x in zip(exponents, z)]

    lo, hi = 0.0, 1.0
    small, large = good([lo, hi])
    if target_entropy is not None:  # holds for small exponents; the largest is wanted
        if large or not small:
            return 1.0 if large else 0.0
    elif small or not large:  # holds for large exponents; the least is wanted
        return 0.0 if small else 1.0
    for _ in range(steps):
        inner = [lo + (hi - lo) * k / (points + 1) for k in range(1, points + 1)]
        held = good(inner)
        edges = [lo, *inner, hi]
        first = sum(held) if target_entropy is not None else len(held) - sum(held)  # the condition turns once
        lo, hi = edges[first], edges[first + 1]
    return lo if target_entropy is not None else hi


def _cut(held: DataFrame) -> DataFrame:
    """(s, k_block, before) of the block in which each source's budget ends, of (s, k_block, held, rest). Blocks are added up in spans first, so no task runs over all blocks of a source."""
    before = lambda w: F.coalesce(F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = held.groupBy("s", F.floor(F.col("k_block") / SPAN).alias("span")).agg(F.sum("held").alias("held"), F.max("rest").alias("rest"))
    spans = spans.withColumn("upto", before(Window.partitionBy("s").orderBy("span"))).where("upto <= rest and upto + held > rest").select("s", "span", "upto")
    inner = held.withColumn("span", F.floor(F.col("k_block") / SPAN)).join(spans, ["s", "span"])
    inner = inner.withColumn("before", F.col("upto") + before(Window.partitionBy("s", "span").orderBy("k_block")))
    return inner.where("before <= rest and before + held > rest").select("s", "k_block", "before")


def mix(docs: DataFrame, *, budget: int | None = None, exponent: float | None = None, target_entropy: float | None = None, max_repeats: float | None = None, block_tokens: int = 2_000_000, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokens_col: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (without the columns in ``drop``), each row once for each time it is used, with mix_tokens, mix_epoch, mix_block, mix_order (where its block stands, from 0 to 1) and mix_place (its place in the block)."""
    spark = docs.sparkSession
    work, kept = Scratch(spark), Scratch(spark)
    keep = [c for c in docs.columns if c not in drop]
    col = lambda c: F.col(f"`{c}`")
    count = col(tokens_col).cast("long") if tokens_col else tokens_of(col(text_col))
    row_hash = F.xxhash64(F.lit(seed), col(source_col), col(id_col), col(text_col))
    rows = docs.select(F.struct(*[col(c) for c in keep]).alias("row"), F.struct(col(source_col).alias("source")).alias("s"), F.coalesce(count, F.lit(0).cast("long")).alias("tokens"), row_hash.alias("h"))
    small = work.stored(rows.select("s", "h", "tokens"), "sizes")
    sums = work.stored(small.groupBy("s").agg(F.sum("tokens").alias("n"), F.count("*").alias("rows")), "sources")
    total = sums.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    sources = Sources(sums)
    if exponent is None:
        exponent = exponent_for(sources, target_entropy=target_entropy, max_repeats=max_repeats, budget=budget)
    share, whole_tokens = F.col("n") / F.lit(float(sources.tokens or 1)), float(sources.tokens or 1)
    if budget is None:
        raw = F.pow(F.lit(sources.most) / share, F.lit(1 - exponent))
    else:
        (z, _), = sources.powers([exponent])
        raw = F.lit(float(budget)) * F.pow(share, F.lit(exponent - 1)) / F.lit(z * whole_tokens)
    epochs = F.when(F.abs(raw - F.round(raw)) < 1e-9, F.round(raw)).otherwise(raw)
    plan = sums.withColumn("e", F.when(F.col("n") > 0, epochs).otherwise(1.0))
    plan = plan.withColumn("whole", F.floor("e").cast("int")).withColumn("rest", F.round((F.col("e") - F.col("whole")) * F.col("n")).cast("long")).withColumn("blocks", F.greatest(F.ceil(F.col("n") / block_tokens), F.lit(1)).cast("int")).drop("e")
    plan = work.stored(plan, "plan")

    def key(epoch: Column) -> Column:
        """A row's place in an epoch's permutation."""
        return F.xxhash64(epoch, F.col("h"))

    block_of = lambda k: F.floor((F.shiftrightunsigned(k, 11) / F.lit(float(1 << 53))) * F.col("blocks")).cast("int")
    last = spread_join(small, plan.where("rest > 0"), ["s"], "rows", total).withColumn("k_key", key(F.col("whole"))).withColumn("k_block", block_of(F.col("k_key")))
    held = work.stored(last.groupBy("s", "k_block").agg(F.sum("tokens").alias("held"), F.max("rest").alias("rest")), "held")
    cut = work.stored(_cut(held).join(plan.select("s", "rows"), "s"), "cut")
    edge = spread_join(last.select("s", "tokens", "k_key", "k_block", "rest"), cut.withColumnRenamed("k_block", "cut_block"), ["s"], "rows", total).where("k_block = cut_block")
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy("s", "k_block").orderBy("k_key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ends = edge.withColumn("upto", running).where("upto <= rest").groupBy("s").agg(F.max("k_key").alias("cut_key"))
    plan = kept.stored(plan.join(cut.select("s", F.col("k_block").alias("cut_block")), "s", "left").join(ends, "s", "left"), "mix-plan")
    work.drop()
    used = spread_join(rows, plan, ["s"], "rows", total)
    final = key(F.col("whole"))
    takes = (F.col("rest") > 0) & (F.col("cut_block").isNull() | (block_of(final) < F.col("cut_block")) | ((block_of(final) == F.col("cut_block")) & F.coalesce(final <= F.col("cut_key"), F.lit(False))))
    times = F.col("whole") + F.when(takes, 1).otherwise(0)
    used = used.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))
    used = used.withColumn("place", key(F.col("epoch"))).withColumn("block", block_of(F.col("place")))
    order = (F.col("epoch") + (F.col("block") + 0.5) / F.col("blocks")) / F.greatest(F.col("whole") + F.col("rest") / F.greatest("n", F.lit(1)), F.lit(1e-9))
    out = {"mix_tokens": F.col("tokens"), "mix_epoch": F.col("epoch"), "mix_block": F.col("block"), "mix_order": order, "mix_place": F.col("place")}
    return used.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *[x.alias(free_name(docs, n)) for n, x in out.items()])
