"""Near duplicates by improved consistent weighted sampling over TF-IDF word shingles.

1. Document frequencies of words, hashed to a fixed number of cells, over all texts;
   tasks count before anything is shuffled, and the table has a fixed size.
2. Each text becomes weighted shingles of five words: how often one occurs, times the
   mean idf of its words. Idf 1 + ln((1 + N) / (1 + df)) is that of words, not of
   shingles, so that copies of a passage don't lower their own weight. Consistent
   weighted sampling draws ``bands x rows`` samples of each text; the chance that two
   texts agree in one is their weighted Jaccard similarity.
3. Texts of equal words are one class. Classes that agree in a whole band are
   candidates: first each with one hub of its band (the class that meets most others in
   all its bands, so the original of a group rather than one of its copies), then with
   another hub those that are not yet in its component, last all of different components
   that share a band. Candidates whose weights or samples rule the threshold out are
   dropped; the rest are verified by the exact weighted Jaccard similarity of their whole
   texts. Pairs within a component need no test, so a group of m copies costs about m
   tests. Bands of many classes end in tiles of bounded size: first samples meet, and only
   members of a tile with a likely partner in another component bring their texts, which
   are compared as matrices. Tiles return links between components and never pairs.
4. Connected components of verified links are the groups.

Words are runs of letters and digits in lower case. A text of fewer than five words is
one shingle; a text without words (or null) or a row without an id is a group of its
own. Rows that repeat an id and its text stand and fall together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, maybe_among, spread_join
from .graph import components

WORDS = 5
#: Wanted chance that a pair at the threshold shares a band; most samples of a text; chance that such a pair agrees in too few samples to be looked at.
MEET, SAMPLES, MISSED = 0.998, 64, 1e-6
#: Cells of the table of document frequencies, as a power of two.
CELL_BITS = 18
#: Classes in a band beyond which they are compared in tiles, and classes in a tile's side.
CROWD, TILE = 16, 128
#: Pairs with one hub whose texts are compared in one task.
HUB_PAIRS = 128
#: A class is told by the least (id, th) of its rows: an id that repeats with other texts stands for a class by each.
NODE = "struct<id:long,th:long>"
CHUNK = 1 << 20

IS_WORD = np.zeros(256, bool)
IS_WORD[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")] = True
IS_WORD[128:] = True
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


POWERS = np.multiply.accumulate(np.full(4096, 0x9E3779B97F4A7C15 | 1, "u8"))
PLACES = mix(np.arange(1, WORDS + 1, dtype="u8")) | U(1)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more than texts)."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()))
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], "u1") if texts.buffers()[2] else np.empty(0, "u1")
    at, end, hashes, places = int(offsets[0]), int(offsets[-1]), [], []
    ends = np.unique(offsets)
    while at < end:
        stop = min(at + CHUNK, end)
        while stop < end and IS_WORD[raw[stop]] and IS_WORD[raw[stop - 1]]:
            more = np.flatnonzero(~IS_WORD[raw[stop : stop + CHUNK]])
            stop = stop + int(more[0]) if len(more) else min(end, stop + CHUNK)
        block = raw[at:stop]
        is_word = IS_WORD[block]
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1]
        cuts = ends[np.searchsorted(ends, at) : np.searchsorted(ends, stop)] - at
        begins[cuts] = is_word[cuts]
        inside = np.flatnonzero(is_word)
        if len(inside):
            first = np.flatnonzero(begins[inside])
            starts = inside[first]
            lengths = np.diff(np.append(first, len(inside)))
            place = inside - np.repeat(starts, lengths)
            values = (block[inside].astype("u8") + U(1)) * POWERS[place & 4095]
            hashes.append(mix(np.add.reduceat(values, first) + lengths.astype("u8")))
            places.append(starts + at)
        at = stop
    if not hashes:
        return np.empty(0, "u8"), np.zeros(len(offsets), "i8")
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets)


def shingles(hashes: np.ndarray, begins: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text, in order of their hash; their weights; and where each text's begin."""
    n = np.diff(begins)
    weight = idf[(hashes >> U(64 - CELL_BITS)).astype("i8")]
    of = np.repeat(np.arange(len(n)), n)
    if len(hashes) >= WORDS:
        m = len(hashes) - WORDS + 1
        codes = hashes[:m] * PLACES[0]
        sums = weight[:m].copy()
        for k in range(1, WORDS):
            codes += hashes[k : k + m] * PLACES[k]
            sums += weight[k : k + m]
        whole = of[:m] == of[WORDS - 1 :]
        codes, sums, of = codes[whole], sums[whole] / WORDS, of[:m][whole]
    else:
        codes, sums, of = hashes[:0], weight[:0], of[:0]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        more = [(int((hashes[begins[i] : begins[i + 1]] * PLACES[: n[i]]).sum(dtype="u8")), float(weight[begins[i] : begins[i + 1]].mean())) for i in short]
        codes = np.concatenate([codes, np.asarray([x for x, _ in more], "u8")])
        sums = np.concatenate([sums, np.asarray([x for _, x in more])])
        of = np.concatenate([of, short])
    codes = mix(codes)
    key = of.astype("u8") << U(44) | codes >> U(20)
    order = np.argsort(key)
    key, codes, sums, of = key[order], codes[order], sums[order], of[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, "i8")
    if len(first):
        sums = np.add.reduceat(sums, first)
    return codes[first], sums, np.searchsorted(of[first], np.arange(len(n) + 1))


class Sampler:
    """Consistent weighted samples. Gamma(2, 1) variates come from a table of its quantiles, by 16 bits of a hash each."""

    def __init__(self, samples: int) -> None:
        self.samples = samples
        p = (np.arange(65536) + 0.5) / 65536
        x = np.where(p < 0.1, np.sqrt(2 * p), 1 - np.log1p(-p))
        for _ in range(60):  # Newton's method on 1 - (1 + x) e^-x = p
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - p) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
        self.r, self.inverse, self.log = x.astype("f4"), (1 / x).astype("f4"), np.log(x).astype("f4")
        self.seeds = mix(np.arange(1, samples + 1, dtype="u8") * U(0x9E3779B97F4A7C15)) | U(1)

    def __call__(self, codes: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """A row of 32-bit samples for each text that has shingles."""
        out = np.zeros((len(begins) - 1, self.samples), "i4")
        full = np.flatnonzero(np.diff(begins) > 0)
        at = 0
        while at < len(full):  # texts of some 16,000 shingles at a time: what is touched stays near
            to = max(at + 1, int(np.searchsorted(begins[full + 1], begins[full[at]] + 16384, "right")))
            mine = full[at:to]
            lo, hi = int(begins[mine[0]]), int(begins[mine[-1] + 1])
            out[mine] = self._block(codes[lo:hi], np.log(weights[lo:hi]).astype("f4"), begins[mine] - lo)
            at = to
        return out

    def _block(self, codes: np.ndarray, logs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        place = np.arange(len(codes), dtype="u8")
        out = np.empty((len(starts), self.samples), "i4")
        for j, seed in enumerate(self.seeds):
            h = codes * seed
            h ^= h >> U(29)
            h *= U(0x94D049BB133111EB)
            a, b = (h >> U(48)).astype("i4"), (h >> U(32) & U(65535)).astype("i4")
            beta = (h >> U(12) & U(0xFFFFF)).astype("f4") * np.float32(2.0**-20)
            t = np.floor(logs * self.inverse[a] + beta)
            cost = self.log[b] - self.r[a] * (t - beta + np.float32(1))
            bits = cost.view("u4")
            bits = np.where(bits >> 31, ~bits, bits | np.uint32(0x80000000)).astype("u8")
            least = np.minimum.reduceat(bits << U(32) | place, starts) & U(0xFFFFFFFF)
            won = least.astype("i8")
            out[:, j] = (mix(codes[won] + t[won].astype("i8").astype("u8") * seed) >> U(32)).astype("u4").view("i4")
        return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two texts' (distinct shingles, weights)."""
    codes = np.concatenate([a[0], b[0]])
    weights = np.concatenate([a[1], b[1]])
    order = np.argsort(codes, kind="stable")
    codes, weights = codes[order], weights[order]
    same = np.flatnonzero(codes[1:] == codes[:-1])
    common = float(np.minimum(weights[same], weights[same + 1]).sum())
    whole = float(weights.sum()) - common
    return common / whole if whole else 0.0


def word_idf(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Idf by cell, over all texts: 2^CELL_BITS numbers whatever the input."""
    cells = 1 << CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, texts = np.zeros(cells, "i8"), 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                hashes, begins = words(batch.column(0).slice(k, 256))
                of = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
                pairs = np.unique(of.astype("u8") << U(CELL_BITS) | hashes >> U(64 - CELL_BITS))
                df += np.bincount((pairs & U(cells - 1)).astype("i8"), minlength=cells)
                texts += len(begins) - 1
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(df[used], texts))], ["cell", "n"])

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    found = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(cells)
    total = float(found.loc[found["cell"] < 0, "n"].sum())
    known = found[found["cell"] >= 0]
    df[known["cell"].to_numpy("i8")] = known["n"].to_numpy("f8")
    return 1 + np.log((1 + total) / (1 + df))


def layout(threshold: float) -> tuple[int, int, int]:
    """(bands, samples of a band, least number of equal samples) for a threshold: the longest bands with which pairs at the threshold meet as wanted."""
    choices = []
    for rows in range(1, 17):
        bands = math.ceil(math.log(1 - MEET) / math.log1p(-min(threshold, 1 - 1e-9) ** rows))
        if bands * rows <= SAMPLES or not choices:
            choices.append((bands, rows))
    bands, rows = choices[-1]
    n, below, least = bands * rows, 0.0, 0
    while least < n:
        below += math.comb(n, least) * threshold**least * (1 - threshold) ** (n - least)
        if below > MISSED:
            break
        least += 1
    return bands, rows, least


def signatures(rows: DataFrame, idf: np.ndarray, bands: int, per_band: int) -> DataFrame:
    """(id, th, d1, d2, weight, sig) of rows (id, th, text) whose text has words; d1 and d2 tell texts of equal words."""
    held = rows.sparkSession.sparkContext.broadcast(idf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * per_band)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                hashes, begins = words(some.column(2))
                n = np.diff(begins)
                full = np.flatnonzero(n > 0)
                if not len(full):
                    continue
                place = (np.arange(len(hashes)) - np.repeat(begins[:-1], n)).astype("u8")
                d1 = np.add.reduceat(mix(hashes + place * U(0x9E3779B97F4A7C15)), begins[full]).view("i8")
                d2 = np.add.reduceat(mix(hashes ^ mix(place + U(7))), begins[full]).view("i8")
                codes, weights, at = shingles(hashes, begins, held.value)
                total = np.add.reduceat(weights, at[full]) if len(full) else weights
                sig = sampler(codes, weights, at)[full]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype="i4") * sig.shape[1]), pa.array(sig.reshape(-1)))
                pick = pa.array(full)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pick), some.column(1).take(pick), pa.array(d1), pa.array(d2), pa.array(total), lists], ["id", "th", "d1", "d2", "weight", "sig"])

    return rows.mapInArrow(run, "id long, th long, d1 long, d2 long, weight double, sig array<int>")


def _band_keys(sig: Column, bands: int, per_band: int) -> Column:
    """A key for each band."""
    return F.array(*[F.xxhash64(F.lit(j), F.slice(sig, j * per_band + 1, per_band)) for j in range(bands)])


def similarities(codes: np.ndarray, weights: np.ndarray, begins: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Weighted Jaccard similarity of all texts of a tile. The lesser of two weights of a shingle is the sum of the steps that both reach, so sums of lesser weights are a matrix product."""
    n = len(begins) - 1
    of = np.repeat(np.arange(n), np.diff(begins))
    total = np.bincount(of, weights, n)
    order = np.lexsort((weights, codes))
    c, w, of = codes[order], weights[order], of[order]
    again = np.append(False, c[1:] == c[:-1])
    shared = again | np.append(again[1:], False)  # a shingle of one text alone adds nothing
    c, w, of, again = c[shared], w[shared], of[shared], again[shared]
    common = np.zeros((n, n))
    if len(c):
        higher = np.append(True, (c[1:] != c[:-1]) | (w[1:] != w[:-1]))
        level = np.cumsum(higher) - 1
        at = np.flatnonzero(higher)
        first = ~again[at]
        step = w[at] - np.where(first, 0, np.append(0, w[at][:-1]))
        low = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))  # lowest level of the same shingle
        spans = level - low[level] + 1
        rows = np.repeat(of, spans)
        cols = np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans) + np.repeat(low[level], spans)
        for lo in range(0, len(at), columns):
            mine = (cols >= lo) & (cols < lo + columns)
            m = np.zeros((n, min(columns, len(at) - lo)))
            m[rows[mine], cols[mine] - lo] = 1
            common += (m * step[lo : lo + columns]) @ m.T
    whole = total[:, None] + total - common
    return np.divide(common, whole, out=np.zeros_like(common), where=whole > 0)


def _tiled(left: DataFrame, signs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, least: int, work: Scratch) -> DataFrame:
    """Links (a, b) between components within bands, of (key, id, root), whose id and root are classes: enough to join all that are linked. Blocks of the largest component of a band don't meet each other."""
    held = left.sparkSession.sparkContext.broadcast(idf)
    size = left.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("all"))
    size = work.stored(size.select("key", "all", F.col("m.root").alias("main"), F.ceil(F.col("m.n") / TILE).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("m.n")) / TILE).cast("int").alias("others")), "sizes")
    own = F.xxhash64("id")
    placed = spread_join(left, size, ["key"], "all", left.count()).withColumn("block", F.when(F.col("root") == F.col("main"), F.col("others") + F.pmod(own, F.col("mains"))).otherwise(F.pmod(own, F.col("others"))).cast("int"))
    meets = F.when(F.col("root") == F.col("main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    tiles = placed.join(signs, "id").withColumn("other", F.explode(meets)).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id.id", "id.th", F.col("root.id").alias("root_id"), F.col("root.th").alias("root_th"), "weight", "sig")
    names = ["key", "i", "j", "id", "th", "root_id", "root_th"]

    def likely(pdf: pd.DataFrame) -> pd.DataFrame:
        """Members with a partner in another component that neither weights nor samples rule out."""
        pdf = pdf.drop_duplicates(["id", "th"])
        sig, w = np.stack(pdf["sig"].to_numpy()), pdf["weight"].to_numpy()
        root = pdf.groupby(["root_id", "root_th"]).ngroup().to_numpy()
        near = np.zeros(len(pdf), bool)
        for k in range(0, len(pdf), 32):
            same = (sig[k : k + 32, None, :] == sig[None, :, :]).sum(2) >= least
            lighter, heavier = np.minimum(w[k : k + 32, None], w), np.maximum(w[k : k + 32, None], w)
            near[k : k + 32] = (same & (root[k : k + 32, None] != root) & (lighter >= threshold * 0.999999 * heavier)).any(1)
        return pdf.loc[near, names]

    some = work.stored(tiles.groupBy("key", "i", "j").applyInPandas(likely, "key long, i int, j int, id long, th long, root_id long, root_th long"), "likely")
    tiles = some.withColumn("node", F.struct("id", "th")).join(texts.withColumnRenamed("id", "node"), "node").select(*names, "text")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        sims = similarities(*shingles(*words(pa.array(pdf["text"], pa.string())), held.value))
        ids = list(zip(pdf["id"].tolist(), pdf["th"].tolist()))
        roots = pdf.groupby(["root_id", "root_th"]).ngroup().to_numpy()
        a, b = np.nonzero(np.triu((sims >= threshold) & (roots[:, None] != roots[None, :])))
        up: dict[int, int] = {}

        def find(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        kept = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(int(roots[x])), find(int(roots[y]))
            if p != q:
                up[p] = q
                kept.append(ids[x] + ids[y])
        return pd.DataFrame(kept, columns=["a", "ta", "b", "tb"]).astype("int64")

    found = tiles.groupBy("key", "i", "j").applyInPandas(compare, "a long, ta long, b long, tb long")
    return found.select(F.struct(F.col("a").alias("id"), F.col("ta").alias("th")).alias("a"), F.struct(F.col("b").alias("id"), F.col("tb").alias("th")).alias("b"))


def _verified(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, work: Scratch) -> DataFrame:
    """Of pairs (a, b), those whose weighted Jaccard similarity reaches the threshold. A hub b may be in any number of pairs: they are dealt in blocks, and its text is read once for each block."""
    held = pairs.sparkSession.sparkContext.broadcast(idf)
    pairs = work.stored(pairs.select("a", "b"), "pairs")
    hubs = pairs.groupBy("b").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / HUB_PAIRS).cast("int"))
    dealt = spread_join(pairs, hubs, ["b"], "n", pairs.count()).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).drop("blocks")
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    right = hubs.select("b", "blocks").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("b", "tb", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    both = dealt.join(left, "a").join(right, ["b", "block"]).select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                some = batch.slice(k, 128)
                sides = []
                for c in (2, 3):
                    codes, weights, at = shingles(*words(some.column(c)), held.value)
                    sides.append([(codes[s:e], weights[s:e]) for s, e in zip(at[:-1], at[1:])])
                sims = np.asarray([weighted_jaccard(x, y) for x, y in zip(*sides)], "f8")
                good = pa.array(np.flatnonzero(sims >= threshold))
                yield pa.RecordBatch.from_arrays([some.column(0).take(good), some.column(1).take(good)], ["a", "b"])

    return both.mapInArrow(run, f"a {NODE}, b {NODE}")


def groups(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", work: Scratch | None = None) -> DataFrame:
    """(id, th, class_id): the least id of its group, for each row that has an id and words. ``th`` is xxhash64 of the text."""
    work = work or Scratch(docs.sparkSession)
    bands, per_band, least = layout(threshold)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text")).where("id is not null and text is not null")
    idf = word_idf(rows)
    signed = work.stored(signatures(rows, idf, bands, per_band), "signatures")
    node = F.struct("id", "th")
    classes = work.stored(signed.groupBy("d1", "d2").agg(F.min(node).alias("rep"), F.first("weight").alias("weight"), F.first("sig").alias("sig"), F.count("*").alias("copies")), "classes")
    reps = classes.select(F.col("rep").alias("id"), "weight", "sig")
    keyed = reps.select("id", F.explode(_band_keys(F.col("sig"), bands, per_band)).alias("key"))
    shared = work.stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("members", F.col("n")), "shared")
    crowded = work.stored(spread_join(keyed, shared, ["key"], "members", classes.count() * bands), "bands")  # (id, key, n)
    total = crowded.count()
    meets = crowded.groupBy("id").agg(F.sum("n").alias("meets"))
    wanted = work.stored(meets.join(reps, "id"), "wanted")
    signs = wanted.select("id", "weight", "sig")
    is_wanted = maybe_among(wanted.select(F.xxhash64("id.id", "id.th").alias("h")), work)(F.xxhash64("id", "th"))
    texts = work.stored(rows.where(is_wanted).select(node.alias("id"), "text").join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"]), "candidates")

    def with_hubs(left: DataFrame, hubs: DataFrame, size: int, differ: str) -> DataFrame:
        """Pairs (a, b) of members (key, id, ...) and their band's hub (key, n, hub, ...) that neither weights nor samples rule out."""
        hubs = work.stored(hubs.join(signs.select(F.col("id").alias("hub"), F.col("weight").alias("hub_weight"), F.col("sig").alias("hub_sig")), "hub"), "band-hubs")
        two = spread_join(left.drop("n"), hubs, ["key"], "n", size).where(differ).join(signs, "id")
        return likely(two, "id", "hub", "weight", "sig", "hub_weight", "hub_sig")

    def likely(two: DataFrame, a: str, b: str, wa: str, sa: str, wb: str, sb: str) -> DataFrame:
        equal = F.aggregate(F.zip_with(sa, sb, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        good = two.where((F.least(wa, wb) >= threshold * 0.999999 * F.greatest(wa, wb)) & (equal >= least))
        return good.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()

    hubs = crowded.join(wanted.select("id", "meets"), "id").groupBy("key").agg(F.min(F.struct((-F.col("meets")).alias("minus"), "id")).alias("h"), F.max("n").alias("n")).select("key", "n", F.col("h.id").alias("hub"))
    links = work.stored(_verified(with_hubs(crowded, hubs, total, "id <> hub"), texts, idf, threshold, work), "links")
    labels, found = components(links, work), True
    for step in range(2):
        if found:  # else the bands that are open are those of the step before
            open_bands = work.stored(crowded.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("root", "id").alias("root")), "roots")
            split = open_bands.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("s1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("s2")).where("lo <> hi")
            split = work.stored(split.groupBy("s1", "s2", "n").agg(F.min("key").alias("key")).select("key", "n", F.col("n").alias("members")), "split")  # bands of the same classes are one
            if split.isEmpty():
                break
            left = work.stored(spread_join(open_bands, split, ["key"], "members", total), "open-bands")
        if step == 0:  # another hub for each band
            again = left.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(step)).alias("h"), F.col("id").alias("hub"), F.col("root").alias("hub_root"))).alias("x"), F.max("n").alias("n")).select("key", "n", "x.hub", "x.hub_root")
            pairs = with_hubs(left, again, left.count(), "root <> hub_root")
        else:
            few = left.where(F.col("n") <= CROWD).select("key", "id", "root")
            other = few.select("key", F.col("id").alias("id2"), F.col("root").alias("root2"))
            two = few.join(other, "key").where("id < id2 and root <> root2").select("id", "id2").distinct()
            two = two.join(signs, "id").join(signs.select(F.col("id").alias("id2"), F.col("weight").alias("w2"), F.col("sig").alias("sig2")), "id2")
            pairs = likely(two, "id", "id2", "weight", "sig", "w2", "sig2")
        more = _verified(pairs, texts, idf, threshold, work)
        if step:
            more = more.union(_tiled(left.where(F.col("n") > CROWD).select("key", "id", "root"), signs, texts, idf, threshold, least, work))
        more = work.stored(more, "links")
        found = not more.isEmpty()
        if found:
            labels = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b").union(more), work)
    rooted = work.stored(classes.select("d1", "d2", "rep", "copies").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "copies", F.coalesce("root", "rep")["id"].alias("class_id")), "rooted")
    return spread_join(signed.select("id", "th", "d1", "d2"), rooted, ["d1", "d2"], "copies", signed.count()).select("id", "th", "class_id")


def _gone(docs: DataFrame, threshold: float, id_col: str, text_col: str, kept: Scratch) -> DataFrame:
    """(gone_id, gone_th, class_id) of the rows that aren't the least of their group; all other tables of the call are deleted."""
    work = Scratch(docs.sparkSession)
    found = groups(docs, threshold=threshold, id_col=id_col, text_col=text_col, work=work).where("id <> class_id")
    out = kept.stored(found.groupBy(F.col("id").alias("gone_id"), F.col("th").alias("gone_th")).agg(F.min("class_id").alias("class_id")), "groups")
    work.drop()
    return out


def near_duplicates(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (least id of its group, itself included), kept (doc_id = class_id; true without an id)."""
    gone = _gone(docs, threshold, id_col, text_col, Scratch(docs.sparkSession))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"))
    placed = rows.join(gone, (F.col("doc_id").cast("long") == F.col("gone_id")) & (F.col("th") == F.col("gone_th")), "left")
    return placed.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("class_id").isNull().alias("kept"))


def one_of_each(docs: DataFrame, *, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the least of their group, with all their columns. Only texts that may go are shuffled."""
    kept = Scratch(docs.sparkSession)
    gone = _gone(docs, threshold, id_col, text_col, kept).drop("class_id")
    own_id, own_th = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`"))
    may_go = maybe_among(gone.select(F.xxhash64("gone_id", "gone_th").alias("h")), kept)(F.xxhash64(own_id, own_th))
    return docs.where(~may_go).union(docs.where(may_go).join(gone, (own_id == F.col("gone_id")) & (own_th == F.col("gone_th")), "left_anti"))
