"""Token counts through a cache that is keyed by digests.

Key of the cache: SHA-256 of the normalised content (null texts as empty; nothing else
may change, or counts would) and a digest of the tokenizer's file and library version.
Documents join the cache by digest; of those it lacks, each distinct text is encoded
once and its count appended. A third of all rows being copies costs one encoding.

The cache is a Parquet table partitioned by tokenizer digest. An append that ran twice
leaves equal rows, which reading merges. Repeated rows and ids each get their row; null
ids stay null; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib.metadata import version

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join
from .encoding import encoder

SCHEMA = "digest binary, n_bytes long, n_tokens long, tokenizer string"


def tokenizer_digest(path: str) -> str:
    """Digest of the file and of the library's version: either may change counts."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {version(library)}".encode()).hexdigest()[:32]


def _exists(docs: DataFrame, path: str) -> bool:
    sc = docs.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)


def cached(docs: DataFrame, cache: str, key: str) -> DataFrame:
    """The cache's rows of one tokenizer, one for each digest."""
    spark = docs.sparkSession
    if not _exists(docs, cache):
        return spark.createDataFrame([], "digest binary, n_bytes long, n_tokens long")
    return spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == key).groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, cache: str, *, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and whether the cache had it (``hit``)."""
    key = tokenizer_digest(tokenizer)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    work, kept = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    keys = kept.stored(rows.select("doc_id", "digest"), "digests")
    each = work.stored(keys.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct")
    before = cached(docs, cache, key)
    #: Of each text that the cache lacks, the row to encode.
    misses = each.join(before, "digest", "left_anti").select(F.col("first").alias("miss_id"), F.col("digest").alias("miss"))
    texts = rows.join(misses, (rows["doc_id"].eqNullSafe(misses["miss_id"])) & (rows["digest"] == misses["miss"]), "left_semi").select("digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, count_only=True)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                strings = some.column(1)
                sizes = [len(x.as_buffer()) for x in strings]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes, pa.int64()), pa.array(enc.ids(strings.to_pylist()), pa.int64())], ["digest", "n_bytes", "n_tokens"])

    new = work.stored(texts.mapInArrow(run, "digest binary, n_bytes long, n_tokens long"), "token-counts")
    new.dropDuplicates(["digest"]).withColumn("tokenizer", F.lit(key)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    fresh = new.select("digest").distinct().withColumn("fresh", F.lit(True))
    known = kept.stored(each.select("digest", "copies").join(cached(docs, cache, key), "digest").join(fresh, "digest", "left"), "known")
    work.drop()
    found = spread_join(keys, known, ["digest"], "copies", keys.count())  # a digest may be that of a third of all rows
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.col("fresh").isNull().alias("hit"))
