"""Concatenate and cut: documents end to end, cut into windows of a fixed number of tokens.

Pass 1 encodes each document once, where its rows are read, and notes the tokens
before it in its partition (with ``file_order``: in its stretch of a file). Prefix sums
over these totals (one row each) give every partition its place in the whole, or every
stretch: then documents stand in the order of files by name and of rows in them. Pass 2
cuts each document where the windows of the whole end; nothing is shuffled.

Null texts count as empty; each document has at least its end token. Repeated rows
and ids are documents of their own. Null ids stay null. An empty table gives no rows.
Columns other than the two named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored
from .encoding import encoder

#: Texts that are encoded together.
STEP = 512


def encoded(docs: DataFrame, *, tokenizer: str, end_id: int | None = 1, file_order: bool = False, max_pieces: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, file, at, before, doc_id, n_tokens, ids): ids as little-endian uint32; ``before`` counts the tokens before the row in its partition or, with ``file_order``, in its stretch of a file from ``at`` on."""
    place = (F.input_file_name(), F.input_file_block_start()) if file_order else (F.lit(""), F.lit(0).cast("long"))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), place[0].alias("file"), place[1].alias("at"))
    tail = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, enc, unit = TaskContext.get().partitionId(), 0, encoder(tokenizer, **({"max_pieces": max_pieces} if max_pieces else {})), None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                some = batch.slice(at, STEP)
                ids = [x + tail for x in enc.ids(some.column(1).to_pylist())]
                n = np.asarray([len(x) // 4 for x in ids], "i8")
                starts = np.empty(len(n), "i8")
                for i, own in enumerate(zip(some.column(2).to_pylist(), some.column(3).to_pylist())):
                    if own != unit:
                        unit, before = own, 0
                    starts[i] = before
                    before += int(n[i])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, "i4")), some.column(2), some.column(3), pa.array(starts), some.column(0), pa.array(n), pa.array(ids, pa.binary())], ["part", "file", "at", "before", "doc_id", "n_tokens", "ids"])

    kind = rows.schema["doc_id"].dataType
    return rows.mapInArrow(run, T.StructType([T.StructField("part", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("at", T.LongType()), T.StructField("before", T.LongType()), T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))


def pack(docs: DataFrame, *, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, with_ids: bool = False, file_order: bool = False, max_pieces: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document: its place in the document and in its sequence.

    ``boundary`` marks pieces of sequences that reach over the ends of a partition of pass 1;
    ``padded_length`` is the capacity, or the sequence's own length if that is a power of two.
    ``max_pieces`` bounds the cache of a worker, which stays with it; the ids are the same.
    With ``file_order``, which needs ``docs`` to be read from files, sequences follow the files' order.
    """
    spark = docs.sparkSession
    table = stored(encoded(docs, tokenizer=tokenizer, end_id=end_id, file_order=file_order, max_pieces=max_pieces, id_col=id_col, text_col=text_col), "encoded")
    unit = ["part", "file", "at"]
    totals = sorted((r["file"], r["at"], r["part"], r["n"]) for r in table.groupBy(*unit).agg(F.sum("n_tokens").alias("n")).collect())  # one row for each stretch that was read
    bases, whole = [], 0
    for file, at, part, n in totals:
        bases.append((part, file, at, whole, n))
        whole += n
    bases_df = F.broadcast(spark.createDataFrame(bases, "part int, file string, at long, base long, part_tokens long"))
    last = whole % capacity
    kind = table.schema["doc_id"].dataType
    fields = [("doc_id", kind), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("boundary", T.BooleanType()), ("padded_length", T.LongType())]
    fields += [("ids", T.BinaryType())] * with_ids
    schema = T.StructType([T.StructField(*x) for x in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(0), "i8")
            n = np.asarray(batch.column(1), "i8")
            base, size = np.asarray(batch.column(2), "i8"), np.asarray(batch.column(3), "i8")
            doc, start, length, crc, seq, cut = [], [], [], [], [], []
            for i, raw in enumerate(batch.column(5)):
                raw, g, end = raw.as_buffer(), int(at[i]), int(at[i] + n[i])
                while g < end:
                    stop = min(end, (g // capacity + 1) * capacity)
                    piece = raw[4 * (g - int(at[i])) : 4 * (stop - int(at[i]))]
                    doc.append(i)
                    start.append(g - int(at[i]))
                    length.append(stop - g)
                    crc.append(zlib.crc32(piece))
                    seq.append(g // capacity)
                    if with_ids:
                        cut.append(piece.to_pybytes())
                    g = stop
            doc, start, length, seq = (np.asarray(x, "i8") for x in (doc, start, length, seq))
            begins, ends = seq * capacity, np.minimum((seq + 1) * capacity, whole)
            full = np.where(ends - begins == capacity, capacity, capacity if last & (last - 1) else last)
            over = (begins < base[doc]) | (ends > base[doc] + size[doc])
            out = [batch.column(4).take(pa.array(doc)), start, length, np.asarray(crc, "i8"), n[doc], seq, at[doc] + start - begins, over, full]
            out = [x if isinstance(x, pa.Array) else pa.array(x) for x in out] + [pa.array(cut, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(out, [x for x, _ in fields])

    placed = table.join(bases_df, unit).select((F.col("base") + F.col("before")).alias("at"), "n_tokens", "base", "part_tokens", "doc_id", "ids")
    return placed.mapInArrow(run, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The packed sequences of ``pack(..., with_ids=True)``: at most ``capacity`` ids each, as little-endian uint32, in order."""
    return pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.max("padded_length").alias("padded_length")).select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"), "padded_length")
