"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

A data file is a run of records. Fixed format of a record: payload length as
little-endian uint64, masked checksum of those 8 bytes as uint32, the payload (a byte that
gives the width of an id, 2 or 4, then the ids in little-endian order; 2 wherever the
vocabulary allows), masked checksum of the payload as uint32. Checksums are CRC-32
(zlib), rotated right by 15 bits plus 0xa282ead8. An index file beside each data file
holds int64 triples: document id, place of its record, length of its payload. Any record
can be read by its triple alone; ``read`` uses whole files, ``read_at`` single triples.

Documents are ordered by id, then by a hash of the text, which also splits an id that
many rows share over several files. Null texts count as empty, null ids come first and
stand as the least int64 in the index. A file is written under a name of its task's
attempt and renamed when whole, so a repeated task leaves one good file. Columns other
than the two named are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import encoder

NO_ID = -(2**63)


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data, at: int = 0):
    """(payload, place after the record) at ``at``; ValueError if a checksum differs."""
    head = bytes(data[at : at + 8])
    (n,), (crc,) = struct.unpack("<Q", head), struct.unpack_from("<I", data, at + 8)
    if masked(head) != crc:
        raise ValueError(f"damaged record length at {at}")
    payload = data[at + 12 : at + 12 + n]
    if masked(payload) != struct.unpack_from("<I", data, at + 12 + n)[0]:
        raise ValueError(f"damaged record at {at}")
    return payload, at + 16 + n


def packed(ids: bytes, width: int) -> bytes:
    """The payload for ids given as little-endian uint32."""
    return bytes([width]) + (ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())


def unpacked(payload) -> bytes:
    """The ids of a payload as little-endian uint32."""
    return bytes(payload[1:]) if payload[0] == 4 else np.frombuffer(payload, "<u2", offset=1).astype("<u4").tobytes()


def write(docs: DataFrame, path: str, *, tokenizer: str, end_id: int | None = 1, files: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write files under ``path``, a folder that all executors reach. Returns the manifest: one row for each file, in order."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = (rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    tail = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get(), encoder(tokenizer)
        width = 2 if enc.size <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
        fs, root = pafs.FileSystem.from_uri(path)
        name, own = f"part-{task.partitionId():06d}", f"-attempt{task.taskAttemptId()}"
        out, places, at, n_ids = None, [], 0, 0
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}.bin{own}")
                for doc_id, payload in zip(some.column(0).to_pylist(), enc.ids(some.column(1).to_pylist())):
                    payload = packed(payload + tail, width)
                    record = frame(payload)
                    out.write(record)
                    places.append((NO_ID if doc_id is None else doc_id, at, len(payload)))
                    at, n_ids = at + len(record), n_ids + len(payload) // width
        if out is None:
            return
        out.close()
        with fs.open_output_stream(f"{root}/{name}.idx{own}") as index:
            index.write(np.asarray(places, "<i8").tobytes())
        for kind in ("bin", "idx"):
            fs.move(f"{root}/{name}.{kind}{own}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "file": f"{path}/{name}", "records": len(places), "n_tokens": n_ids, "bytes": at}])

    found = ordered.mapInArrow(run, "part long, file string, records long, n_tokens long, bytes long").collect()  # one row for each file
    spark, start, manifest = docs.sparkSession, 0, []
    for r in sorted(found, key=lambda r: r["part"]):
        manifest.append((r["part"], r["file"], r["records"], r["n_tokens"], r["bytes"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(manifest, "part long, file string, records long, n_tokens long, bytes long, first_token long")


def read(spark: SparkSession, manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """Read whole files back, checking every record: doc_id, start, n_tokens, ids_crc32 and, if asked, the ids."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = pafs.FileSystem.from_uri(row["file"])
                with fs.open_input_stream(f"{at}.idx") as f:
                    places = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
                start = row["first_token"]
                with fs.open_input_stream(f"{at}.bin", buffer_size=1 << 20) as f:
                    for k in range(0, len(places), 1000):
                        some, crcs, ids, n = places[k : k + 1000], [], [], []
                        for _, _, size in some.tolist():
                            payload, _ = unframe(f.read(size + 16))
                            if len(payload) != size:
                                raise ValueError(f"{at}.idx disagrees with its data")
                            own = unpacked(payload)
                            crcs.append(zlib.crc32(own))
                            n.append(len(own) // 4)
                            ids += [own] * with_ids
                        n = np.asarray(n, "i8")
                        out = [pa.array(some[:, 0], mask=some[:, 0] == NO_ID), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crcs, pa.int64())]
                        start += int(n.sum())
                        yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names)

    parts = manifest.select("part", "file", "first_token")
    n = max(1, manifest.count())
    return parts.repartition(n, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def read_at(file: str, place: int, length: int) -> bytes:
    """The ids of one record, as little-endian uint32, by its index entry."""
    fs, at = pafs.FileSystem.from_uri(file)
    with fs.open_input_file(f"{at}.bin") as f:
        f.seek(place)
        return unpacked(unframe(f.read(length + 16))[0])
