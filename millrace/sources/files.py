"""Readers and writers by file name."""

from __future__ import annotations

import csv
import os
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

KINDS = {"csv": "csv", "tsv": "csv", "txt": "csv", "parquet": "parquet", "pq": "parquet", "json": "json", "jsonl": "json", "ndjson": "json", "orc": "orc", "xls": "excel", "xlsx": "excel"}


def detect_format(path: str) -> str:
    """By extension; what is unknown is read as CSV."""
    return KINDS.get(os.path.splitext(path.split("?")[0].rstrip("/"))[1].lstrip(".").lower(), "csv")


def sniff_separator(spark: SparkSession, path: str) -> str:
    """From the first lines, read by Spark, so any store will do."""
    head = "\n".join(r["value"] for r in spark.read.text(path).limit(20).collect())[:4096]
    try:
        return csv.Sniffer().sniff(head, ",;\t|").delimiter
    except csv.Error:
        return ","


def load_csv(spark: SparkSession, path: str, sep: str | None = None, schema=None, **options) -> DataFrame:
    """With a schema there is one pass; without, Spark infers types in another."""
    reader = spark.read.options(header=True, sep=sep or sniff_separator(spark, path), **options)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A document or array of records, or a record a line: whichever gives rows that can be read."""
    def reader():
        return spark.read.schema(schema) if schema else spark.read

    head = [r["value"].strip() for r in spark.read.text(path).limit(2).collect()]
    if path.endswith(("jsonl", "ndjson")) or len(head) > 1 and all(x.startswith("{") and x.endswith("}") for x in head):
        return reader().json(path)
    whole = reader().option("multiLine", True).json(path)
    return reader().json(path) if whole.columns == ["_corrupt_record"] else whole


def load_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ImportError("reading Excel files needs openpyxl") from e
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet))


def load_any(spark: SparkSession, path: str, **options) -> DataFrame:
    kind = detect_format(path)
    if kind == "orc":
        return spark.read.orc(path)
    return {"csv": load_csv, "parquet": load_parquet, "json": load_json, "excel": load_excel}[kind](spark, path, **options)


def load_url(spark: SparkSession, url: str) -> DataFrame:
    """Fetched to the driver, then spread by a distributed file, so that executors needn't see the driver's disk."""
    with urllib.request.urlopen(url) as r:  # noqa: S310
        raw = r.read()
    kind = detect_format(url)
    if kind == "parquet":
        import io

        import pandas as pd

        return spark.createDataFrame(pd.read_parquet(io.BytesIO(raw)))
    lines = spark.sparkContext.parallelize(raw.decode("utf-8").splitlines())
    if kind == "json":
        return spark.read.json(lines if url.endswith(("jsonl", "ndjson")) else spark.sparkContext.parallelize([raw.decode("utf-8")]))
    return spark.read.option("header", True).option("inferSchema", True).csv(lines)


def chunked_csv(spark: SparkSession, path: str, chunksize: int = 10_000, **options) -> Iterator[list]:
    """Rows in lists of ``chunksize``; the driver holds one partition at a time."""
    chunk = []
    for row in load_csv(spark, path, **options).toLocalIterator(prefetchPartitions=True):
        chunk.append(row)
        if len(chunk) == chunksize:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def save_dataset(df: DataFrame, path: str, *, mode: str = "overwrite", single: bool = False) -> None:
    """A folder of part files by the extension; one part if ``single``."""
    kind = detect_format(path)
    out = (df.coalesce(1) if single else df).write.mode(mode)
    if kind == "excel":
        raise ValueError("Excel files are written one by one: collect a bounded result and use pandas")
    if kind == "csv":
        out.option("header", True).csv(path)
    else:
        getattr(out, kind)(path)


