"""Language by compression: the dictionary of a text's own language compresses it best.

``fit`` takes, of each labelled language, a bounded sample of whole texts (the first in
the order of a hash of the id) as raw-content dictionary. ``identify`` compresses every
block of a whole text (its letters, in lower case) with each dictionary; the language with the least total wins, and
the margin to the second tells how sure that is. Texts that are null or have no letter
get ``und``; those and narrow margins are not accepted. Ties go to the first language in
alphabetical order. With nothing to learn from, all is ``und``. Rows without a language
teach nothing; rows repeated or with clashing columns are handled as they stand.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bounds of the sample, for each language: texts, bytes of a text, bytes of the dictionary.
SAMPLE_TEXTS, SAMPLE_TEXT_BYTES, DICTIONARY_BYTES = 96, 16_384, 65_536
#: Bytes of a text that are compressed at once.
BLOCK = 1_024
#: Least share by which the best language must undercut the second.
MARGIN = 0.005
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The text in lower case, with a space for each run of what is no letter."""
    return OTHER.sub(" ", text.lower()).encode()


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """Dictionaries by language. Each task keeps the least hashes of each language before anything is shuffled."""
    rows = labelled.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.octet_length("text") <= SAMPLE_TEXT_BYTES))
    keyed = rows.select("lang", F.xxhash64("id", "text").alias("h"))
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("n") <= SAMPLE_TEXTS).select("lang", "h")
    found: dict[str, dict[int, str]] = {}
    for r in rows.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(first.distinct()), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "h", "text").toLocalIterator():
        found.setdefault(r["lang"], {})[r["h"]] = r["text"]
    out = {}
    for lang, texts in sorted(found.items()):
        whole, size = [], 0
        for _, text in sorted(texts.items()):
            raw = letters(text)
            if size + len(raw) <= DICTIONARY_BYTES:
                whole.append(raw)
                size += len(raw) + 1
        out[lang] = b"\n".join(whole)
    return out


class Judge:
    """Compressors of all languages; ``judge(text)`` gives (language, score, accepted)."""

    def __init__(self, dictionaries: dict[str, bytes], margin: float = MARGIN, level: int = 9) -> None:
        import zstandard as z

        self.langs, self.margin, self.size = list(dictionaries), margin, []
        for raw in dictionaries.values():
            params = z.ZstdCompressionParameters.from_level(level, source_size=BLOCK, dict_size=len(raw), min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            held = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            self.size.append(z.ZstdCompressor(dict_data=held, compression_params=params).compress)

    def sizes(self, raw: bytes) -> list[int]:
        """Compressed bytes of the whole text by language."""
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(x) for x in map(size, blocks)) for size in self.size]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, False
        sizes = np.asarray(self.sizes(letters(text)), float)
        best = int(sizes.argmin())
        if len(sizes) == 1:
            return self.langs[0], 1.0, True
        second = float(np.delete(sizes, best).min())
        score = (second - float(sizes[best])) / second
        return self.langs[best], score, score >= self.margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], *, text_col: str = "text", keep: list[str] | None = None, margin: float = MARGIN) -> DataFrame:
    """The kept columns with lang_pred, score and accepted; only the text is looked at. The names must be free in ``keep``."""
    keep = docs.columns if keep is None else keep
    rows = docs.select(F.col(f"`{text_col}`").alias("judged"), F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(held.value, margin)
        for batch in batches:
            got = [judge(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), pa.array([x[2] for x in got], pa.bool_())], ["row", "lang_pred", "score", "accepted"])

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return rows.mapInArrow(run, schema).select("row.*", "lang_pred", "score", "accepted")


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))
