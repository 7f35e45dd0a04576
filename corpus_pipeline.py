"""A corpus made ready for training: five stages, each over all that the one before it kept.

``STAGES`` lists them; ``run`` applies them to a folder's documents, writing each stage's
rows as a table in the shared folder. Stages but the last return the columns of documents.

Every stage takes null ids, texts, languages and sources, empty and very long texts,
repeated rows and empty tables (which give no rows), and drops columns that aren't those
of documents, whatever their names. What becomes of such rows is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import entries, language, mixing, near_dup, packing, pii
from millrace.llm.common import stored
from millrace.llm.encoding import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Most rows and bytes of a batch of texts on its way to Python and back. Executors and workers hold several such batches beside a full heap, so the session keeps this setting.
BATCH_ROWS, BATCH_BYTES = 1024, "8m"
#: Distinct pieces whose tokens a worker keeps: workers live through all stages.
PIECES = 150_000


def small_batches(spark: SparkSession) -> None:
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(rows, BATCH_ROWS) if rows > 0 else BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with some margin, under that language; learnt from those that aren't held out.

    Null texts and those without letters go, as do narrow margins. A null id counts as not held out; a null lang teaches nothing.
    """
    small_batches(spark)
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    told = language.identify(docs.select(*COLUMNS), model, keep=COLUMNS)
    return told.where("accepted").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id.

    Rows without an id or without words stay. Rows that repeat an id and text stand and fall together; an id with two texts stands for both.
    """
    small_batches(spark)
    return near_dup.one_of_each(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind. Null texts stay null, and so does their number of characters."""
    return pii.masked(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once; small sources repeated towards the target weights. Rows come in the order of the mix: files by name, and rows in them.

    A null source is a source; documents without tokens come with each whole epoch of theirs.
    """
    mixed = mixing.mix(docs.select(*COLUMNS), max_repeats=entries.MAX_REPEATS)
    order = ["mix_order", "mix_block", "mix_place"]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).select(*COLUMNS)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 2048 tokens, in the order of the mix. A null or empty text is its end token."""
    small_batches(spark)
    return packing.pack(docs, tokenizer=tokenizer_path(entries.WORD_BPE), file_order=True, max_pieces=PIECES)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", minhash_near_dedup),
    ("PII", personal_data),
    ("mixing", source_mixing),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs


#: SQL has neither compression dictionaries nor tokenizers.
ORACLE_SQL = None
