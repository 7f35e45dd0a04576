"""The pipeline stage by stage on odd rows, its run on a small corpus against plain loops, and the queries of all operators."""

import os
import zlib

import pytest

pytest.importorskip("millrace.llm")

import corpus_pipeline as cp  # noqa: E402
import duckdb  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import entries, language  # noqa: E402
from millrace.llm.encoding import tokenizer_path  # noqa: E402

from .test_pair_ops import expected, similarity  # noqa: E402
from .test_text_ops import base_spans, contextual  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """120 real documents, near copies, odd rows; as documents.parquet."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").limit(120).collect()
    rows = [tuple(r) for r in real]
    long = max((r[1] for r in rows if r[1]), key=len)
    rows += [(5000, long + " and one more word", "en", "web", 1), (5001, None, None, None, None), (5002, "", "en", None, 0), (5003, "12 34", "en", "web", 5), rows[3], (None, rows[4][1], "en", "web", 9), (5004, "call +1 (743) 555-3824 now " + rows[5][1], "en", None, 3)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def odd(spark):
    rows = [(1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (None, "no id here at all", "en", None, 17, 1), (3, "w " * 20000, "en", "a", 40000, 1), (4, "same same words in here", "en", "b", 9, 1), (4, "same same words in here", "en", "b", 9, 1), (6, "same same words in here", None, "b", 9, 1), (7, "...", "de", "b", 3, 1)]
    return spark.createDataFrame(rows, SCHEMA + ", row int").withColumn("key", F.lit("x")).withColumn("id", F.lit(0)).withColumn("lang_pred", F.lit("x"))


def test_stages_on_odd_and_empty_tables(spark):
    docs = odd(spark)
    assert [n for n, _ in cp.STAGES] == ["language ID", "MinHash near-dedup", "PII", "mixing", "packing"]
    for k, (_, stage) in enumerate(cp.STAGES):
        got = stage(spark, docs, "")
        rows = got.collect()
        if k < 4:
            assert got.columns == cp.COLUMNS
        ids = sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)
        if k == 0:
            assert not {1, 2, 7} & set(ids)
        if k == 1:
            assert ids == [-1, 1, 2, 3, 4, 4, 7]
        if k == 2:
            assert ids == [-1, 1, 2, 3, 4, 4, 6, 7] and [r["n_chars"] for r in rows if r["doc_id"] == 1] == [None]
        if k == 3:
            assert set(ids) == {-1, 1, 2, 3, 4, 6, 7}
        if k == 4:
            assert sum(r["length"] for r in rows) == sum({(r["doc_id"], i): r["doc_tokens"] for i, r in enumerate(rows) if r["start"] == 0}.values())
        assert stage(spark, docs.where("false"), "").count() == 0


def test_run_equals_plain_loops(spark, corpus):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    judge = language.Judge(model)
    rows = [r for r in docs.collect() if judge(r["text"])[2]]
    some = sorted((r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None)
    ids = sorted({i for i, _ in some})
    texts = [dict(some)[i] for i in ids]
    sim, bags = similarity([t for _, t in some] + [r["text"] for r in rows if r["doc_id"] is None])
    own_sim, _ = similarity(texts)
    group = expected(ids, texts, own_sim, similarity(texts)[1])
    kept = [r for r in rows if r["doc_id"] is None or group[r["doc_id"]] == r["doc_id"]]
    context = contextual([r["text"] for r in kept])
    clean = []
    for k, r in enumerate(kept):
        spans = [(s, e, kind.upper()) for s, _, e, kind in base_spans(r["text"])] + [(int(s), int(e), "CONTEXT") for _, s, e in (x.split(":") for x in context.get(k, ()))]
        text, end, out = r["text"], 0, []
        for s, e, kind in sorted(spans):
            if s >= end:
                out += [text[end:s], f"[{kind}]"]
            end = max(end, e)
        clean.append((r["doc_id"], "".join(out) + text[end:]))
    whole = Tokenizer.from_file(tokenizer_path(entries.WORD_BPE))
    tokens = {(d, len(whole.encode(t, add_special_tokens=False).ids) + 1) for d, t in clean}
    pieces = cp.run(spark, corpus).collect()
    uses = [(p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0]
    assert set(uses) == tokens  # every clean document, and no other
    assert all(1 <= uses.count(u) <= 2 * sum((d, n) == u for (d, _), n in zip(clean, [u[1]] * len(clean))) for u in set(uses))
    assert sum(p["length"] for p in pieces) == sum(n for _, n in uses)
    ends = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends.get(p["sequence_id"], 0)
        ends[p["sequence_id"]] = p["offset"] + p["length"]
    assert all(n == 2048 for k, n in ends.items() if k != max(ends))


@pytest.mark.parametrize("name", sorted(entries.queries()))
def test_queries(spark, sf, name):
    """Each query over its whole table, against SQL where there is some."""
    got = entries.queries()[name](spark, sf)
    rows = got.collect()
    assert len(rows) > 0
    if name in entries.SQL:
        con = duckdb.connect()
        for t in ("embeddings", "conversations", "documents"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        want = con.execute(entries.SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r[n] for n in names)) for r in rows)
    elif name != "op1_temperature_mixing":
        n = spark.read.parquet(f"{sf}/documents.parquet").count()
        assert (len({r["doc_id"] for r in rows}) if name == "op10_packing" else len(rows)) == n
    if name == "op7_language_id":
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)


def test_tables_go_when_the_driver_ends(spark):
    from millrace.llm.common import Scratch, shared_dir

    work = Scratch(spark)
    a, b = work.stored(spark.range(3), "a"), work.stored(spark.range(4), "b")
    paths = [p for _, p in work.paths.values()]
    work.drop(a)
    left = os.listdir(shared_dir(spark).removeprefix("file:"))
    assert a.count() == 3 and [os.path.basename(p) in left for p in paths] == [True, False]


def test_stages_bound_batches_and_caches(spark):
    """Texts go to Python in small batches, and a bounded cache gives the same ids."""
    import corpus_pipeline
    from millrace.llm import packing

    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, bytes_before = spark.conf.get(rows), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set(rows, "0")
        corpus_pipeline.small_batches(spark)
        assert int(spark.conf.get(rows)) == corpus_pipeline.BATCH_ROWS
        spark.conf.set(rows, "7")
        corpus_pipeline.small_batches(spark)
        assert int(spark.conf.get(rows)) == 7
    finally:
        spark.conf.set(rows, before)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bytes_before)
    docs = spark.createDataFrame([(i, f"word{i} some other words {i * i} café") for i in range(40)], "doc_id long, text string").coalesce(1)
    take = lambda **o: sorted(map(tuple, packing.pack(docs, tokenizer=corpus_pipeline.tokenizer_path(corpus_pipeline.entries.WORD_BPE), **o).collect()))
    assert take(max_pieces=3) == take()
