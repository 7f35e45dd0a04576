"""Operators on texts against brute force in Python, on whole small tables and on odd rows."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import regex

pytest.importorskip("millrace.llm")

from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import chat, entries, language, mixing, packing, pii, records, token_cache  # noqa: E402
from millrace.llm.common import shared_dir  # noqa: E402
from millrace.llm.encoding import TextEncoder, tokenizer_path  # noqa: E402

ODD = [None, "", " ", "  a", "a  b", "a\n\nb", "a \n b", "x ", "it's the'll 's <|endoftext|> q", "É İstanbul ΣΑΣ ς", "a\tb", "tilde ~ x~y", "don't, 'tis 12,345.67!? ok...", "\na\n", "日本語 テスト, 한국어.", "\x1c x", "w" * 5000, "same text here", "same text here"]
DOCS = "doc_id long, text string, lang string, source string, clash string"


def odd_docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "s", "z") for i, t in enumerate(ODD)] + [(5, ODD[5], "en", "s", "z")]
    return spark.createDataFrame(rows, DOCS)


def real_docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    whole = library(name)
    rng = random.Random(3)
    made = ["".join(rng.choice(["a", "B", " ", "\n", "é", "'s", ",", ".", "12", "~", "漢", "́", "ß", "Ü"]) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts = [x for x in ODD if x is not None] + made
    for size in (10, 600_000):  # a cache that overflows, and one that doesn't
        enc = TextEncoder(tokenizer_path(name), max_pieces=size)
        got = [np.frombuffer(x, "<u4").tolist() for k in range(0, len(texts), 100) for x in enc.ids(texts[k : k + 100])]
        assert got == [whole(x) for x in texts]
        counts = TextEncoder(tokenizer_path(name), max_pieces=size, count_only=True)
        assert [x for k in range(0, len(texts), 100) for x in counts.ids(texts[k : k + 100])] == [len(x) for x in got]


def expected_ids(docs):
    whole = library(entries.WORD_BPE)
    return [(r["doc_id"], np.asarray([*whole(r["text"] or ""), 1], "<u4")) for r in docs.collect()]


@pytest.mark.parametrize("kind", ["odd", "real", "empty"])
def test_records_round_trip(spark, sf, tmp_path, kind):
    docs = real_docs(spark, sf) if kind == "real" else odd_docs(spark).where("true" if kind == "odd" else "false")
    manifest = records.write(docs, f"file://{tmp_path}/r", tokenizer=tokenizer_path(entries.WORD_BPE), files=3)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"]) for r in records.read(spark, manifest).collect()), key=lambda r: r[1])
    want = sorted(((-1 if d is None else d, len(x), zlib.crc32(x.tobytes())) for d, x in expected_ids(docs)))
    assert sorted((d, n, c) for d, _, n, c in got) == want
    assert [d for d, *_ in got] == sorted(d for d, *_ in got)
    assert [s for _, s, _, _ in got] == np.cumsum([0, *[n for _, _, n, _ in got]]).tolist()[: len(got)]
    for r in manifest.collect():
        index = np.fromfile(r["file"].removeprefix("file://") + ".idx", "<i8").reshape(-1, 3)
        _, at, n = index[len(index) // 2].tolist()
        assert len(records.read_at(r["file"], at, n)) // 4 == (n - 1) // 2


def test_damaged_record_is_seen():
    raw = bytearray(records.frame(b"some payload"))
    assert records.unframe(bytes(raw))[0] == b"some payload"
    raw[14] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(raw))


@pytest.mark.parametrize("kind", ["odd", "real", "empty"])
def test_packing(spark, sf, kind):
    docs = (real_docs(spark, sf).repartition(5) if kind == "real" else odd_docs(spark).where("true" if kind == "odd" else "false")).withColumn("u", F.lit(1))
    cap = 64 if kind == "odd" else 2048
    pieces = packing.pack(docs, tokenizer=tokenizer_path(entries.WORD_BPE), capacity=cap, with_ids=True).collect()
    want = sorted((-1 if d is None else d, x.tobytes()) for d, x in expected_ids(docs))
    seqs = {}
    for p in pieces:
        assert zlib.crc32(p["ids"]) == p["ids_crc32"] and len(p["ids"]) == 4 * p["length"]
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for k, parts in seqs.items():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) == cap or k == max(seqs)
    whole = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
    back, left = [], 0
    for p in whole:
        if left == 0:
            assert p["start"] == 0
            back.append([-1 if p["doc_id"] is None else p["doc_id"], b""])
            left = p["doc_tokens"]
        back[-1][1] += p["ids"]
        left -= p["length"]
    assert left == 0 and sorted(map(tuple, back)) == want


def test_token_counts_and_cache(spark, tmp_path):
    whole = library(entries.BYTE_BPE)
    docs, cache = odd_docs(spark), f"file://{tmp_path}/cache"
    run = lambda d: token_cache.token_counts(d, cache, tokenizer=tokenizer_path(entries.BYTE_BPE), limit=3)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()), len(whole(r["text"] or ""))) for r in docs.collect())
    first = run(docs).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in first) == want
    assert not any(r["hit"] for r in first) and all(r["over_limit"] == (r["n_tokens"] > 3) for r in first)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({r["text"] or "" for r in docs.collect()})
    more = docs.limit(4).union(spark.createDataFrame([(99, "quite new", "en", "s", "z")], DOCS))
    again = {r["doc_id"]: r for r in run(more).collect()}
    assert not again[99]["hit"] and again[0]["hit"] and stored.count() == spark.read.parquet(cache).count() - 1
    assert run(docs.where("false")).count() == 0


def test_language(spark, sf):
    docs = real_docs(spark, "/root/testdata/sf0.01")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    assert sorted(model) == ["de", "en", "es", "fr"] and all(len(x) <= language.DICTIONARY_BYTES for x in model.values())
    rows = language.identify(docs.where(language.held_out(F.col("doc_id"))), model).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.95
    got = {r["doc_id"]: r for r in language.identify(odd_docs(spark), model, keep=["doc_id", "lang", "clash"]).collect()}
    assert got[0]["lang_pred"] == got[1]["lang_pred"] == "und" and not got[0]["accepted"]
    assert language.fit(docs.where("false")) == {}
    assert {r["lang_pred"] for r in language.identify(docs.limit(3), {}).collect()} == {"und"}
    assert language.identify(docs.where("false"), model).count() == 0


def base_spans(text):
    out = []
    for rank, (kind, p) in enumerate(pii.BASE.items()):
        for m in re.finditer(p, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None, "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


PII_ODD = ["a@b.c_x@d.e", "@a.b a@b a@b.c.d@e.f ..@x.y", "1.2.3.4.5.6.7.8 300.1.1.1 001.002.003.0004", "😀 +1 (743) 555-3824 é x+1 2", "4111 1111 1111 1111 4111-1111-1111-1112", "0" * 40, "4" * 3000 + " a" * 3000, "a" * 20000, "+" * 50 + "123456789012", "1.1.1.1" * 300, "4111111111111111 4111111111111111,x@y.zz", "x@y.z\n+44 20 7946 0958-", "000000000000000000001.2.3.4"]


def test_pii_base_equals_plain_expressions(spark, sf):
    rng = random.Random(5)
    bits = ["@", ".", "a", "1", "25", " ", "-", "+", "(", ")", "300", "x@y.z", "4111111111111111", "_", "%", "é", "😀", "\n", "12345"]
    texts = ODD + PII_ODD + ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(800)]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, spans string, base string").union(real_docs(spark, sf).selectExpr("doc_id + 10000", "text", "'x'", "'y'"))
    source = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in pii.report(docs).collect():
        want = base_spans(source[r["doc_id"]])
        line = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest(), source[r["doc_id"]][:80]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[3] == k for x in want) for k in pii.BASE]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("context")] == [x for x in line.split(",") if x]
    assert pii.report(docs.where("false")).count() == 0


def contextual(texts):
    """The contextual spans of each text, by plain loops over all of them."""
    letters, label = regex.compile(r"\p{L}+"), regex.compile("[=:#]")
    places = []  # (text, start, end, token, seed, patterns)
    for at, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        found = list(regex.finditer(pii.TOKEN, text))
        for i, m in enumerate(found):
            start, end = m.span()
            while not (text[start] in "+(" or regex.match(r"[\p{L}\p{N}]", text[start])):
                start += 1
            while end > start and not regex.match(r"[\p{L}\p{N}]", text[end - 1]):
                end -= 1
            core = text[start:end]
            left = text[found[i - 1].end() if i else 0 : m.start()].lower()
            right = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)].lower()
            before, after = letters.findall(left), letters.findall(right)
            patterns = set()
            if before:
                signs = regex.sub(r"\s+", "", left[left.rindex(before[-1]) + len(before[-1]) :])
                if label.search(signs):
                    patterns.add(("label", before[-1], signs))
                elif len(before) > 1 or i:
                    patterns.add(("two", before[-2] if len(before) > 1 else "0", before[-1]))
                if after:
                    patterns.add(("round", before[-1], after[0]))
            shape = len(core) >= 20 and re.fullmatch("[A-Za-z0-9_]+", core) and len(re.findall("[0-9]", core)) >= 4 and len(re.findall("[A-Za-z]", core)) >= 4
            seed = 1.0 if any(s < end and start < e for s, _, e, _ in base) else pii.KEY if shape else 0.0
            places.append((at, start, end, core.lower(), seed, patterns))
    graph = {}
    for _, _, _, token, seed, patterns in places:
        for p in patterns:
            n, score = graph.get((p, token), (0, 0.0))
            graph[p, token] = n + 1, max(score, seed)
    score = {k: s for k, (_, s) in graph.items()}
    for _ in range(pii.ROUNDS):
        by = {}
        for (p, token), (n, _) in graph.items():
            by.setdefault(p, []).append((n, score[p, token]))
        conf = {p: sum(n * s for n, s in x) / sum(n for n, _ in x) for p, x in by.items() if sum(s >= pii.SURE for _, s in x) >= pii.LEAST_KNOWN}
        conf = {p: c for p, c in conf.items() if c >= pii.SURE}
        rest = {}
        for p, token in graph:
            if p in conf:
                rest[token] = rest.get(token, 1.0) * max(1 - conf[p], 1e-6)
        score = {(p, t): max(graph[p, t][1], 1 - rest.get(t, 1.0)) for p, t in graph}
    out = {}
    for at, start, end, _, seed, patterns in places:
        if seed < 1 and patterns & conf.keys():
            out.setdefault(at, set()).add(f"context:{start}:{end}")
    return out


def test_pii_context_equals_plain_loops(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "my", "number", "is", "é", "card", "of", "ID", "page", "Straße", "user", "to"])
    thing = [lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}", lambda: f"u{rng.randrange(99)}@mail.example.com", lambda: f"0{rng.randrange(100, 999)} {rng.randrange(100, 999)} {rng.randrange(1000, 9999)}", lambda: f"EMP-{rng.randrange(10**5)}", lambda: str(rng.randrange(30)), lambda: "%040x" % rng.getrandbits(160), lambda: f"(743) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}"]
    lead = [["my", "number"], ["card", "#"], ["token", "="], ["user", "ID", ":"], ["on", "page"], []]
    texts = []
    for _ in range(700):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            k = rng.randrange(len(lead))
            parts += [word() for _ in range(rng.randrange(4))] + lead[k] + [rng.choice(['"', "", "("]) + thing[rng.choice([0, 1, 5] * 8 + [2, 3, 6] if k < 3 else [4, 4, 4, 3, 2, 0] if k == 4 else range(7))]() + rng.choice(['"', "", ",", "!!", "."])]
        texts.append(" ".join(parts + [word() for _ in range(rng.randrange(3))]))
    texts += ODD + PII_ODD + [texts[0], texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: {x for x in r["spans"].split(",") if x.startswith("context")} for r in pii.report(docs).collect()}
    want = contextual(texts)
    assert len(want) > 50
    assert {k: v for k, v in got.items() if v} == want


def test_pii_context_of_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    want = contextual([r["text"] for r in rows])
    got = pii.report(docs).collect()
    assert sum(map(len, want.values())) > 10
    assert {r["doc_id"]: {x for x in r["spans"].split(",") if x.startswith("context")} for r in got if r["n_context"]} == {rows[k]["doc_id"]: v for k, v in want.items()}


@pytest.mark.parametrize("heavy", [1, 1000])
def test_pii_context_discovers(spark, monkeypatch, heavy):
    monkeypatch.setattr("millrace.llm.common.FEW", 1)
    monkeypatch.setattr("millrace.llm.common.HEAVY", heavy)  # 1: every key is shuffled; 1000: those that hold much are broadcast
    seeds = [f"please write to me under my number +1 (743) 555-38{i:02d} soon" for i in range(60)]
    tokens = ["0743/5553824", "123-456-789", "06-12-34-56-78", "AB12-34-56", "0743 555 3824", "(743) 555-3824", "743 555"]
    texts = seeds + [f"please write to me under my number {t} soon" for t in tokens] + ["in the year 20240101 there was my dog 12345678", None, "", "my" + " " * 300 + "number 4711", "x" * 400 + " my number 4712"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(60, texts[60], "z")], "doc_id long, text string, row string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(docs.repartition(3)).collect()}
    at = len("please write to me under my number ")
    assert [got[60 + i] for i in range(7)] == [f"context:{at}:{at + len(t)}" for t in tokens]
    assert [got[67 + i] for i in range(3)] == ["", "", ""] and got[70] == "context:309:313" and got[71] == "context:411:415"
    found = pii.masked(docs)
    assert found.columns == docs.columns
    clean = {r["doc_id"]: r["text"] for r in found.collect()}
    assert [clean[60 + i] for i in range(7)] == ["please write to me under my number [CONTEXT] soon"] * 7
    assert clean[0] == seeds[0].replace("+1 (743) 555-3800", "[PHONE]") and clean[68] is None and clean[67] == texts[67]
    assert pii.masked(docs.where("false")).count() == 0


def test_pii_leaves_no_texts_behind(spark):
    """Tables that stay until the driver ends hold spans, not texts; contextual spans are still found, in copies too."""
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = [f"{noise(20_000)} under my number {x} {noise(50)}" for x in [*[f"+1 (743) 555-38{i:02d}" for i in range(20)], "0743/5553824", "no 1"]]
    texts.append(texts[-2])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    found = pii.masked(docs)
    left = [os.path.join(at, x) for new in set(os.listdir(folder)) - before for at, _, names in os.walk(os.path.join(folder, new)) for x in names]
    assert left and sum(map(os.path.getsize, left)) < 0.1 * sum(map(len, texts))
    clean = {r["doc_id"]: r["text"] for r in found.collect()}
    assert [clean[i] for i in range(20)] == [re.sub(r"\+1 \(743\) 555-38..", "[PHONE]", t) for t in texts[:20]]
    assert clean[20] == clean[22] == texts[20].replace("0743/5553824", "[CONTEXT]") and clean[21] == texts[21]


def conversations(spark, sf):
    rng = random.Random(1)
    bits = ["\\", "#", "###", "</turn>", "<turn/>", "\\h", "\\e", "\n", ": ", "a", "é", "\\\\", "### user: ", "\\c", "\\t"]
    rows = [(c, t, rng.choice(["user", "assistant", "a:b", "", None, "### x"]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))]), "z") for c in range(120) for t in range(rng.randrange(1, 9))]
    rows += [(500, 1, "user", "twice", "z")] * 2 + [(None, None, None, None, None), (501, 1, "user", None, "z")] + [(502, i, "assistant" if i % 3 else "user", f"t{i}", "z") for i in range(700)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, clash string")


def test_chat_round_trip(spark, sf):
    rows = conversations(spark, sf)
    groups = {}
    for r in rows.collect():
        groups.setdefault(r["conv_id"], []).append((r["turn"] if r["turn"] is not None else -1, r["role"] or "", r["text"] or ""))
    chats = chat.formatted(rows)
    got = {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    assert got.keys() == groups.keys()
    for k, turns in groups.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        assert got[k]["n_turns"] == len(turns)
        assert got[k]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(), turns
        assert (got[k]["loss_chars"], got[k]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    text = chats.where("conv_id = 502").first()["formatted"]
    assert text.count("### assistant: ") == 233 and text.count("<turn/>") == 233  # adjacent turns are one message
    assert chat.formatted(rows.where("false")).count() == 0


def mixed_by_hand(rows, keys, *, budget, exponent, block_tokens):
    """(id, epoch) of every use, by the definition: whole epochs, then the last one's blocks and rows while they fit."""
    n, by = {}, {}
    for at, (_, text, source, *_) in enumerate(rows):
        n[source] = n.get(source, 0) + len((text or "").split())
        by.setdefault(source, []).append(at)
    whole = sum(n.values())
    raw = {s: (x / whole) ** exponent for s, x in n.items() if x}
    weight = {s: x / sum(raw.values()) for s, x in raw.items()}
    budget = max(n[s] / weight[s] for s in weight) if budget is None else budget
    out = []
    for s, members in by.items():
        e = budget * weight[s] / n[s] if n[s] else 1.0
        e = round(e) if abs(e - round(e)) < 1e-9 else e
        out += [(rows[at][0], k) for at in members for k in range(int(e))]
        rest, blocks = round((e - int(e)) * n[s]), max(1, -(-n[s] // block_tokens))
        placed = sorted((keys[at][int(e)], len((rows[at][1] or "").split()), at) for at in members)
        block = [int((k % 2**64 >> 11) / 2**53 * blocks) for k, _, _ in placed]
        full = 0
        for b in range(blocks):
            mine = sorted(x for x, y in zip(placed, block) if y == b)
            held = sum(x[1] for x in mine)
            if not rest or full + held <= rest:
                out += [(rows[x[2]][0], int(e)) for x in mine if rest]
                full += held
                continue
            for k in sorted({x[0] for x in mine}):  # rows of equal keys together
                full += sum(x[1] for x in mine if x[0] == k)
                if full > rest:
                    break
                out += [(rows[x[2]][0], int(e)) for x in mine if x[0] == k]
            break
    return sorted(out, key=str), n, weight, budget


MIXED = "doc_id long, text string, source string, mix_epoch int, n string, row int"


@pytest.mark.parametrize("budget,exponent,heavy", [(None, 0.3, 1000), (3000, 0.5, 2), (9000, 0.0, 1000), (500, 1.0, 1000)])
def test_mixing_equals_plain_loops(spark, monkeypatch, budget, exponent, heavy):
    monkeypatch.setattr("millrace.llm.common.FEW", 1)
    monkeypatch.setattr("millrace.llm.common.HEAVY", heavy)
    monkeypatch.setattr(mixing, "SPAN", 4)
    rows = [(i, "w " * (1 + i % 7), "big" if i < 700 else "small" if i < 790 else None, 5, "a", 1) for i in range(800)] + [(1000, None, "none", 5, "a", 1), (5, "w " * 6, "big", 5, "a", 1), (None, "very long " * 300, "small", 5, "a", 1)]
    docs = spark.createDataFrame(rows, MIXED)
    hashes = docs.withColumn("h", F.xxhash64(F.lit(mixing.SEED), "source", "doc_id", "text")).select(F.array(*[F.xxhash64(F.lit(e), "h") for e in range(120)])).collect()
    want, n, weight, budget_ = mixed_by_hand(rows, [r[0] for r in hashes], budget=budget, exponent=exponent, block_tokens=40)
    got = mixing.mix(docs.repartition(3), budget=budget, exponent=exponent, block_tokens=40)
    assert {"mix_epoch", "mix_epoch_", "mix_order", "mix_place", "mix_tokens", "n", "row"} <= set(got.columns)
    got = got.collect()
    assert sorted(((r["doc_id"], r["mix_epoch_"]) for r in got), key=str) == want
    for s in weight:  # each source's tokens are its weight's share of the budget, up to a document
        have = sum(r["mix_tokens"] for r in got if r["source"] == s)
        assert budget_ * weight[s] - 610 <= have <= budget_ * weight[s] + 0.5
    blocks = {}
    for r in got:
        blocks.setdefault((r["source"], r["mix_epoch_"], r["mix_block"]), []).append(r["mix_order"])
    assert all(len(set(x)) == 1 and x[0] >= 0 for x in blocks.values())
    assert mixing.mix(docs.where("false"), budget=budget, exponent=exponent).count() == 0


def test_mixing_order_spreads_sources(spark):
    rows = [(i, "w " * 5, "big" if i % 4 else "small") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), exponent=1.0, block_tokens=100).orderBy("mix_order", "mix_block", "mix_place").collect()
    assert len(got) == 4000
    for at in range(0, 4000, 400):  # any stretch has about the weights of the whole
        assert 60 <= sum(r["source"] == "small" for r in got[at : at + 400]) <= 140


def test_mixing_exponent(spark):
    def sources(tokens):
        return mixing.Sources(spark.createDataFrame(list(tokens.items()), "s string, n long"))

    tokens = {"a": 1000, "b": 100, "c": 10, "d": 0}
    made = sources(tokens)

    def entropy(a):
        raw = [(n / 1110) ** a for n in tokens.values() if n]
        return -sum(x / sum(raw) * math.log(x / sum(raw)) for x in raw)

    e = mixing.exponent_for(made, target_entropy=1.0)
    assert abs(entropy(e) - 1.0) < 1e-9
    assert mixing.exponent_for(made, target_entropy=5.0) == 0.0 and mixing.exponent_for(made, target_entropy=0.0) == 1.0
    assert (100.0 ** (1 - mixing.exponent_for(made, max_repeats=3.0))) == pytest.approx(3.0, abs=1e-6)  # the largest source once, the smallest three times
    a = mixing.exponent_for(made, max_repeats=20.0, budget=2000)
    raw = {s: (n / 1110) ** a for s, n in tokens.items() if n}
    assert max(2000 * x / sum(raw.values()) / tokens[s] for s, x in raw.items()) == pytest.approx(20.0, abs=1e-6)
    assert mixing.exponent_for(sources({"a": 0}), max_repeats=2.0) == 1.0 and mixing.exponent_for(made) == 1.0


@pytest.mark.parametrize("heavy", [2, 1000])
def test_token_counts_with_a_hot_digest(spark, tmp_path, monkeypatch, heavy):
    monkeypatch.setattr("millrace.llm.common.FEW", 1)
    monkeypatch.setattr("millrace.llm.common.HEAVY", heavy)
    docs = spark.createDataFrame([(i, "same words" if i % 3 else f"text {i}") for i in range(300)], "doc_id long, text string").repartition(3)
    got = token_cache.token_counts(docs, f"file://{tmp_path}/cache", tokenizer=tokenizer_path(entries.BYTE_BPE)).collect()
    whole = library(entries.BYTE_BPE)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(i, len(whole("same words" if i % 3 else f"text {i}"))) for i in range(300)]


def test_packing_in_file_order(spark, tmp_path):
    rows = [(i * 7 % 401, f"text number {i} " * (i % 5)) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/t")
    pieces = packing.pack(spark.read.parquet(f"{tmp_path}/t"), tokenizer=tokenizer_path(entries.WORD_BPE), capacity=64, file_order=True).collect()
    order = [p["doc_id"] for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])) if p["start"] == 0]
    assert order == sorted(d for d, _ in rows)
