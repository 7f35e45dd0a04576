"""Personal data: fixed forms, and identifiers that appear where such forms do.

All of it is DataFrame expressions. Base spans come from four expressions whose matches
are checked afterwards (parts of an address, Luhn's sum, numbers of digits).

The contextual part bootstraps from them. A *place* is any token with a digit or an at
sign, with the groups of digits that follow it after single blanks. A place that overlaps
a base span is a seed of score 1; one of a key's shape (long, letters and digits mixed) is
a seed of score ``KEY``, which alone is no span; any other starts at 0. Each place has up
to two lexical patterns: the two words before it (one word, where a label's sign as in
``token = "`` stands between), and the word before it with the word after it. The graph of
patterns and tokens is scored in rounds: a pattern by the mean score of its places, if it
has enough different known tokens; a token by the sure patterns it stands in. Places that
a sure pattern introduces are spans of kind ``context``; base spans stay as they are.

One pass reads the texts for the graph. What it finds (digests of texts, places as numbers,
pattern hashes) is a table without texts. Patterns and tokens that hold a large part of it are
spread, so no task meets one key's rows. Where texts are wanted back, that table goes and a
second pass finds the base spans again and looks up what the graph found in that very text, so
no text is written in between; rows must be the same each time they are read. A Bloom filter
rules out most texts without such spans; only the others move.

The expressions match the same spans as the plain ones in ``BASE`` but start only where a
match can start and never go back over what they took, so they stay linear on long runs.
Null texts count as empty. Each row is looked at by itself, so repeated ids and rows get
their own spans. Null ids stay null. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, maybe_among, running_totals, spread_join

# The plain forms, in the order in which kinds are listed.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The same matches for Java's engine, in linear time and without recursion.
LINEAR = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": BASE["phone"],
}
#: What any text with a match has.
NEEDS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
KINDS = [*BASE, "context"]
#: Signs that may stand inside a token.
SIGNS = r"_@./:+-"
#: A token with a digit or an at sign, and the groups of digits after it. It starts where no such run is under way, so a text is gone over once.
TOKEN = rf"(?<![\p{{L}}\p{{N}}{SIGNS}])\(?+(?=[\p{{L}}{SIGNS}]*+[\p{{N}}@])[\p{{L}}\p{{N}}{SIGNS}]++\)?+(?:\x20?\(?+[0-9][0-9./:-]*+\)?+(?![\p{{L}}@_]))*+"
#: What any text with a token has; signs that aren't part of the identifier at a token's ends.
TOKEN_NEEDS, LEAD, TRAIL = r"[\p{N}@]", r"^[^\p{L}\p{N}+(]++", r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"
#: The shape of a key: 20 letters, digits or underscores at least, four letters and four digits among them. Its score as a seed.
KEY_SHAPE, KEY = r"^(?=(?:[^0-9]*+[0-9]){4})(?=(?:[^A-Za-z]*+[A-Za-z]){4})[A-Za-z0-9_]{20,}$", 0.9
#: The signs and up to two words from where a gap between tokens starts (or, turned round, ends); a label's sign.
EDGE, LABEL = r"^([^\p{L}]*+)(\p{L}++)(?:[^\p{L}]++(\p{L}++))?+", "[=:#]"
#: A pattern counts with so many different known tokens and such a mean score; a token is known from such a score on.
LEAST_KNOWN, SURE, ROUNDS = 3, 0.8, 3
SPAN = "array<struct<start:int,rank:int,end:int>>"
PLACE = "array<struct<start:int,end:int,token:bigint,seed:double,patterns:array<bigint>>>"


def _starts(matches: Column, gaps: Column) -> Column:
    """Where matches start, in code points: gaps and matches alternate, so their lengths add up to the places."""
    before = F.transform(gaps, F.char_length)
    lengths = F.zip_with(before, F.transform(matches, F.char_length), lambda g, m: g + F.coalesce(m, F.lit(0)))
    return F.slice(F.zip_with(running_totals(lengths), before, lambda t, g: (t + g).cast("int")), F.lit(1), F.size(matches))


def _luhn(digits: Column) -> Column:
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.ascii(F.substring(turned, i, F.lit(1))) - 48
        twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
        return total + F.when(i % 2 == 1, x).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(turned)), F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    n = F.char_length(digits)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.char_length(part(p)) < 3) | ((F.char_length(part(p)) == 3) & (part(p) <= "255")))
    if kind == "card":
        return F.when((n >= 12) & (n <= 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _before(spans: Column, start: Column, end: Column) -> Column:
    """Whether a span of one kind overlaps (start, end): the last that starts before the end decides, found by halving."""
    n = F.size(spans)
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    found = F.aggregate(steps, F.lit(0), lambda lo, x: F.when(lo + x <= n, F.when(F.get(spans, lo + x - 1)["start"] < end, lo + x).otherwise(lo)).otherwise(lo))
    return F.when(n > 0, F.coalesce(F.get(spans, found - 1)["end"] > start, F.lit(False))).otherwise(F.lit(False))


def _patterns(left: Column, right: Column, first: Column) -> Column:
    """Hashes of a place's patterns from the gaps on both sides. Where the gap ends at another token, that stands for a word."""
    turned, after = F.reverse(F.lower(left)), F.lower(right)
    part = lambda x, k: F.regexp_extract(x, EDGE, k)
    signs, near, far = F.regexp_replace(part(turned, 1), r"\s+", ""), part(turned, 2), part(turned, 3)
    far = F.when((far == "") & ~first, F.lit("0")).otherwise(far)
    two = F.when(signs.rlike(LABEL), F.concat(near, F.lit("\n"), signs)).when(far != "", F.concat(near, F.lit(" "), far))
    word = part(after, 2)
    round_ = F.when(word != "", F.concat(near, F.lit(" _ "), word))
    return F.when(near != "", F.array_compact(F.array(F.when(two.isNotNull(), F.xxhash64(F.lit(1), two)), F.when(round_.isNotNull(), F.xxhash64(F.lit(2), round_))))).otherwise(F.array().cast("array<bigint>"))


def _scanned(rows: DataFrame) -> DataFrame:
    """(row, key, base, places) of (row, key, text): one pass over the texts. Steps are projections of their own, so that no expression is computed twice."""
    text, none = F.col("text"), F.array().cast("array<string>")
    forms, needs = LINEAR | {"token": TOKEN}, NEEDS | {"token": TOKEN_NEEDS}
    some = rows.select("row", "key", "text", *[F.when(text.rlike(needs[k]), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in forms.items()])
    gaps = some.select("row", "key", *[f"m_{k}" for k in forms], *[F.when(F.size(f"m_{k}") > 0, F.split(text, p, -1)).otherwise(none).alias(f"g_{k}") for k, p in forms.items()])
    at = gaps.select("row", "key", "g_token", *[f"m_{k}" for k in forms], *[F.when(F.size(f"m_{k}") > 0, _starts(F.col(f"m_{k}"), F.col(f"g_{k}"))).otherwise(F.array().cast("array<int>")).alias(f"s_{k}") for k in forms])

    def spans(kind: str) -> Column:
        found = F.zip_with(f"m_{kind}", f"s_{kind}", lambda m, s: F.when(_holds(kind, m), F.struct(s.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (s + F.char_length(m)).alias("end"))))
        return F.when(F.size(f"m_{kind}") > 0, F.array_compact(found)).otherwise(F.array().cast(SPAN))

    lead = F.transform("m_token", lambda m: F.char_length(F.regexp_extract(m, LEAD, 0)))
    cores = F.zip_with("m_token", lead, lambda m, n: F.regexp_replace(F.substring(m, n + 1, F.char_length(m)), TRAIL, ""))
    begin = F.zip_with("s_token", lead, lambda s, n: s + n)
    kinds = at.select("row", "key", "g_token", cores.alias("cores"), begin.alias("begins"), *[spans(k).alias(f"b_{k}") for k in BASE])

    def place(core: Column, i: Column) -> Column:
        start = F.get("begins", i)
        end = start + F.char_length(core)
        meets = F.lit(False)
        for k in BASE:
            meets = meets | _before(F.col(f"b_{k}"), start, end)
        seed = F.when(meets, 1.0).when(core.rlike(KEY_SHAPE), KEY).otherwise(0.0)
        return F.struct(start.alias("start"), end.alias("end"), F.xxhash64(F.lower(core)).alias("token"), seed.alias("seed"), _patterns(F.get("g_token", i), F.get("g_token", i + 1), i == 0).alias("patterns"))

    places = F.when(F.size("cores") > 0, F.transform("cores", place)).otherwise(F.array().cast(PLACE))
    return kinds.select("row", "key", F.array_sort(F.concat(*[f"b_{k}" for k in BASE])).alias("base"), places.alias("places"))


def sure_patterns(graph: DataFrame, work: Scratch) -> DataFrame:
    """(pattern, conf, tokens, places) of the patterns that are sure in the end. ``graph``: (pattern, token, n, score), stored."""
    total = graph.count()
    degree = work.stored(graph.groupBy("token").agg(F.count("*").alias("degree")), "degrees")
    scored = graph
    for step in range(ROUNDS):
        told = scored.groupBy("pattern").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("conf"), F.count(F.when(F.col("score") >= SURE, 1)).alias("known"), F.count("*").alias("tokens"), F.sum("n").alias("places"))
        sure = work.stored(told.where((F.col("known") >= LEAST_KNOWN) & (F.col("conf") >= SURE)).drop("known"), "patterns")
        if step + 1 < ROUNDS:
            doubt = F.log(F.greatest(1 - F.col("conf"), F.lit(1e-6)))
            by = spread_join(graph, sure.select("pattern", "conf", "tokens"), ["pattern"], "tokens", total).groupBy("token").agg((1 - F.exp(F.sum(doubt))).alias("by_context"))
            by = work.stored(by.join(degree, "token"), "tokens")
            scored = spread_join(graph, by, ["token"], "degree", total, "left").select("pattern", "token", "n", F.greatest("score", F.coalesce("by_context", F.lit(0.0))).alias("score"))
    return sure


def _discovered(scanned: DataFrame, work: Scratch) -> DataFrame:
    """(key, more, found): the spans that sure patterns introduce, for each text that has some, and how many they are in all its rows (as many as rows at least)."""
    each = scanned.select("key", F.explode("places").alias("p")).select("key", "p.start", "p.end", "p.token", "p.seed", F.explode("p.patterns").alias("pattern"))
    graph = work.stored(each.groupBy("pattern", "token").agg(F.count("*").alias("n"), F.max("seed").alias("score")), "graph")
    sure = sure_patterns(graph, work)
    span = F.struct("start", F.lit(KINDS.index("context")).alias("rank"), "end").alias("x")
    free = each.where("seed < 1").select("key", "pattern", span)
    total = graph.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = spread_join(free, sure.select("pattern", "places"), ["pattern"], "places", total)
    return found.groupBy("key").agg(F.array_sort(F.collect_set("x")).alias("more"), F.count("*").alias("found"))


def with_spans(docs: DataFrame, *, text_col: str = "text", base: str = "base", spans: str = "spans", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (without the columns in ``drop``) with two further columns: base spans, and all spans, each sorted by start, then kind. The two names must be free."""
    work = Scratch(docs.sparkSession)
    keep = [c for c in docs.columns if c not in drop]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"), text.alias("text"))
    found, apart = _scanned(rows), text_col not in drop
    scanned = work.stored(found.select("key", "places") if apart else found, "scanned")
    more = work.stored(_discovered(scanned, work), "discovered")
    work.drop(more, *[scanned] * (not apart))
    total = more.agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0]
    may = maybe_among(more.select(F.xxhash64("key").alias("h")), work)(F.xxhash64("key"))
    based = (found if apart else scanned).select("row", "key", "base")
    met = spread_join(based.where(may), more, ["key"], "found", total, "left").select("row", "base", "more")
    out = based.where(~may).select("row", "base", F.lit(None).cast(SPAN).alias("more")).union(met)
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(SPAN))))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], F.col("base").alias(base), every.alias(spans))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"], x["end"])), ",")


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, numbers of base spans by kind, digest of the base spans, all spans, and numbers of contextual and of all spans."""
    found = with_spans(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), drop=("text",))
    count = lambda k, c: F.size(F.filter(c, lambda x: x["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k, "base") for k in BASE], F.sha2(written(F.col("base")).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count("context", "spans"), F.size("spans").cast("long").alias("n_spans"))


def masked(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with each span, or run of spans that overlap, replaced by the name of its first kind in brackets. Null texts stay null."""
    base = free_name(docs, "base_spans")
    spans = free_name(docs, "all_spans")
    found = with_spans(docs, text_col=text_col, base=base, spans=spans)
    none = F.array().cast(SPAN)

    def merge(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], x["end"]).alias("end"))
        start = F.concat(done, F.array(x))
        return F.when(F.size(done) == 0, start).when(x["start"] < last["end"], F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(start)

    runs = F.aggregate(F.col(spans), none, merge)
    text, names = F.col(f"`{text_col}`"), F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0)
        return F.concat(F.substring(text, before + 1, x["start"] - before), F.element_at(names, x["rank"] + 1))

    tail = F.substring(text, F.element_at(runs, -1)["end"] + 1, F.char_length(text))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(F.transform(runs, piece), ""), tail)).otherwise(text)
    return found.withColumn(text_col, clean).drop(base, spans)
