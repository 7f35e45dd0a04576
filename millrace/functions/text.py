"""Text normalisation for Latin and Arabic scripts, tokens and n-grams; all as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Arabic marks that are dropped (with the lengthening sign) and letter forms that are merged.
ARABIC_MARKS = r"\x{0610}-\x{061A}\x{064B}-\x{065F}\x{06D6}-\x{06DC}\x{06DF}-\x{06E8}\x{06EA}-\x{06ED}\x{0640}"
ARABIC_FROM, ARABIC_TO = "أإآةىؤئ", "اااهيوي"
WORD = r"\p{L}\p{N}_"


def normalize_arabic(c: Column) -> Column:
    """Texts without Arabic letters stay as they are."""
    return F.when(c.rlike(r"[\x{0600}-\x{06FF}]"), F.translate(F.regexp_replace(c, f"[{ARABIC_MARKS}]", ""), ARABIC_FROM, ARABIC_TO)).otherwise(c)


def clean_text(c: Column, *, arabic: bool = True, lower: bool = True, keep_arabic: bool = True) -> Column:
    """Case, script, links, mentions and tags, digits, punctuation, white space, in this order. Null becomes empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    out = F.lower(out) if lower else out
    out = normalize_arabic(out) if arabic else out
    if not keep_arabic:
        out = F.regexp_replace(out, r"[^\x00-\x7F]+", " ")
    links, tags = r"https?://[^\s]+|www\.[^\s]+", rf"[@#][{WORD}]+"
    out = F.when(out.contains("://") | out.contains("www."), F.regexp_replace(out, "(?U)" + links, " ")).otherwise(out)
    out = F.when(out.contains("@") | out.contains("#"), F.regexp_replace(out, "(?U)" + tags, " ")).otherwise(out)
    #: Digits, punctuation and white space, in one pass: any run of them is a gap.
    return F.trim(F.regexp_replace(out, rf"(?U)[0-9٠-٩\s[^{WORD}\s\x{{0600}}-\x{{06FF}}]]+", " "))


def tokens(c: Column, **options) -> Column:
    return F.filter(F.split(clean_text(c, **options), " "), lambda t: t != "")


def ngrams(toks: Column, lo: int = 1, hi: int = 1) -> Column:
    """All runs of lo..hi tokens, the shorter ones first."""
    none = F.array().cast("array<string>")

    def runs(n: int) -> Column:
        if n == 1:
            return toks
        made = F.transform(F.sequence(F.lit(1), F.size(toks) - (n - 1)), lambda i: F.array_join(F.slice(toks, i, F.lit(n)), " "))
        return F.when(F.size(toks) >= n, made).otherwise(none)

    return F.concat(*[runs(n) for n in range(lo, hi + 1)])
