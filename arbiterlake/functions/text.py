"""Text expressions: trimming, tokens, citations, claims, markers, personal-data patterns."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern values of the data model.
BRACKETED_ID = r"\[([A-Z][A-Z0-9_-]{2,})\]"
BARE_ID = r"(?<![A-Z0-9_-])([A-Z][A-Z0-9]+(?:-[A-Z0-9]+)+)(?![A-Z0-9_-])"
CLAIM_BREAK = "[\n。；;!?！？]+"
CLAIM_EDGE = r"^[ \-0-9.、:：]+|[ \-0-9.、:：]+$"
PII = {
    "mobile": r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])",
    "national_id": r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
}
TERMINAL = ".。!！?？)）]】\"”'’`}"


def clean(c: Column | str) -> Column:
    """Trimmed text, Unicode white space included; null becomes empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def filled(c: Column | str) -> Column:
    return clean(c) != ""


def tokens(c: Column) -> Column:
    """Lower-cased word tokens, then every CJK character, then bigrams over the CJK characters alone."""
    text = F.lower(clean(c))
    words = F.regexp_extract_all(text, F.lit("[a-z0-9_]+"), F.lit(0))
    cjk = F.regexp_replace(text, "[^\\u4e00-\\u9fff]++", "")  # a run at once: one match for a text without such characters
    size = F.length(cjk)
    none = F.array().cast("array<string>")
    single = F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: cjk.substr(i, F.lit(1)))).otherwise(none)
    double = F.when(size > 1, F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: cjk.substr(i, F.lit(2)))).otherwise(none)
    return F.concat(words, single, double)


def content_tokens(c: Column) -> Column:
    """Distinct tokens longer than one character."""
    return F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) > 1))


def source_ids(c: Column) -> Column:
    """Sorted distinct citation ids: bracketed ones and bare hyphenated ones."""
    text = clean(c)
    found = F.concat(F.regexp_extract_all(text, F.lit(BRACKETED_ID), F.lit(1)), F.regexp_extract_all(text, F.lit(BARE_ID), F.lit(1)))
    return F.array_sort(F.array_distinct(found))


def claims_of_text(c: Column) -> Column:
    """Claims of plain text: parts between breaks of at least eight characters, edges stripped."""
    parts = F.filter(F.split(clean(c), CLAIM_BREAK), lambda p: F.length(clean(p)) >= 8)
    return F.transform(parts, lambda p: F.regexp_replace(p, CLAIM_EDGE, ""))


def has_any(c: Column, markers: Sequence[str]) -> Column:
    """True if the text holds any of the literal markers; false without markers or text."""
    text = F.coalesce(c, F.lit(""))
    found = F.lit(False)
    for m in markers:
        found = found | F.contains(text, F.lit(m))
    return found


def support_score(claim: Column, source: Column) -> Column:
    """Share of the claim's content tokens that the source has, three places; zero if either is empty."""
    a, b = content_tokens(claim), content_tokens(source)
    from .values import rate

    return F.when(F.size(b) == 0, 0.0).otherwise(rate(F.size(F.array_intersect(a, b)), F.size(a), 3))


def fact_hit(output: Column, fact: Column, share: float = 0.35) -> Column:
    """Fact found in the output: whole, or any of its fragments, or enough of its CJK bigrams."""
    fragments = F.filter(F.split(fact, "[、，,；;或和及/ ]+"), lambda p: F.length(p) >= 2)
    cjk = F.regexp_replace(fact, "[^\\u4e00-\\u9fff]++", "")
    pairs = F.when(F.length(cjk) > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(cjk) - 1, F.lit(1))), lambda i: cjk.substr(i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    near = F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda p: F.contains(output, p))) >= share * F.size(pairs)).otherwise(False)
    return F.contains(output, fact) | F.exists(fragments, lambda p: F.contains(output, p)) | near


def topic_hit(output: Column, topic: Column) -> Column:
    """Topic contained once white space is taken out, or any of its fragments of two or more characters."""
    bare = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    fragments = F.filter(F.split(topic, "[、，,；;/或和及]"), lambda p: F.length(p) >= 2)
    return F.contains(bare(output), bare(topic)) | F.exists(fragments, lambda p: F.contains(output, p))


def pii_kinds(c: Column) -> Column:
    """Names of the personal-data patterns that match."""
    text = F.coalesce(c, F.lit(""))
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in PII.items())))


def completeness_issues(c: Column) -> Column:
    """Mechanical signs of a truncated answer."""
    text = clean(c)
    return F.array_compact(
        F.array(
            F.when(text == "", F.lit("empty")),
            F.when(F.regexp_count(text, F.lit(r"\*\*")) % 2 == 1, F.lit("unbalanced_bold")),
            F.when(F.regexp_count(text, F.lit("```")) % 2 == 1, F.lit("unbalanced_fence")),
            F.when((F.length(text) >= 200) & ~F.contains(F.lit(TERMINAL), F.right(text, F.lit(1))), F.lit("no_terminal_punctuation")),
        )
    )


def prompt_hash(c: Column) -> Column:
    """SHA-256 of the lower-cased text without white space; empty for an empty text."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s", "")
    return F.when(bare == "", "").otherwise(F.sha2(bare, 256))


def nfkc(c: Column) -> Column:
    """NFKC form; Spark has no such function, so Arrow batches go through Python."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return normal(c)


def alias_key(c: Column) -> Column:
    """Model alias without case, blanks, hyphens and underscores."""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), " -_", "")


def shorten(c: Column, limit: int) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 1)), F.lit("…"))).otherwise(flat)


#: Fixed ways to write points in a rubric.
POINTS = r"(?U)[+＋]\s*[0-9]+\s*分|（\s*[0-9]+\s*分\s*）|\([0-9]+\s*分\)"


def points(c: Column, default: int = 1) -> Column:
    """Largest number of points written as +N分, （N分） or (N分)."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(POINTS), F.lit(0))
    return F.coalesce(F.array_max(F.transform(found, lambda x: F.regexp_extract(x, "[0-9]+", 0).try_cast("int"))), F.lit(default))
