"""Cross-site line removal by distinct-site spread (DataFrame functions only).

A line is boilerplate if it occurs on many distinct sites. Lines are hashed; hashes that occur too rarely
to reach the threshold go first (a plain count with map-side combine). For the rest one HyperLogLog sketch
per line hash gathers the sites; sketches merge by aggregation, so a line on every page of the web costs
one sketch a task. Estimates near the threshold are settled by exact distinct counts of just those lines.

The few lines and rows that matter are written before they are joined, so that Spark knows their size: it
broadcasts them below its threshold, and beyond it joins plain shuffles, of which it splits the hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

LINE, ROW = ["_line", "_line2"], ["_key", "_key2"]


def _hashes(*columns: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes: the second starts from another seed."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def _row_keys(id_col: str, text_col: str) -> list[Column]:
    return [h.alias(name) for h, name in zip(_hashes(F.col(id_col).isNull(), F.col(id_col), F.col(text_col)), ROW)]


def _lines(text_col: str, min_chars: int | None) -> Column:
    """Hashes of the newline-split lines, null for lines of fewer than ``min_chars`` code points after trimming spaces (None: for lines without a word)."""
    counts = lambda x: x.rlike(r"[^\x20\x09-\x0D]") if min_chars is None else F.length(F.trim(x)) >= min_chars
    hashed = lambda x: F.when(counts(x), F.struct(*(h.alias(n) for h, n in zip(_hashes(F.trim(x)), LINE))))
    return F.transform(F.split(F.col(text_col), "\n", -1), hashed)


def line_occurrences(df: DataFrame, id_col: str, text_col: str, site_col: str, min_chars: int | None) -> DataFrame:
    """One row per line that counts: row keys, ``_id``, ``_site``, ``_pos`` and the line's two hashes."""
    each = df.select(*_row_keys(id_col, text_col), F.col(id_col).alias("_id"), F.col(site_col).alias("_site"), F.posexplode(_lines(text_col, min_chars)).alias("_pos", "_hash"))
    return each.filter(F.col("_hash").isNotNull()).select(*ROW, "_id", "_site", "_pos", "_hash.*")


def boilerplate(lines: DataFrame, min_sites: int, band: float = 0.25, lg_k: int = 12) -> DataFrame:
    """Line hashes on at least ``min_sites`` distinct sites, each with its first occurrence ``_first``.

    ``band`` is the relative width around the threshold within which the sketch is not trusted (at least two
    sites); the sketch's standard error is about 1.04 / sqrt(2 ** lg_k), so the band is many times as wide.
    """
    slack = max(2.0, band * min_sites)
    spread = materialize(
        lines.groupBy(*LINE).agg(
            F.hll_sketch_estimate(F.hll_sketch_agg(F.col("_site").cast("string"), lg_k)).alias("_sites"),
            F.min(F.struct("_id", *ROW, "_pos")).alias("_first"),
        )
    )
    sure = spread.filter(F.col("_sites") > min_sites + slack).select(*LINE, "_first")
    near = spread.filter(F.abs(F.col("_sites") - min_sites) <= slack).select(*LINE, "_first")
    exact = lines.join(near.select(*LINE), LINE, "left_semi").select(*LINE, "_site").distinct().groupBy(*LINE).agg(F.count("_site").alias("_exact"))
    return sure.unionByName(near.join(exact.filter(F.col("_exact") >= min_sites), LINE).select(*LINE, "_first"))


def remove_site_boilerplate(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 5, min_chars: int | None = None, keep_first: bool = True
) -> DataFrame:
    """``df`` with boilerplate lines taken out of the texts, plus ``n_lines`` and ``n_removed``.

    A line counts if it holds a word, however short, and stands on ``min_sites`` distinct sites; a whole
    number for ``min_chars`` asks for that many code points after trimming spaces instead. With ``keep_first``
    the occurrence with the smallest (id, row hash, place) stays, so no line is lost from the corpus;
    identical repeated rows share that occurrence and all keep it.

    A null text stays null with no lines; an empty text has one empty line; a null site counts as no site;
    null ids sort first. Very long texts are cut in time linear in their lines. Input columns named
    ``n_lines`` or ``n_removed`` give way to the new ones; all others, whatever their names, stay. Rows
    correspond one to one; an empty table gives an empty result.
    """
    rest = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    hidden = {c: f"_in_{i}" for i, c in enumerate(rest)}  # no input column meets a working one
    df = df.select(*(F.col(f"`{c}`").alias(h) for c, h in hidden.items()))
    id_col, text_col, site_col = hidden[id_col], hidden[text_col], hidden[site_col]

    found = line_occurrences(df, id_col, text_col, site_col, min_chars)
    often = materialize(found.groupBy(*LINE).count().filter(F.col("count") >= min_sites).select(*LINE))
    common = materialize(found.join(often, LINE))  # ids and hashes of the few lines that could qualify
    marked = materialize(boilerplate(common, min_sites))
    hits = common.join(marked, LINE)
    if keep_first:
        at = F.col("_first")
        hits = hits.filter(~((F.col("_key") == at["_key"]) & (F.col("_key2") == at["_key2"]) & (F.col("_pos") == at["_pos"])))
    removed = materialize(hits.groupBy(*ROW).agg(F.collect_set("_pos").alias("_gone")))  # at most the lines of one text
    joined = df.withColumns(dict(zip(ROW, _row_keys(id_col, text_col)))).join(removed.hint("shuffle_hash"), ROW, "left")
    lines = F.split(F.col(text_col), "\n", -1)

    def left(own: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("_gone"))
        return F.array_join(F.transform(stay, lambda i: F.get(own, i)), "\n")

    cleaned = F.get(F.transform(F.array(lines), left), 0)  # a one-element array, so that the text is split once
    return joined.select(
        *(F.when(F.col("_gone").isNull(), F.col(h)).otherwise(cleaned).alias(c) if h == text_col else F.col(h).alias(c) for c, h in hidden.items()),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).alias("n_removed"),
    )
