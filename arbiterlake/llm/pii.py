"""Personal data by weak supervision (DataFrame functions only).

Patterns propose spans. Labelers - checksums and formats, a gazetteer, the words to the left, the shape and
the borders - vote on every proposed span or abstain. Expectation-maximisation over the counts of the vote
patterns estimates their reliabilities; the resulting soft labels train a logistic span classifier on a
small table of discrete features, which then decides on its own. Spans that pass the strict base patterns
always stay; the classifier adds others.

Offsets are code points, the end exclusive. Only bounded count tables reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .quality import LabelModel, Rule, fit_label_model

#: Kinds in output order. The first four have base patterns; the others are only the classifier's.
KINDS = ("email", "ip", "card", "phone", "masked_email", "local_phone", "national_id", "account", "secret")
BASE_KINDS = 4

#: Java patterns. Possessive repeats keep matching linear and off the call stack; \G or a look-behind lets a
#: match start only where a leftmost one can.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "masked_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++",
    "local_phone": r"(?<![0-9+() .-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|(?<=(?i:password|passwd|pwd|token|secret|api_key)(?: ?[=:] ?\"?))[A-Za-z0-9_/+-]{8,}+)",
}
#: A cheap necessary pattern, so that most texts skip most patterns; digits where none is given.
NEEDS = {"email": "@", "phone": r"\+", "masked_email": r"[(\[]at[)\]]", "secret": "[=:]|AKIA"}

SPAN = "kind int, start int, stop int, base boolean, value string, before string, after string"

#: Gazetteers of the labelers, from public registries: generic endings of host names (two letters are a country's),
#: first digits of card issuers, and address blocks reserved for private, local, documentation or multicast use.
DOMAINS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "aero", "coop", "museum", "mobi", "travel", "jobs", "cat", "tel", "asia", "post",
    "xyz", "online", "site", "shop", "app", "dev", "cloud", "tech", "store", "blog", "club", "live", "news", "world", "email", "agency", "company", "example",
)
ISSUERS = "^(4|5[0-9]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720)|30[0-59]|3[4-9]|6)"
RESERVED = r"^0*(0|10|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.|^0*169\.0*254\.|^0*172\.0*(1[6-9]|2[0-9]|3[01])\.|^0*192\.0*168\.|^0*192\.0+\.0*2\.|^0*198\.0*51\.0*100\.|^0*203\.0+\.0*113\."
ENDING = f"lower(substring_index(c.value, '.', -1)) rlike '^({'|'.join(DOMAINS)}|[a-z][a-z])$'"
CUES = r"(?i)(mail|e-mail|contact|phone|tel|call|mobile|fax|card|visa|account|konto|iban|ssn|address|adresse|ip|host|login|user|password|passwd|pwd|token|secret|key)[^A-Za-z0-9]{0,4}$"
COUNTER_CUES = r"(?i)(version|release|section|chapter|figure|table|page|isbn|article|paragraph|vol|no)[^A-Za-z0-9]{0,3}$"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), add) % 10 == 0)


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(False)


EMPTY = f"array<struct<{SPAN.replace(', ', ',').replace(' ', ':')}>>"


def _running_sums(lengths: Column) -> Column:
    """Sums up to and including each place, by doubling steps: as many passes over the array as its size has binary digits."""

    def step(sums: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(0))

    return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths))).cast("int")), lengths, step)


def _proposed(text: Column, kind: str) -> Column:
    """Array of spans of one kind, leftmost and non-overlapping, with their neighbourhood.

    One-element arrays bind what is used again, so each pattern runs once, and once more where it matched.
    """
    pattern, none = PATTERNS[kind], F.array().cast(EMPTY)

    def span(values: Column, gaps: Column, stops: Column, i: Column) -> Column:
        value, stop = F.get(values, i), F.get(stops, i)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), (stop - F.length(value)).alias("start"), stop.alias("stop"),
            (_valid(kind, value) if kind in KINDS[:BASE_KINDS] else F.lit(False)).alias("base"),
            value.alias("value"), F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(4)).alias("after"),
        )

    def spans(values: Column, gaps: Column) -> Column:
        ends = F.transform(F.array(_running_sums(F.transform(values, lambda v, i: F.length(F.get(gaps, i)) + F.length(v)))), lambda stops: F.transform(values, lambda _, i: span(values, gaps, stops, i)))
        return F.flatten(ends)

    def located(values: Column) -> Column:
        each = F.flatten(F.transform(F.array(F.split(text, pattern, -1)), lambda gaps: spans(values, gaps)))
        return F.when(F.size(values) > 0, each.cast(EMPTY)).otherwise(none)

    there = text.rlike(NEEDS.get(kind, "[0-9]"))
    values = F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(F.array(values), located))


def candidates(text_col: str) -> Column:
    """All proposed spans of a text, sorted by start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return F.array_sort(F.flatten(F.array(*(_proposed(text, k) for k in KINDS))), order)


_CUE, _COUNTER = f"c.before rlike r'{CUES}'", f"c.before rlike r'{COUNTER_CUES}'"
_BORDERED = "(c.before = '' or c.before rlike '[^A-Za-z0-9]$') and (c.after = '' or c.after rlike '^[^A-Za-z0-9]')"

#: The labelers: conditions against and for personal data over the fields of a span ``c``. Each abstains on
#: the kinds it knows nothing of.
LABELERS = (
    Rule("checksum", "c.kind < 4 and not c.base", "c.base", trust=0.97),
    Rule(
        "gazetteer",
        f"(c.kind = 2 and not regexp_replace(c.value, '[^0-9]', '') rlike '{ISSUERS}') or (c.kind = 1 and c.value rlike r'{RESERVED}')",
        f"(c.kind in (0, 4) and {ENDING}) or (c.kind = 2 and regexp_replace(c.value, '[^0-9]', '') rlike '{ISSUERS}') or (c.kind = 8 and c.value rlike '^(AKIA|[0-9a-f]{{16,}}$)')",
        trust=0.75,
    ),
    Rule("context", _COUNTER, f"({_CUE}) or (c.kind = 8 and c.before rlike '[=:]')", trust=0.85),
    Rule("shape", f"length(regexp_replace(c.value, r'(.)\\1+', '$1')) < 4 or length(c.value) < 6", f"length(c.value) >= 9 or (c.kind = 1 and not c.value rlike r'(^|\\.)0[0-9]')", trust=0.65),
    Rule("borders", f"not ({_BORDERED})", _BORDERED, trust=0.65),
)

#: The classifier's features: name -> (number of values, SQL over the fields of a span ``c`` giving 0 .. number - 1).
FEATURES = {
    "kind": (len(KINDS), "c.kind"),
    "valid": (3, "case when c.kind >= 4 then 2 when c.base then 1 else 0 end"),
    "length": (5, "case when length(c.value) < 8 then 0 when length(c.value) < 12 then 1 when length(c.value) < 17 then 2 when length(c.value) < 30 then 3 else 4 end"),
    "digits": (4, "case when not c.value rlike '[0-9]' then 0 when not c.value rlike '[A-Za-z]' then 1 when length(regexp_replace(c.value, '[^0-9]', '')) * 2 < length(c.value) then 2 else 3 end"),
    "cue": (3, f"case when {_COUNTER} then 0 when {_CUE} or c.before rlike '[=:] ?\"?$' then 2 else 1 end"),
    "border": (2, f"int({_BORDERED})"),
}


def fit_classifier(cells: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 25, decay: float = 1.0) -> list[np.ndarray]:
    """Ridge logistic regression on one-hot features with soft labels, by Newton steps on a bounded table. One weight vector a feature."""
    sizes = [n for n, _ in FEATURES.values()]
    start = np.concatenate([[0], np.cumsum(sizes)])
    x = np.zeros((len(cells), start[-1]))
    x[np.arange(len(cells))[:, None], cells + start[:-1]] = 1
    w = np.zeros(start[-1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + decay * np.eye(len(w))
        w -= np.linalg.solve(curve, x.T @ (weight * (p - label)) + decay * w)
    return [w[a:b] for a, b in zip(start, start[1:])]


#: What the labelers' trust weighs against the spans of the corpus.
PSEUDO_COUNT = 20.0


def train(found: DataFrame) -> tuple[LabelModel, list[np.ndarray]]:
    """Label model and span classifier from a table with a column ``spans``; only tables bounded by the labelers' and features' values are collected."""
    spans = found.select(F.explode("spans").alias("c"))
    votes = [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(f"v_{r.name}") for r in LABELERS]
    cells = [F.expr(sql).alias(f"f_{name}") for name, (_, sql) in FEATURES.items()]
    values = spans.select(*votes, *cells)
    table = values.groupBy(*values.columns).count().collect()
    rows = np.array([list(r) for r in table], dtype=np.int64).reshape(len(table), len(LABELERS) + len(FEATURES) + 1)
    vote, cell, weight = rows[:, : len(LABELERS)], rows[:, len(LABELERS) : -1], rows[:, -1].astype(float)
    model = fit_label_model(vote, weight, LABELERS, prior=0.7, weight=PSEUDO_COUNT, silence_tells=False)
    return model, fit_classifier(cell, model.posterior(vote), weight)


def _kept(weights: list[np.ndarray], threshold: float) -> Column:
    """The spans of ``spans`` that are base spans or that the classifier takes."""
    score = " + ".join(
        f"element_at(array({', '.join(f'{x:.9g}D' for x in w)}), 1 + ({sql}))" for (_, sql), w in zip(FEATURES.values(), weights)
    )
    odds = float(np.log(threshold / (1 - threshold)))
    return F.expr(f"filter(spans, c -> c.base or ({score}) >= {odds:.9g}D)")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col`` and ``spans`` for every row: an array of (kind, start, stop, base, value) sorted by start, then kind.

    ``kind`` indexes ``KINDS``; ``base`` tells spans of the strict base patterns, which always stay. Null and
    empty texts have no spans; very long texts are read whole; null ids and repeated rows pass through one to
    one; other columns are not read; an empty table gives an empty result and a classifier that knows nothing.
    """
    found = materialize(df.select(id_col, candidates(text_col).alias("spans")))  # spans only, no texts
    _, weights = train(found)
    return found.select(
        id_col, F.transform(_kept(weights, threshold), lambda c: F.struct(c["kind"], c["start"], c["stop"], c["base"], c["value"])).alias("spans")
    )


def redact_pii(df: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``df`` with every found span replaced by its kind in angle brackets; all other columns unchanged.

    Overlapping spans are replaced together by the kind of the first one, so that no part of any of them
    stays. The spans are proposed twice, once to train and once to redact, which moves no text. A null text
    stays null, an empty one empty; nulls in other columns, repeated rows and an empty table pass through;
    very long texts are read whole; input columns of any name, ``spans`` too, are kept.
    """
    _, weights = train(df.select(candidates(text_col).alias("spans")))
    plain = df.select(*(F.col(f"`{c}`").alias(f"_in_{i}") for i, c in enumerate(df.columns)))
    text = f"_in_{df.columns.index(text_col)}"
    found = plain.withColumn("spans", candidates(text)).withColumn("spans", _kept(weights, threshold))
    redacted = F.when(F.size("spans") == 0, F.col(text)).otherwise(_replaced(F.col(text), F.col("spans")))
    return found.select(*(redacted.alias(c) if f"_in_{i}" == text else F.col(f"_in_{i}").alias(c) for i, c in enumerate(df.columns)))


#: Characters of the blocks that a text is cut into, so that a piece is taken from where it stands and not from the start.
BLOCK = 1000


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is made once however often ``use`` reads it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _replaced(text: Column, spans: Column) -> Column:
    """``text`` with the spans, sorted by start, replaced; those that overlap together, by the kind of the first one.

    A span starts anew if as many stops as there are spans before it lie at or before its start, which the
    sorted stops tell at once; the stop before the next start is the end of what is replaced. So the work is
    that of sorting the spans and of passing over the text once.
    """
    tags = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    cut = F.struct(
        F.transform(spans, lambda c: c["start"]).alias("starts"), F.sort_array(F.transform(spans, lambda c: c["stop"])).alias("stops"), F.transform(spans, lambda c: c["kind"]).alias("kinds"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"), F.length(text).alias("end"),
    )

    def piece(v: Column, start: Column, stop: Column) -> Column:
        block = lambda at: F.floor(at / BLOCK).cast("int")
        within = lambda at: (at % BLOCK).cast("int")
        first, last = F.coalesce(F.get(v["blocks"], block(start)), F.lit("")), F.coalesce(F.get(v["blocks"], block(stop)), F.lit(""))
        whole = F.array_join(F.slice(v["blocks"], block(start) + 2, F.greatest(block(stop) - block(start) - 1, F.lit(0))), "")
        apart = F.concat(first.substr(within(start) + 1, F.lit(BLOCK)), whole, last.substr(F.lit(1), within(stop)))
        return F.when(block(start) == block(stop), first.substr(within(start) + 1, stop - start)).otherwise(apart)

    def joined(v: Column) -> Column:
        fresh = F.filter(F.sequence(F.lit(0), F.size(v["starts"]) - 1), lambda i: (i == 0) | (F.get(v["stops"], i - 1) <= F.get(v["starts"], i)))
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(v["stops"], i - 1))
        parts = F.transform(fresh, lambda i: F.concat(piece(v, before(i), F.get(v["starts"], i)), F.get(tags, F.get(v["kinds"], i))))
        return F.concat(F.array_join(parts, ""), piece(v, F.array_max(v["stops"]), v["end"]))

    return _bound(cut, joined)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.get(names, c["kind"]), c["start"].cast("string"), c["stop"].cast("string"))), ",")
