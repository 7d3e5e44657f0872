"""Quality rules as weak supervision.

Every rule votes *good*, *bad* or abstains. The votes of all documents are counted by pattern (a bounded
table: three to the number of rules), expectation-maximisation on those counts estimates each rule's
accuracy for good and for bad documents, and the posterior probability of *good* decides. No rule can
reject a document by itself unless its estimated accuracy carries the posterior.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, hold, map_arrow, materialize, words_of

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))

#: name -> type of the measured features, in order.
FEATURES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "n_lines": "long", "n_distinct": "long", "n_upper": "long", "n_lower": "long", "n_marks": "long", "n_pipes": "long",
}


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words covered by ``width``-word windows that occur twice or more in the text, first occurrence included."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[k:] for k in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered = reach = 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + width - max(i, reach)
            reach = i + width
    return covered


def measure(text: str | None) -> tuple:
    """The features of one whole text; null and empty texts measure zero throughout."""
    if not text:
        return (0,) * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    drop = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in text.split("\n") if words_of(x)]
    return (
        len(words),
        len(b"".join(words).decode("utf-8", "surrogatepass")),
        drop(SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
        drop(UPPER),
        drop(LOWER),
        raw.count(b"!"),
        raw.count(b"|"),
    )


@dataclass(frozen=True)
class Rule:
    """``bad`` and ``good`` are SQL conditions over the features; neither true: the rule abstains."""

    name: str
    bad: str
    good: str = "false"
    trust: float = 0.9


#: Detectors abstain on what they do not detect, so that many of them do not outvote the one that fires.
RULES = (
    Rule("too_short", "n_words < 10", trust=0.95),
    Rule("repeats", "100 * n_repeat_words > 20 * n_words", trust=0.95),
    Rule("symbols", "5 * n_symbols > n_words", trust=0.95),
    Rule("shouting", "n_upper > n_lower and n_words >= 5", trust=0.95),
    Rule("marks", "10 * n_marks > 3 * n_words", trust=0.9),
    Rule("pipes", "10 * n_pipes > n_words", trust=0.9),
    Rule("one_word", "20 * n_distinct < n_words and n_words >= 100", trust=0.9),
    Rule("plain", "n_words < 5", "n_words >= 10 and 20 * n_symbols <= n_words and 4 * n_upper <= n_lower + n_upper and 20 * n_marks <= n_words", trust=0.85),
    Rule("long_enough", "n_words < 5", "n_words >= 40", trust=0.65),
    Rule("word_length", "word_chars > 18 * n_words or word_chars < 2 * n_words", "word_chars between 3 * n_words and 12 * n_words", trust=0.65),
)


@dataclass(frozen=True)
class LabelModel:
    """Prior of *good*, and per rule the log-likelihood ratios good : bad of its votes (-1, 0, 1)."""

    prior: float
    ratios: tuple[tuple[float, float, float], ...]

    def log_odds(self, votes: np.ndarray) -> np.ndarray:
        table = np.array(self.ratios)
        return np.log(self.prior / (1 - self.prior)) + table[np.arange(votes.shape[1]), votes + 1].sum(axis=1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(votes), -500, 500)))


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rules: tuple[Rule, ...], prior: float = 0.9, rounds: int = 100, weight: float = 20.0, silence_tells: bool = True) -> LabelModel:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) and their counts.

    Per class every rule has its own rates of the three votes, abstaining included: a detector that never
    votes *good* still tells by its silence. The rates start from the rules' ``trust`` and keep ``weight``
    pseudo-counts of it; after each round a rule's *bad* votes may not speak for *good* nor the reverse, so
    the classes keep their meaning.
    """
    # rates[rule, class, vote]; classes bad, good; votes bad, abstains, good
    start = np.empty((len(rules), 2, 3))
    for i, r in enumerate(rules):
        speaks = r.good != "false"
        fires = r.trust / len(rules)  # each rule starts with its share of what is bad, so silence tells little at first
        start[i, 0] = (fires, 1 - fires - (1 - r.trust) * speaks, (1 - r.trust) * speaks)
        start[i, 1] = ((1 - r.trust) / 50, 1 - (1 - r.trust) / 50 - r.trust * 0.9 * speaks, r.trust * 0.9 * speaks)
    start = np.clip(start, 1e-4, None)
    start /= start.sum(axis=2, keepdims=True)

    def model(share: float, rates: np.ndarray) -> LabelModel:
        if not silence_tells:
            rates = rates[:, :, [0, 2]] / rates[:, :, [0, 2]].sum(axis=2, keepdims=True)
            rates = np.insert(rates, 1, 1.0, axis=2)
        ratios = np.log(rates[:, 1]) - np.log(rates[:, 0])
        ratios[:, 0] = np.minimum(ratios[:, 0], 0)
        ratios[:, 2] = np.maximum(ratios[:, 2], 0)
        return LabelModel(float(np.clip(share, 0.02, 0.98)), tuple(map(tuple, ratios.tolist())))

    found = model(prior, start)
    if not len(votes) or not counts.sum():
        return found
    hot, n = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float), counts.astype(float)
    for _ in range(rounds):
        p = found.posterior(votes)
        rates = np.stack([np.einsum("n,nrv->rv", n * w, hot) for w in (1 - p, p)], axis=1) + weight * start
        found = model(float(n @ p / n.sum()), rates / rates.sum(axis=2, keepdims=True))
    return found


def vote_columns(rules: tuple[Rule, ...] = RULES):
    """One column per rule: -1 bad, 1 good, 0 abstains (bad wins if both hold)."""
    return [F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0).alias(f"v_{r.name}") for r in rules]


def measured(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` of ``df`` and the features of each whole text. Kept columns named like a feature give way to it."""
    keep = tuple(c for c in keep if c not in FEATURES)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"{c} {t}" for c, t in FEATURES.items())])
    source = df.select(*keep, *([text_col] if text_col not in keep else []))

    def run(batch):
        hold("quality")
        rows = [measure(x) for x in batch.column(text_col).to_pylist()]
        cols = zip(*rows) if rows else [[] for _ in FEATURES]
        return {**{c: batch.column(c) for c in keep}, **dict(zip(FEATURES, map(list, cols)))}

    return map_arrow(source, run, schema)


def fit(features: DataFrame, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """Count the vote patterns of all rows (at most three to the number of rules) and fit the label model on the counts."""
    votes = features.select(*vote_columns(rules))
    found = votes.groupBy(*votes.columns).count().collect()
    table = np.array([list(r)[:-1] for r in found], dtype=int).reshape(len(found), len(rules))
    return fit_label_model(table, np.array([r["count"] for r in found], dtype=float), rules)


def posterior_column(model: LabelModel, rules: tuple[Rule, ...] = RULES):
    """Posterior probability of *good* as a column over the features."""
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for vote, (bad, silent, good) in zip(vote_columns(rules), model.ratios):
        odds = odds + F.when(vote == -1, bad).when(vote == 1, good).otherwise(silent)
    return 1 / (1 + F.exp(-odds))


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def score_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``id_col``, the features, ``base_failed``, ``quality`` (posterior of good) and ``kept`` for every row.

    Rows correspond one to one, repeated rows included. Null or empty texts measure zero and fail the base
    rule; very long texts are measured whole. Null ids pass through. An empty table gives an empty result. Other
    columns are not read. An id column named like a feature or an output comes back with ``_id`` added to its name.
    """
    name = id_col if id_col not in (*FEATURES, "base_failed", "quality", "kept") else f"{id_col}_id"
    plain = df.select(F.col(f"`{id_col}`").alias(name), F.col(f"`{text_col}`").alias("_text"))
    with arrow_batches(df.sparkSession):
        features = materialize(measured(plain, "_text", keep=(name,)))  # a few numbers a row; the texts are read once
    model = fit(features, rules)
    return (
        features.withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("quality", posterior_column(model, rules))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    )


def filter_quality(df: DataFrame, text_col: str = "text", threshold: float = 0.5, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` that the base rule passes and whose posterior reaches ``threshold``, all columns unchanged.

    The texts are measured twice, once to fit and once to filter, which moves no text through a shuffle or a table.
    Input columns named like a feature are kept as they came; null and empty texts fail the base rule; nulls in
    other columns and repeated rows pass one to one; an empty table gives an empty result.
    """
    with arrow_batches(df.sparkSession):
        model = fit(measured(df, text_col), rules)
    hidden = {c: f"_in_{i}" for i, c in enumerate(df.columns)}
    inner = df.select(*(F.col(f"`{c}`").alias(h) for c, h in hidden.items()))
    judged = measured(inner, hidden[text_col], keep=tuple(hidden.values()))
    good = judged.filter(~F.expr(BASE_FAILED) & (posterior_column(model, rules) >= threshold))
    return good.select(*(F.col(h).alias(c) for c, h in hidden.items()))
