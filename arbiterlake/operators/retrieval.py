"""BM25 retrieval with metadata boost, and retrieval quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean, tokens
from ..sources.scratch import materialize
from .markers import marker_hits

K1, B = 1.5, 0.75


def document_text() -> Column:
    """Text of a corpus row that is searched."""
    return F.concat_ws(" ", *(clean(c) for c in ("source_id", "title", "source_type", "text", "tags")))


def query_text() -> Column:
    """Text of a sample row that searches."""
    return F.concat_ws(" ", *(clean(c) for c in ("user_question", "known_facts", "legal_concepts", "task_type")))


def _impact(tf: Column, length: Column, mean_length: float) -> Column:
    """What a token's count in a document of this length gives, before the token's weight."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean_length)))


def asked_tokens(queries: DataFrame) -> DataFrame:
    """``query_id`` and each distinct ``token`` of its query; written."""
    return materialize(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token")))


def written_terms(corpus: DataFrame, asked: DataFrame) -> tuple[DataFrame, int, float]:
    """The corpus as written rows (``source_id``, ``len``, ``token``, ``tf``), its number of documents and their mean length, at least 1.

    Tokens are counted where their document is, and only those that a query has are written: no other can score.
    Each document has one more row of the empty token, which no text holds; its count is that of the document.
    """
    words = corpus.select("source_id", tokens(F.col("doc")).alias("_tokens"))
    rows = words.select("source_id", F.size("_tokens").alias("len"), F.explode(F.concat("_tokens", F.array(F.lit("")))).alias("token"))
    known = asked.select("token").unionByName(asked.sparkSession.sql("SELECT '' AS token")).distinct()
    terms = materialize(rows.join(known, "token", "left_semi").groupBy("source_id", "len", "token").agg(F.count("*").cast("int").alias("tf")))
    docs, total = terms.filter("token = ''").agg(F.sum("tf"), F.sum(F.col("len").cast("long") * F.col("tf"))).first()
    return terms.filter("token <> ''"), docs or 0, max((total or 0) / max(docs or 0, 1), 1.0)


def token_weights(asked: DataFrame, terms: DataFrame, docs: int, mean_length: float) -> DataFrame:
    """``query_id``, ``token``, ``idf`` and ``bound``, the most that the token gives any document; written.

    Counts and largest impacts are added up where the documents are: a task sends a row a token, not a row a document.
    """
    known = terms.groupBy("token").agg(F.count("*").alias("df"), F.max(_impact(F.col("tf"), F.col("len"), mean_length)).alias("top"))
    idf = F.ln(1 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return materialize(asked.join(known, "token").select("query_id", "token", idf.alias("idf"), (idf * F.col("top")).alias("bound")))


def exact_scores(pairs: DataFrame, terms: DataFrame, weights: DataFrame, mean_length: float) -> DataFrame:
    """``query_id``, ``source_id``, ``bm25_score`` of written ``pairs`` that share a token: only the documents of pairs are opened."""
    met = pairs.join(terms, "source_id").join(weights, ["query_id", "token"])
    return met.groupBy("query_id", "source_id").agg(F.round(F.sum(F.col("idf") * _impact(F.col("tf"), F.col("len"), mean_length)), 6).alias("bm25_score"))


#: Share of the threshold that closed tokens may reach together: less opens more tokens, more leaves more pairs to score.
CLOSED = 0.4
#: Room for the rounding of scores when a bound is compared with them.
MARGIN = 1e-5


def closed_candidates(weights: DataFrame, terms: DataFrame, mean_length: float, top_k: int, least: float = 0.0, slack: DataFrame | None = None) -> DataFrame:
    """Pairs (``query_id``, ``source_id``) that can be among the ``top_k`` of their query; no pair that can is missing.

    A query's threshold is its k-th score among the documents in which its tokens count most (the first k by
    impact of each token, found map-side). Its tokens stand in the order of their bounds; once all from one on
    together stay below the threshold, a document that has none before it cannot reach the top, so such tokens
    are closed and bring no rows, however many documents hold them. A row of an open token goes on only if its
    own impact and the bounds of all other tokens reach the threshold, a pair only if its open tokens and the
    bounds of the closed ones do. ``least`` is a score that must be reached anyway, ``slack`` (``query_id``,
    ``slack``) the most that others add to a score of the query.
    """
    impact = _impact(F.col("tf"), F.col("len"), mean_length)
    postings = terms.select("source_id", "token", impact.alias("impact"))
    asked = weights.select("token").distinct()
    best = Window.partitionBy("token").orderBy(F.desc("impact"), "source_id")
    first = postings.join(asked, "token", "left_semi").withColumn("_no", F.row_number().over(best)).filter(F.col("_no") <= top_k)
    seeds = materialize(weights.join(first, "token").select("query_id", "source_id").distinct())
    by_score = Window.partitionBy("query_id").orderBy(F.desc("bm25_score"))
    kth = exact_scores(seeds, terms, weights, mean_length).withColumn("_no", F.row_number().over(by_score)).filter(F.col("_no") == top_k)
    from_here = Window.partitionBy("query_id").orderBy(F.desc("bound"), "token").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("query_id")
    added = slack if slack is not None else weights.select("query_id", F.lit(0.0).alias("slack")).limit(0)
    limits = weights.select("query_id").distinct().join(kth.select("query_id", "bm25_score"), "query_id", "left").join(added, "query_id", "left")
    reach = F.greatest(F.coalesce("bm25_score", F.lit(0.0)), F.lit(float(least))) - F.coalesce("slack", F.lit(0.0)) - F.lit(MARGIN)
    placed = weights.join(limits.select("query_id", reach.alias("threshold")), "query_id")
    placed = placed.withColumn("open", F.sum("bound").over(from_here) >= CLOSED * F.col("threshold"))
    placed = placed.withColumn("closed", F.sum(F.when(~F.col("open"), F.col("bound")).otherwise(0.0)).over(whole)).withColumn("others", F.sum("bound").over(whole) - F.col("bound"))
    opened = materialize(placed.filter("open").select("query_id", "token", "idf", "threshold", "closed", "others"))
    met = opened.join(postings, "token").filter(F.col("idf") * F.col("impact") + F.col("others") >= F.col("threshold"))
    got = met.groupBy("query_id", "source_id").agg(F.sum(F.col("idf") * F.col("impact")).alias("got"), F.first("threshold").alias("threshold"), F.first("closed").alias("closed"))
    return got.filter(F.col("got") + F.col("closed") >= F.col("threshold")).select("query_id", "source_id")


def bm25(queries: DataFrame, corpus: DataFrame, top_k: int | None = None, least: float = 0.0, slack: DataFrame | None = None) -> DataFrame:
    """``query_id``, ``source_id``, ``bm25_score`` of all pairs that share a token, or of those that can be among the ``top_k``.

    ``queries`` has ``query_id`` and ``query``; ``corpus`` has ``source_id`` and ``doc``, each id once. The corpus is
    tokenised once, into a table of counts without texts.
    """
    asked = asked_tokens(queries)
    terms, docs, mean_length = written_terms(corpus, asked)
    weights = token_weights(asked, terms, docs, mean_length)
    if top_k is None:
        part = F.col("idf") * _impact(F.col("tf"), F.col("len"), mean_length)
        return weights.join(terms, "token").groupBy("query_id", "source_id").agg(F.round(F.sum(part), 6).alias("bm25_score"))
    pairs = closed_candidates(weights, terms, mean_length, top_k, least, slack)
    return exact_scores(materialize(pairs), terms, weights, mean_length)


def name_boosts(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """``query_id``, ``source_id``, ``tags``, ``named``: how many tags of the source stand in the query, and whether its id does.

    A tag or id may stand anywhere in the query, not at word borders: one automaton over all tags and ids finds
    those of a query in one pass over it, and the terms found meet their sources in an equi join.
    """
    tags = F.filter(F.split(F.lower(clean("tags")), r"[;；,\s]+"), lambda t: t != "")
    names = corpus.select("source_id", F.explode(F.concat(
        F.transform(tags, lambda t: F.struct(t.alias("term"), F.lit(1).alias("tag"), F.lit(0).alias("id"))),
        F.array(F.struct(F.lower(clean("source_id")).alias("term"), F.lit(0).alias("tag"), F.lit(1).alias("id"))),
    )).alias("_n")).select("source_id", "_n.*").filter("term <> ''")
    asked = queries.select("query_id", F.lower(clean("query")).alias("low"))
    found = marker_hits(asked, names, "query_id", "low", every=False).select("query_id", "term")
    return names.join(found, "term").groupBy("query_id", "source_id").agg(F.sum("tag").alias("tags"), F.max("id").alias("named"))


#: Boosts by source type: types, words of which the query must hold one, boost.
TypeRules = tuple[tuple[tuple[str, ...], tuple[str, ...], float], ...]


def _type_boost(flags: Column, kind: Column, rules: TypeRules) -> Column:
    total = F.lit(0.0)
    for i, (types, _, boost) in enumerate(rules):
        total = total + F.when(kind.isin(*types) & F.get(flags, i), boost).otherwise(0.0)
    return total


def retrieve(queries: DataFrame, corpus: DataFrame, top_k: int = 4, min_score: float = 0.0, boost: bool = False, rules: TypeRules = ()) -> DataFrame:
    """The ``top_k`` sources of every query by score, then id, of those that reach ``min_score``.

    The score is BM25, with ``boost`` plus 0.12 for each tag that the query holds, 2 for the id itself and what the
    type ``rules`` give. ``corpus`` then has ``tags`` and ``source_type``. Sources that share nothing with a query
    score zero and can only matter with the smallest ids (of each type that a rule names), so those alone are added.
    """
    named = materialize(name_boosts(queries, corpus)) if boost else None
    most = None
    if boost:  # no source of a query gets more than this on top of its score
        of_names = named.groupBy("query_id").agg(F.max(0.12 * F.col("tags") + 2.0 * F.col("named")).alias("_most"))
        most = queries.select("query_id").distinct().join(of_names, "query_id", "left").select("query_id", (F.coalesce("_most", F.lit(0.0)) + sum(b for _, _, b in rules if b > 0)).alias("slack"))
    scored = bm25(queries, corpus, top_k, min_score, most).select("query_id", "source_id", "bm25_score", F.lit(0).cast("long").alias("tags"), F.lit(0).alias("named"))
    by_id = Window.partitionBy("_kind").orderBy("source_id")
    kinds = [t for types, _, _ in rules for t in types] if boost else []
    kind = clean("source_type") if kinds else F.lit("")
    fillers = corpus.select("source_id", F.when(kind.isin(*kinds), kind).otherwise("").alias("_kind") if kinds else kind.alias("_kind")).withColumn("_no", F.row_number().over(by_id)).filter(F.col("_no") <= top_k).select("source_id")
    fillers = materialize(fillers)  # top_k rows a kind
    zero = queries.select("query_id").crossJoin(fillers).select("query_id", "source_id", F.lit(0.0).alias("bm25_score"), F.lit(0).cast("long").alias("tags"), F.lit(0).alias("named"))
    every = scored.unionByName(zero)
    if boost:  # other pairs are left out unless their boosts alone can reach ``min_score``
        every = materialize(every)
        alone = named.filter(0.12 * F.col("tags") + 2.0 * F.col("named") + sum(b for _, _, b in rules if b > 0) >= min_score - MARGIN)
        met = named.join(every.select("query_id", "source_id").distinct(), ["query_id", "source_id"], "left_semi")
        every = every.unionByName(met.unionByName(alone).select("query_id", "source_id", F.lit(0.0).alias("bm25_score"), "tags", "named"))
    pairs = every.groupBy("query_id", "source_id").agg(F.max("bm25_score").alias("bm25_score"), F.max("tags").alias("_tags"), F.max("named").alias("_named"))
    extra = F.round(0.12 * F.col("_tags") + 2.0 * F.col("_named"), 6)
    if kinds:
        flags = F.array(*(F.coalesce(F.lit(False), F.lit(False)) if not words else F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.coalesce("query", F.lit("")), w)) for _, words, _ in rules))
        pairs = pairs.join(queries.select("query_id", flags.alias("_flags")), "query_id").join(corpus.select("source_id", clean("source_type").alias("_kind")), "source_id")
        extra = F.round(extra + _type_boost(F.col("_flags"), F.col("_kind"), rules), 6)
    made = pairs.withColumn("metadata_boost", extra).withColumn("retrieval_score", F.round(F.col("bm25_score") + F.col("metadata_boost"), 6)).filter(F.col("retrieval_score") >= min_score)
    best = Window.partitionBy("query_id").orderBy(F.desc("retrieval_score"), "source_id")
    return made.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k).select("query_id", "rank", "source_id", "bm25_score", "metadata_boost", "retrieval_score")


def retrieval_quality(retrieved: Column, expected: Column) -> dict[str, Column]:
    """Hits, recall and precision; recall is null without expectation."""
    hits = F.size(F.array_intersect(retrieved, expected))
    return {
        "hit_count": hits,
        "context_recall": F.when(F.size(expected) > 0, hits / F.size(expected)),
        "context_precision": F.when((F.size(expected) > 0) & (F.size(retrieved) > 0), hits / F.size(retrieved)),
    }
