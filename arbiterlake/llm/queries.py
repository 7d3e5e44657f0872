"""The registered queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bytebpe, jaccard, langid, linededup, packing, pii, ppm, quality, sharding, topk, vectorcodes, warc
from .common import fresh_folder, id_bucket


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(_read(spark, sf_dir, "documents"), order=5, folds=7, held_out=2)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(_read(spark, sf_dir, "documents"), n_shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(_read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("quality").alias("p_good"))


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard.jaccard_components(_read(spark, sf_dir, "documents"), width=5, percent=80)
    return joined.select("doc_id", "n_shingles", "component_id", "n_links")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bytebpe.digest_documents(_read(spark, sf_dir, "documents"), tokenizer_contents("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", id_bucket("doc_id", 3) == 1)
    network = langid.fit(docs.filter(~F.col("held_out")))
    return langid.identify(docs, network, keep=("doc_id", "held_out"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(linededup.remove_site_boilerplate(_read(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def _cleaned(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").alias("clean_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("clean_md5"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda c: c["base"])
    count = lambda kind: F.size(F.filter(base, lambda c: c["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in pii.KINDS[: pii.BASE_KINDS]), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans")
    )


def tokenizer_contents(name: str) -> str:
    """A public tokenizer's file, read where the driver runs; the contents travel with the job."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    contents = tokenizer_contents("word_bpe_49k.json")
    return packing.pack_documents(_read(spark, sf_dir, "documents"), contents, capacity=4096, end_id=1, with_ids=False)


def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = _read(spark, sf_dir, "pages"), fresh_folder(spark)
    warc.write_bundles(pages, path, min_bytes=0)
    id_type = dict(pages.dtypes)["page_id"]
    read = warc.read_bundles(spark, path, with_payload=False)
    return read.select(F.col("id").cast(id_type).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(id_type).alias("refers_to"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vectorcodes.compress_vectors(_read(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096.0)
    return coded.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        second = f.read()
    return align.align_documents(_read(spark, sf_dir, "documents"), tokenizer_contents("byte_bpe_50k.json"), second)[0]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sharding": op2_sharding,
    "op3_quality_rules": op3_quality_rules,
    "op4_exact_top_k": op4_exact_top_k,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_warc_bundles": op11_warc_bundles,
    "op12_vector_codes": op12_vector_codes,
    "op13_cross_tokenizer_alignment": op13_cross_tokenizer_alignment,
}

#: CRC-32 of a text in SQL: the table from its polynomial, then one step a byte.
_CRC = """
WITH crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END)) AS t),
crc AS (SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
  list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) END AS text_crc32 FROM documents, crc_table)
"""

#: Words of a text, lower-cased A-Z, cut at the six ASCII spaces.
_WORDS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _lloyd_sql(rounds: int) -> str:
    """The rounds one after the other: distances to every entry, the nearest, floors of means."""
    floor = "CASE WHEN s % n <> 0 AND s < 0 THEN s // n - 1 ELSE s // n END"
    steps = [
        """WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, k AS part, e[k * len(e) // 8 + 1 : (k + 1) * len(e) // 8] AS x FROM v, range(8) t(k)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM v QUALIFY idx < 16),
c0 AS MATERIALIZED (SELECT part, idx, x AS c FROM p JOIN s USING (vec_id))"""
    ]
    near = "SELECT vec_id, label, part, min_by(idx, k) AS idx, min(k).d AS d FROM (SELECT vec_id, label, part, idx, {{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'i': idx}} AS k FROM p JOIN c{0} USING (part)) GROUP BY ALL"
    near = near.replace("GROUP BY ALL", "GROUP BY vec_id, label, part")
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        steps.append(f"""m{r} AS (SELECT part, idx, list({floor} ORDER BY pos) AS c FROM (SELECT part, idx, pos, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT part, idx, generate_subscripts(x, 1) AS pos, unnest(x) AS y FROM a{r} JOIN p USING (vec_id, part)) GROUP BY part, idx, pos) GROUP BY part, idx),
c{r + 1} AS MATERIALIZED (SELECT part, idx, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (part, idx))""")
    steps.append(f"f AS MATERIALIZED ({near.format(rounds)})")
    steps.append("r AS (SELECT vec_id, label, string_agg(format('{:02x}', idx), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY vec_id, label)")
    return ",\n".join(steps) + f"""
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, idx)) FROM c{rounds}) AS codebooks_sha256 FROM r"""


ORACLE_SQL: dict[str, str] = {
    "op11_warc_bundles": """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  row_number() OVER (PARTITION BY h ORDER BY page_id) AS k, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first END AS refers_to FROM d
""",
    "op12_vector_codes": _lloyd_sql(6),
    "op4_exact_top_k": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
""",
    "op5_ngram_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT s.doc_id, len(g) AS n_shingles, (SELECT min(b) FROM c WHERE c.a = s.doc_id) AS component_id, (SELECT count(*) FROM l WHERE l.a = s.doc_id) AS n_links FROM s
""",
    "op8_line_dedup": """
WITH l AS (SELECT doc_id, source, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents)),
k AS (SELECT *, CASE WHEN regexp_matches(line, '[^\\x20\\x09-\\x0D]') THEN trim(line) END AS x FROM l),
b AS (SELECT x, min(doc_id * 1000000 + i) AS first FROM k WHERE x IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= 5),
m AS (SELECT k.*, b.x IS NOT NULL AND doc_id * 1000000 + i <> first AS gone FROM k LEFT JOIN b ON k.x = b.x),
d AS (SELECT doc_id, count(*)::INT AS n_lines, count_if(gone)::INT AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS clean FROM m GROUP BY 1)
SELECT doc_id, n_lines, n_removed, length(clean)::INT AS clean_chars, md5(clean) AS clean_md5 FROM d
""",
    "op2_sharding": _CRC + """
, o AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, text_crc32, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM crc),
p AS (SELECT *, sum(size) OVER (ORDER BY pos) - size AS ahead, sum(size) OVER () AS total FROM o),
h AS (SELECT *, least(15, ((2 * ahead + size) * 16) // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard, pos - min(pos) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard FROM h
""",
}
