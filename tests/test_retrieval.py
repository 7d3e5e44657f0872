"""Retrieval that closes common tokens, markers by automaton, JSON at any depth."""

import json
import random

import pytest
from pyspark.sql import functions as F

from arbiterlake.functions import jsontext
from arbiterlake.operators import claims, markers, retrieval, traces


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words[: rng.choice([5, 40, 300])]) for _ in range(n)) + " everywhere"
    corpus = [(i, text(rng.randint(1, 60))) for i in range(400)] + [(400, None), (401, "")]
    queries = [(i, text(rng.randint(1, 25))) for i in range(30)] + [(30, "everywhere"), (31, "nowhere"), (32, None)]
    return spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(corpus, "source_id int, doc string")


def test_closed_tokens_lose_nothing(spark, tables):
    queries, corpus = tables
    every = {}
    for r in retrieval.bm25(queries, corpus).collect():
        every.setdefault(r.query_id, []).append((-r.bm25_score, r.source_id))
    kept = {}
    for r in retrieval.bm25(queries, corpus, top_k=3).collect():
        kept.setdefault(r.query_id, []).append((-r.bm25_score, r.source_id))
    near = lambda rows: [(round(s, 4), i) for s, i in sorted(rows)]
    for q in every:
        third = sorted(every[q])[:3][-1][0]
        assert near(x for x in kept[q] if x[0] < third - 1e-4) == near(x for x in every[q] if x[0] < third - 1e-4)
        assert len(kept[q]) >= min(3, len(every[q]))
    assert sum(map(len, kept.values())) < 0.6 * sum(map(len, every.values()))


def test_word_of_every_document_brings_no_row_a_document(spark, tables, monkeypatch):
    queries, corpus = tables
    opened, write = [], retrieval.materialize
    monkeypatch.setattr(retrieval, "materialize", lambda df: opened.append(df) or write(df))
    retrieval.bm25(queries.filter("query_id < 30"), corpus, top_k=3)
    (table,) = [d for d in opened if "threshold" in d.columns]
    assert table.filter("token = 'everywhere'").count() == 0 and table.count() > 30


def test_marker_hits(spark):
    texts = [(1, "aababa xx"), (2, None), (3, ""), (4, "🙂ab漢字ab")]
    terms = spark.createDataFrame([("ab",), ("aba",), ("字a",), ("",), (None,), ("ab",)], "term string")
    df = spark.createDataFrame(texts, "term_id int, text string")
    want = sorted((i, t, at) for i, text in texts for t in ("ab", "aba", "字a") for at in range(len(text or "")) if text.startswith(t, at))
    for size in (4 << 20, 2):
        assert sorted(map(tuple, markers.marker_hits(df, terms, "term_id", "text", slice_bytes=size).collect())) == want
        first = markers.marker_hits(df, terms, "term_id", "text", every=False, slice_bytes=size).collect()
        assert sorted(map(tuple, first)) == sorted({(i, t): (i, t, at) for i, t, at in reversed(want)}.values())
    assert markers.marker_hits(df, terms.limit(0), "term_id", "text").count() == 0


def test_packs_from_files(spark, tmp_path):
    (tmp_path / "pack.json").write_text(json.dumps({"reviewable": ["must", "shall"], "denying": ["not"]}))
    pack = markers.load_pack(spark, str(tmp_path / "pack.json"), claims.Markers)
    assert pack == claims.Markers(reviewable=("must", "shall"), denying=("not",))
    (tmp_path / "bad.json").write_text(json.dumps({"promises": "always"}))
    with pytest.raises(ValueError, match="not lists"):
        markers.load_pack(spark, str(tmp_path / "bad.json"), traces.TracePack)
    with pytest.raises(ValueError, match="unknown"):
        markers.load_pack(spark, str(tmp_path / "pack.json"), traces.TracePack)


def strings(v):
    if isinstance(v, str):
        return [v]
    return [s for x in (v.values() if isinstance(v, dict) else v) for s in strings(x)] if isinstance(v, (dict, list)) else []


def test_json_of_any_depth(spark):
    rng = random.Random(2)

    def value(depth):
        kind = rng.choice("sslond") if depth else "s"
        if kind == "l":
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        if kind == "o":
            return {f"k{rng.randint(0, 99)}\"\\:é{i}": value(depth - 1) for i in range(rng.randint(0, 3))}
        return rng.choice([None, True, 3, -1.5]) if kind in "nd" else rng.choice(["", "a", 'q"uo\\te', "line\nbreak", "漢🙂", '{"k": "v"}', "colon:", "\u0007"])

    made = [value(6) for _ in range(120)] + [["x" * 200_000], {"a": {"b": {"c": ["deep"]}}}]
    texts = [json.dumps(v, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, v in enumerate(made)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.s, r.c) for r in df.select("i", jsontext.string_values(F.col("t")).alias("s"), jsontext.canonical(F.col("t")).alias("c")).collect()}
    for i, v in enumerate(made):
        assert got[i][0] == (None if v is None else strings(v)), texts[i]
        assert got[i][1] == json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")), texts[i]
    plain = spark.createDataFrame([("[not json",), ("words",), (None,), ("",)], "t string").select(jsontext.string_values(F.col("t")), jsontext.canonical(F.col("t"))).collect()
    assert [tuple(r) for r in plain] == [(None, "[not json"), (None, "words"), (None, None), (None, "")]


def test_text_after_a_json_value_is_plain_text(spark):
    texts = ['4703443633947811 words that follow a number', '{"a": "a value long enough"} and more words', '[1], [2', '1, 2 and three words', '{"a": 1} {"b": 2}', '1,"x"] words go on', "true story of a tenant"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, output_text string")
    got = {i: [(r.claim_index, r.claim) for r in claims.split_claims(df).collect() if r.i == i] for i in (0, 1, 6)}
    assert got[0] == [(1, "words that follow a number")] and got[1] == [(1, texts[1])] and got[6] == [(1, texts[6])]
    plain = df.select("i", jsontext.string_values(F.col("output_text")).alias("s"), jsontext.canonical(F.col("output_text")).alias("c"), jsontext.fenced_object(F.col("output_text")).alias("o")).collect()
    assert all(r.s is None and r.c == texts[r.i] for r in plain) and plain[4].o is None and plain[1].o == '{"a": "a value long enough"}'


def test_claims_need_no_worker(spark):
    df = spark.createDataFrame([('{"b": ["first claim text。second claim text", {"a": "short"}], "c": "third claim text"}',), ("12345678901",)], "output_text string")
    made = claims.split_claims(df)
    assert [(r.claim_index, r.claim) for r in made.collect()] == [(1, "first claim text"), (2, "second claim text"), (3, "third claim text")]
    plan = made._jdf.queryExecution().toString()
    assert "ArrowEval" not in plan and "Python" not in plan


def test_command_line_entailment(spark, tmp_path):
    from arbiterlake import cli

    runs = [(1, "c1", "tenant must pay rent [SRC-1]. hello nice weather today"), (2, "c2", "tenant must pay rent [SRC-2]"), (3, "c3", "tenant must pay rent now")]
    spark.createDataFrame(runs, "run_id int, sample_id string, output_text string").write.parquet(f"{tmp_path}/runs.parquet")
    spark.createDataFrame([(1, "SRC-1", "the tenant must pay the rent src"), (2, "SRC-2", "the tenant must pay the rent src")], "run_id int, source_id string, text string").write.parquet(f"{tmp_path}/contexts.parquet")
    spark.createDataFrame([("c1", ["SRC-1"]), ("c2", ["SRC-1"])], "case_id string, allowed_sources array<string>").write.parquet(f"{tmp_path}/cases.parquet")
    (tmp_path / "pack.json").write_text(json.dumps({"reviewable": ["must"]}))
    common = ["build-claim-entailment", "--runs", f"{tmp_path}/runs.parquet", "--contexts", f"{tmp_path}/contexts.parquet", "--output"]
    assert cli.main([*common, f"{tmp_path}/all.parquet"]) == 0
    assert cli.main([*common, f"{tmp_path}/some.parquet", "--markers", f"{tmp_path}/pack.json", "--rag-only", "yes", "--cases", f"{tmp_path}/cases.parquet"]) == 0
    label = lambda name: {(r.run_id, r.claim): r.entailment_label for r in spark.read.parquet(f"{tmp_path}/{name}.parquet").collect()}
    assert label("all")[(3, "tenant must pay rent now")] == "no_citation" and label("all")[(1, "tenant must pay rent [SRC-1]. hello nice weather today")] == "supported"
    assert label("some") == {(1, "tenant must pay rent [SRC-1]. hello nice weather today"): "supported", (2, "tenant must pay rent [SRC-2]"): "out_of_scope_source"}


def test_subtypes(spark):
    from arbiterlake.operators import judging

    df = spark.createDataFrame([("平台 责任", None), (None, "证据 与 管辖"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(judging.gold_subtype(F.col("a"), F.col("b"))).collect()] == ["platform_liability_unclear", "evidence_chain_unclear", "general_legal_risk"]


def test_only_asked_tokens_are_written(spark):
    asked = spark.createDataFrame([(1, "alpha 漢字"), (2, "none")], "query_id int, query string")
    corpus = spark.createDataFrame([(1, "alpha beta beta gamma 漢字漢"), (2, "beta delta"), (3, ""), (4, None)], "source_id int, doc string")
    terms, docs, mean = retrieval.written_terms(corpus, retrieval.asked_tokens(asked))
    assert {(r.source_id, r.len, r.token, r.tf) for r in terms.collect()} == {(1, 9, "alpha", 1), (1, 9, "漢", 2), (1, 9, "字", 1), (1, 9, "漢字", 1)}
    assert (docs, mean) == (4, 11 / 4)


def test_boosts_alone_can_reach_the_minimum(spark):
    asked = spark.createDataFrame([(1, "see doc-7 on red blue")], "query_id int, query string")
    corpus = spark.createDataFrame([("doc-7", "zzz", "red;blue", ""), ("doc-8", "zzz", "red", ""), ("doc-9", "see red", "", "")], "source_id string, doc string, tags string, source_type string")
    got = lambda least: [(r.source_id, r.metadata_boost) for r in retrieval.retrieve(asked, corpus, 3, least, True).orderBy("rank").collect()]
    assert got(2.2) == [("doc-7", 2.24)] and {x for x, _ in got(0.0)} == {"doc-7", "doc-8", "doc-9"} and dict(got(0.0))["doc-8"] == 0.12
