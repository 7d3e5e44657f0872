"""The training-data operators against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import bisect
import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbiterlake.llm import bytebpe, jaccard, langid, linededup, packing, pii, ppm, quality, sharding, topk, wordbpe

DOCS = "doc_id long, text string, source string, size int"
ODD = [(1, None, "a", 5), (None, "alpha beta gamma delta epsilon", None, 5), (2, "", "b", 5), (2, "", "b", 5), (3, "x" * 5000, "b", 5), (3, "one two\nthree", "b", 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def contents(name):
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


# 1 -------------------------------------------------------------------------------------------------
def plain_ppm(train, text, order):
    """Method D with exclusion, context by context."""
    end = ppm.END
    seen = collections.defaultdict(collections.Counter)
    for s in train:
        row = [end] * order + list(s) + [end]
        for i in range(order, len(row)):
            for k in range(order + 1):
                seen[tuple(row[i - k : i])][row[i]] += 1
    total, row = 0.0, [end] * order + list(text) + [end]
    for i in range(order, len(row)):
        out = set()
        for k in range(order, -1, -1):
            node = seen.get(tuple(row[i - k : i]))
            if node is None:
                continue
            left = {s: 2 * c - 1 for s, c in node.items() if s not in out}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if row[i] in left:
                total += np.log10(left[row[i]] / whole)
                break
            total += np.log10(len(left) / whole)
            out |= set(left)
        else:
            total -= np.log10(256 - len(out))
    return total


def test_ppm_equals_plain(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["ab", "abc", "Bca", "c", "é", "da"], k=rng.randint(0, 12)))) for i in range(40)]
    df = spark.createDataFrame([*rows, (None, None), (7, rows[7][1])], "doc_id long, text string")
    got = ppm.score_documents(df, order=3).collect()
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    every = [*rows, (None, None), (7, rows[7][1])]
    norm = lambda t: b" ".join((t or "").encode().lower().split())
    train = [norm(t) for d, t in every if not held(d)]
    words = collections.Counter(w for s in train for w in [*s.split(), b"\xff"])
    n, v = sum(words.values()), len(words)
    want = sorted((str(d), round(plain_ppm(train, norm(t), 3), 4), round(sum(np.log10((words.get(w, 0) + 1) / (n + v + 1)) for w in [*norm(t).split(), b"\xff"]), 6)) for d, t in every)
    assert sorted((str(r.doc_id), round(r.score, 4), round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    sliced = ppm.score_documents(df, order=3, slice_grams=100, slice_words=3).collect()
    assert sorted(round(r.score, 4) for r in sliced) == sorted(round(r.score, 4) for r in got)
    assert sorted(round(r.base_score, 6) for r in sliced) == sorted(round(r.base_score, 6) for r in got)


def test_ppm_slices_come_again(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["ab", "abc", "Bca", "c", "é", "da"], k=rng.randint(0, 12)))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(12)  # several tasks a worker
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "3")  # several batches a task
    try:
        cuts = ({}, {"slice_grams": 100, "slice_words": 3}, {"slice_grams": 60, "pass_bytes": 1})  # the last: a pass for every slice
        whole, sliced, passes = ([(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4)) for r in ppm.score_documents(df, order=3, **cut).orderBy("doc_id").collect()] for cut in cuts)
    finally:
        spark.conf.set(key, before)
    assert len(whole) == 120 and whole == sliced == passes


def test_ppm_edges(odd, empty):
    assert ppm.score_documents(odd).count() == len(ODD)
    assert ppm.score_documents(empty).count() == 0


# 2 -------------------------------------------------------------------------------------------------
def test_shards(spark, odd, empty):
    df = spark.createDataFrame([(i % 50, "x" * (i * 37 % 91)) for i in range(500)], "doc_id long, text string")
    rows = sharding.shard_by_bytes(df, 8).collect()
    sizes = collections.Counter()
    slots = collections.defaultdict(list)
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        assert r.size == r["size"]
    assert len(rows) == 500 and len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 92
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sum(r["size"] for r in sharding.shard_by_bytes(odd, 4).collect()) == sum(len((t or "").encode()) + 1 for _, t, _, _ in ODD)
    assert sharding.shard_by_bytes(empty, 4).count() == 0


def test_shard_files_hold_all_rows(spark, odd, tmp_path):
    sharding.write_shards(odd, f"{tmp_path}/s", 3)
    assert spark.read.parquet(f"{tmp_path}/s").count() == len(ODD)


# 3 -------------------------------------------------------------------------------------------------
def plain_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = collections.Counter(windows)
    return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)})


def test_repeated_words():
    rng = random.Random(2)
    for _ in range(200):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        assert quality.repeated_words(words) == plain_repeats(words)


def plain_base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeats = plain_repeats(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), repeats, len(words) < 10 or 100 * repeats > 20 * len(words))


def rule_holds(sql, row):
    return eval(re.sub(r"(\w+) between ([^a]+) and (.+)", r"\2 <= \1 <= \3", sql).replace("false", "False"), {}, row)  # noqa: S307


def test_quality_counts_and_verdict_equal_plain(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice(["a", "b", "cé", "#", "|", "日本", " ", " ", "\n", "\t", "\x0b", "\u00a0", "\x1c"]) for _ in range(rng.randint(0, 160))) for _ in range(400)] + [None, "", " \n "]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    texts += [r.text for r in docs]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = quality.score_quality(df).collect()
    model = quality.fit(quality.measured(df))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base_counts(texts[r.doc_id])
        odds = np.log(model.prior / (1 - model.prior))
        for rule, ratios in zip(quality.RULES, model.ratios):
            odds += ratios[0] if rule_holds(rule.bad, r.asDict()) else ratios[2] if rule_holds(rule.good, r.asDict()) else ratios[1]
        assert abs(r.quality - 1 / (1 + np.exp(-odds))) < 1e-9 and r.kept == (not r.base_failed and r.quality >= 0.5)


def test_quality(spark, odd, empty):
    rng = random.Random(8)
    words = ["plain", "words", "form", "ordinary", "sentences", "about", "nothing", "at", "all", "and", "go", "on", "for", "some", "while"]
    rows = [(i, "Here is " + " ".join(rng.choices(words, k=20 + 9 * (i % 8))) + ".") for i in range(80)]
    rows += [(100 + i, " ".join(f"w{i}x{j}###" for j in range(60))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.score_quality(df).collect()}
    assert not any(got[100 + i].kept for i in range(12))
    assert all(got[i].kept for i in range(80) if not got[i].base_failed)
    kept = quality.filter_quality(df)
    assert kept.columns == ["doc_id", "text"] and kept.count() == sum(r.kept for r in got.values())
    assert quality.score_quality(odd).count() == len(ODD) and quality.filter_quality(odd.withColumn("n_words", F.lit("mine"))).columns[-1] == "n_words"
    assert quality.score_quality(empty).count() == 0


# 4 -------------------------------------------------------------------------------------------------
def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)] + [(301, None), (302, [1.0, None]), (303, [float("nan")] * 8), (304, [0.0] * 8), (305, [1.0, 2.0]), (None, [1.0] * 8)]
    rows += [(400, rows[5][1]), (401, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (4096, 7):
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, block=block).collect()
        fine = {i: np.floor(1024 * np.array(v)).astype(np.int64) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
        want = set()
        for q in (i for i in fine if i % 50 == 0):
            order = sorted((-int(fine[q] @ x), i) for i, x in fine.items() if i != q and len(x) == len(fine[q]))[:5]
            want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(order)}
        assert {tuple(r) for r in got} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_searches_every_vector_of_a_query_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [None, 9.0]), (50, [None, 1.0]), (50, [1.0, 1.0]), (1, [3.0, 0.0]), (2, [0.0, 4.0]), (3, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = [(i, v) for i, v in rows if None not in v]
    want = set()
    for q in (0, 50):
        pairs = sorted((-int(np.dot(v, x)), i) for j, v in good if j == q for i, x in good if i != q)[:4]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(pairs)}
    for block in (4096, 1):
        assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, k=4, scale=1.0, block=block).collect()} == want


def test_top_k_bounds_prune_and_lose_nothing():
    rng = np.random.default_rng(11)
    centers = rng.normal(0, 300, (20, 64))
    clustered = np.floor(centers[rng.integers(0, 20, 8000)] + rng.normal(0, 60, (8000, 64)))
    spread = np.floor(rng.normal(0, 120, (8000, 64)))
    for x, most in ((clustered, 0.25), (spread, 0.6)):
        ids = np.arange(len(x))
        search = topk.Search(ids[::100], x[::100], 10)
        for a in range(0, len(x), 2048):
            search.add(ids[a : a + 2048], x[a : a + 2048])
        for i, (score, name) in zip(ids[::100], search.best):
            all_ = x @ x[i]
            order = [j for j in np.lexsort((ids, -all_)) if j != i][:10]
            assert name.tolist() == order and score.tolist() == all_[order].tolist()
        assert search.passed == sorted(search.passed, reverse=True) and search.passed[-1] < most * search.passed[0], search.passed


def test_top_k_large_numbers():
    q, x = np.array([[2.0**40, 3.0]]), np.array([[2.0**40, 1.0]])
    assert topk.exact(q, x)[0, 0] == 2**63 - 1


# 5 -------------------------------------------------------------------------------------------------
def plain_jaccard(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    link = [[j for j in range(len(rows)) if j != i and s and 100 * len(s & sets[j]) >= 80 * len(s | sets[j])] for i, s in enumerate(sets)]
    least = {}
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least[i] = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
    return sorted(((rows[i][0], len(sets[i]), least[i], len(link[i])) for i in range(len(rows))), key=str)


def test_jaccard(spark, empty):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = rng.choices(vocabulary, k=80)
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 3, 5, 30])))) for i in range(60)]
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(80)] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000 + i, " ".join(rng.choices(vocabulary, k=15) + base[:40])) for i in range(90)]
    rows += [(5, None), (None, "a b c d e f"), (7, ""), (8, "A b c d e f"), (8, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(df, block=32).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_jaccard(rows)
    assert jaccard.jaccard_components(empty).count() == 0
    kept = [r.doc_id for r in jaccard.drop_near_duplicates(df.withColumn("cls", F.lit(0)).withColumn("_keep", F.lit(0)).withColumn("_first", F.lit(0))).collect()]
    assert sum(1 for d in kept if d is not None and 1000 <= d < 2000) == len({r[2] for r in plain_jaccard(rows) if r[0] is not None and 1000 <= r[0] < 2000 and r[2] == r[0]})


def test_prefix_bound_loses_nothing():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(5, 60))
        a = rng.choice(10**6, n, replace=False)
        b = np.concatenate([a[: int(rng.integers(n // 2, n + 1))], rng.choice(10**6, int(rng.integers(0, 8)))])
        a, b = np.unique(a), np.unique(b)
        if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
            assert len(np.intersect1d(jaccard._first(a, 80), jaccard._first(b, 80)))


# 6 -------------------------------------------------------------------------------------------------
def test_byte_bpe_equals_library(spark, odd, empty):
    import public_tokenizers
    import tiktoken

    own = bytebpe.ByteBpe(contents("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})
    rng = random.Random(1)
    texts = ["<|endoftext|>", "aaaa" * 300, "  \n\n  x  ", "日本語 テキスト", "", "it's we'll 12345"] + ["".join(rng.choices("abcdet hnsé.\n", k=80)) for _ in range(800)]
    for t in texts:
        assert own.encode(t) == library.encode_ordinary(t)
        assert own.decode(own.encode(t)) == t.encode()
    vocabulary = contents("byte_bpe_50k.tiktoken")
    encoded = bytebpe.encode_documents(odd, vocabulary, public_tokenizers.PATTERN)
    assert [bytes(r.raw).decode() for r in bytebpe.decode_documents(encoded, vocabulary, public_tokenizers.PATTERN).collect()] == [t or "" for _, t, _, _ in ODD]
    digests = bytebpe.digest_documents(odd, vocabulary, public_tokenizers.PATTERN).collect()
    assert {r.decoded_sha256 for r in digests} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t, _, _ in ODD}
    assert bytebpe.digest_documents(empty, vocabulary, public_tokenizers.PATTERN).count() == 0


# 7 -------------------------------------------------------------------------------------------------
def test_language_id_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 3 == 1)
    net = langid.fit(docs.filter("not held"), per_label=150)
    got = langid.identify(docs.filter("held"), net, keep=("doc_id", "lang")).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_ids_named_like_outputs_come_back(spark):
    df = spark.createDataFrame([(5, "some words of plain text", "en")], "n_words long, text string, lang_pred string")
    assert quality.score_quality(df, id_col="n_words").first().n_words_id == 5 and quality.score_quality(df, id_col="n_words").first().n_words == 5
    assert langid.identify(df, small_network()[0], keep=("n_words", "lang_pred")).first().lang_pred_in == "en"


def test_language_id_edges(spark, odd, empty):
    net = langid.fit(odd.withColumn("lang", F.lit("xx")))
    assert {r.doc_id: r.lang_pred for r in langid.identify(odd.filter("doc_id < 3"), net).collect()} == {1: "und", 2: "und"}
    assert langid.identify(spark.createDataFrame([(1, "123 !?")], "doc_id long, text string"), net).first().lang_pred == "und"
    none = langid.fit(empty.withColumn("lang", F.lit(None).cast("string")))
    assert langid.identify(odd, none).filter("lang_pred <> 'und'").count() == 0 and langid.identify(empty, none).count() == 0


def small_network(seed=3, languages=3):
    rng = np.random.default_rng(seed)
    net = langid.train(np.zeros((0, 40), np.uint8), np.zeros(0, int), [f"l{i}" for i in range(languages)], filters=4)
    for table in (*net.filters.values(), *net.bias.values(), net.head, net.offset):
        table[...] = rng.normal(0, 0.5, table.shape)
    return net, rng


def test_language_network_equals_plain_loops():
    net, rng = small_network()
    x = rng.integers(97, 123, (25, 40)).astype(np.uint8)
    got = net.log_probabilities(x, net.tables())
    for row, logs in zip(x, got):
        h = [max(0.0, max(sum(float(t[k][row[i + k], f]) for k in range(w)) for i in range(len(row) - w + 1)) + float(net.bias[w][f])) for w, t in net.filters.items() for f in range(4)]
        z = [sum(a * float(net.head[j, c]) for j, a in enumerate(h)) + float(net.offset[c]) for c in range(3)]
        want = np.array(z) - np.log(np.exp(z).sum())
        assert np.allclose(logs, want, atol=1e-4)
        assert np.allclose(net.pooled(row[None, :])[0][0], h, atol=1e-5)


def test_language_gradients_equal_differences():
    net, rng = small_network()
    for group in (net.filters, net.bias):
        for w in group:
            group[w] = group[w].astype(np.float64)
    net.head, net.offset = net.head.astype(np.float64), net.offset.astype(np.float64)
    x, y = rng.integers(97, 101, (12, 40)).astype(np.uint8), rng.integers(0, 3, 12)
    loss = lambda: -net.log_probabilities(x, net.tables())[np.arange(12), y].mean()
    params = [*net.filters.values(), *net.bias.values(), net.head, net.offset]
    for table, grad in zip(params, langid.gradients(net, x, y)):
        for at in {tuple(int(rng.integers(0, n)) if n != 256 else int(rng.integers(97, 101)) for n in table.shape) for _ in range(6)}:
            before, step = table[at], 1e-6
            table[at] = before + step
            up = loss()
            table[at] = before - step
            down = loss()
            table[at] = before
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-5


def test_language_rows_are_bounded_whatever_the_ids(spark):
    rows = [(None, f"text number {i} without id", "aa") for i in range(300)] + [(7, "the very same row", "aa")] * 200 + [(7, f"other text {i}", "bb") for i in range(200)] + [(i, "same words", "cc") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = collections.Counter(r.label for r in langid.chosen_rows(df, "lang", "text", "doc_id", 20).collect())
    assert got == {"aa": 20, "bb": 20, "cc": 9}
    long = spark.createDataFrame([(1, "wort " * 4000, "de")], "doc_id long, text string, lang string")
    assert langid.chosen_rows(long, "lang", "text", "doc_id", 20).first().text == "wort " * 4000


# 8 -------------------------------------------------------------------------------------------------
def test_line_dedup(spark, odd, empty):
    line = "the common footer of many sites"
    rows = [(i, f"own text number {i} of this page\n{line}\n{line if i == 3 else 'tail ' + str(i)}", f"site{i}") for i in range(6)]
    rows += [(10 + i, f"rare footer here yes\nbody {i} is different from others", f"site{i % 3}") for i in range(6)]
    rows += [(20, None, "site1"), (21, "", None), (22, line, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_removed", F.lit("old"))
    got = {r.doc_id: r for r in linededup.remove_site_boilerplate(df).collect()}
    assert line in got[0].text and all(line not in got[i].text for i in range(1, 6)) and got[3].n_removed == 2
    assert all("rare footer" in got[10 + i].text for i in range(6))  # three sites only
    assert got[20].text is None and got[20].n_lines == 0 and got[21].n_lines == 1 and got[22].text == ""
    assert linededup.remove_site_boilerplate(odd).count() == len(ODD) and linededup.remove_site_boilerplate(empty).count() == 0
    clash = linededup.remove_site_boilerplate(df.withColumn("_key", F.lit("k")).withColumn("_gone", F.lit(1)).withColumn("_line", F.lit(None).cast("string")))
    assert {(r.doc_id, r.text, r._key, r._gone) for r in clash.collect()} == {(d, r.text, "k", 1) for d, r in got.items()}
    long = spark.createDataFrame([(i, "\n".join(f"line {j}" for j in range(20_000)), f"s{i}") for i in range(6)], "doc_id long, text string, source string")
    assert sorted(r.n_removed for r in linededup.remove_site_boilerplate(long).collect()) == [0] + [20_000] * 5


def test_short_lines_of_many_sites_go(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"own text number {i} of this page\nLog in\n\t\n", f"site{i}", 0) for i in range(6)], "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {i: f"own text number {i} of this page\n" + ("Log in\n" if i == 0 else "") + "\t\n" for i in range(6)}


# 9 -------------------------------------------------------------------------------------------------
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    found = []
    for k, (name, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[name]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_pii_base_spans(spark, empty):
    rng = random.Random(3)
    texts = ["a@b.c_d@e.f x@y@z.com", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111 1111 1111 4111  1111", "é+1 (988) 555-2485é 4111111111111111", None, "", "1" * 20000, "a" * 30000, "1.2.3." * 4000, "a@" + "b." * 6000, "1 " * 9000]
    texts += ["".join(rng.choices("a1.@+- 4(é", k=60)) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        assert [(s.start, s.kind, s.stop) for s in r.spans if s.base] == plain_base(texts[r.doc_id])
    assert pii.find_pii(empty).count() == 0


def test_redaction(spark, odd):
    df = spark.createDataFrame([(1, "mail a.b@c.org or password=abcdef1234 now", "x"), (2, "nothing here", "y"), (3, None, "z")], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.redact_pii(df).collect()}
    assert "<EMAIL>" in got[1].text and "a.b@c.org" not in got[1].text and got[2].text == "nothing here" and got[3].text is None and got[2].spans == "y"
    assert pii.redact_pii(odd).count() == len(ODD)


def test_secrets_of_any_length_and_case(spark):
    names = ["password", "TOKEN", "Api_Key", "API_KEY", "Password"]
    rows = [(i, f"note {n}{sep}{'aB3_' * size} end") for i, (n, sep, size) in enumerate((n, sep, size) for n in names for sep in ("=", " = ", ": ") for size in (3, 128, 2000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in df.select("text", pii._proposed(F.col("text"), "secret").alias("spans")).collect():
        assert [(s.start, s.stop) for s in r.spans] == [(r.text.index("aB3_"), len(r.text) - len(" end"))]
    assert not [r for r in pii.redact_pii(df).collect() if "aB3_" in r.text]


def test_redaction_leaves_no_part_of_overlapping_or_long_values(spark):
    rows = [(1, "say token=abc/longpart@x.com now"), (2, "token=" + "aB3_" * 200 + " end"), (3, "to " + "n" * 90 + " [at] host" + " [dot] part" * 12 + " [dot] org end")]
    rows += [(10 + i, f"write to user{i}@mail.example.org or password={'x' * 9}{i} today") for i in range(60)]
    got = {r.doc_id: r.text for r in pii.redact_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] in ("say <EMAIL> now", "say token=<SECRET> now") and got[2] == "token=<SECRET> end"
    assert "xxxx" not in got[10] and "@" not in got[10]


def test_added_spans_equal_plain(spark):
    import regex

    rng = random.Random(9)
    parts = ["a.b at x", "joe [at] host [dot] org", "joe (at) h.de", "(212) 555-0100", "212.555.0100", "123-45-6789", "DE89 3704 0044 0532 0130 00", "GB29" + "ABCD" * 9, "AKIA" + "Q" * 16, "token=abcdefgh", "password: x/y-zz_1", "1.2.3.4", "4111 1111 1111 1111", "é", "\n", "x@y.z", "+1 212 555 0100", "", "-", "a" * 70 + "[at]b.c"]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", ",", "", "é "]) for _ in range(rng.randint(0, 14))) for _ in range(400)] + [None, "", "1.2.3.4 " * 3000, "k=" + "token=abcdefgh1 " * 1500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    compiled = [regex.compile(pii.PATTERNS[k]) for k in pii.KINDS]
    found = df.select("doc_id", pii.candidates("text").alias("spans")).collect()
    for r in found:
        text = texts[r.doc_id] or ""
        plain = sorted((m.start(), k, m.end(), m[0], text[max(0, m.start() - 4) : m.start()][-1:]) for k, p in enumerate(compiled) for m in p.finditer(text))
        assert [(s.start, s.kind, s.stop, s.value) for s in r.spans] == [x[:4] for x in plain]
    assert sum(len(r.spans) for r in found) > 5000


def test_span_classifier_decides_as_its_features_say(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = pii.materialize(docs.select("doc_id", pii.candidates("text").alias("spans")))
    _, weights = pii.train(found)

    def features(c):
        v, digits = c.value, len(re.sub("[^0-9]", "", c.value))
        cue, counter = (re.search(p, c.before) for p in (pii.CUES, pii.COUNTER_CUES))
        edge = lambda ch: not ch or not re.match("[A-Za-z0-9]", ch)
        return (
            c.kind, 2 if c.kind >= 4 else int(c.base), next((i for i, n in enumerate((8, 12, 17, 30)) if len(v) < n), 4),
            0 if not digits else 1 if not re.search("[A-Za-z]", v) else 2 if digits * 2 < len(v) else 3,
            0 if counter else 2 if cue or re.search('[=:] ?"?$', c.before) else 1, int(edge(c.before[-1:]) and edge(c.after[:1])),
        )

    rows = found.select("doc_id", "spans", pii._kept(weights, 0.5).alias("kept")).collect()
    for r in rows:
        want = [c for c in r.spans if c.base or sum(w[f] for w, f in zip(weights, features(c))) >= 0]
        assert [tuple(c) for c in r.kept] == [tuple(c) for c in want]
    assert sum(len(r.kept) for r in rows) > 20


def test_label_model_finds_who_errs():
    rng = np.random.default_rng(4)
    accuracy = np.array([0.95, 0.9, 0.85, 0.8, 0.55])  # the last one is bad, though trusted like the others
    truth = rng.random(30_000) < 0.6
    right = rng.random((30_000, 5)) < accuracy
    votes = np.where(right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None]) * (rng.random((30_000, 5)) < 0.8)
    table, counts = np.unique(votes, axis=0, return_counts=True)
    rules = tuple(quality.Rule(f"r{i}", "false", "true", trust=0.9) for i in range(5))
    for silence in (True, False):
        model = quality.fit_label_model(table, counts.astype(float), rules, prior=0.7, silence_tells=silence)
        told = np.array(model.ratios)
        estimated = 1 / (1 + np.exp(-(told[:, 2] - told[:, 0]) / 2))
        assert np.abs(estimated - accuracy).max() < 0.03 and abs(model.prior - 0.6) < 0.03
        assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95


# 10 ------------------------------------------------------------------------------------------------
def test_word_bpe_equals_library():
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    own = wordbpe.WordBpe(contents("word_bpe_49k.json"))
    rng = random.Random(4)
    texts = ["it's I'LL don't x'd", "a\x1cb c d", "ΣΑΣ Привет мир", "日本語テキスト 🎉!!", "é École ﬁ½² İstanbul", "<|endoftext|> hi", "a" * 3000, "!?" * 500, "\t\ttabs\r\nnew", ""]
    texts += ["".join(rng.choices("abcde thnsé'.,\n19", k=60)) for _ in range(500)]
    texts += pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_word_bpe_knows_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    own, library = wordbpe.WordBpe(contents("word_bpe_49k.json")), Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for t in ["hi <|endoftext|> there", "<|startoftext|>É x<|endoftext|><|endoftext|>\nit's", "a <|ENDOFTEXT|> b", "<| endoftext |> <|endoftext", "日本<|endoftext|>語" + "a" * 3000, "plain words"]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
    assert np.frombuffer(own.encode("hi <|endoftext|> there"), "<u4").tolist() == [1883, 49407, 997]


def test_bulk_packing_equals_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(150):
        capacity = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        left, opened = [], 0
        for n in sorted(lengths, reverse=True):
            at = bisect.bisect_left(left, n)
            room = left.pop(at) if at < len(left) else capacity
            opened += room == capacity
            bisect.insort(left, room - n)
        fill = collections.defaultdict(list)
        for n, _, first, offset, count in packing.best_fit_decreasing(collections.Counter(lengths), capacity).tolist():
            for j in range(count):
                fill[first + j].append((offset, n))
        assert sorted(capacity - sum(n for _, n in v) for v in fill.values()) == left
        for v in fill.values():
            assert [o for o, _ in sorted(v)] == np.cumsum([0] + [n for _, n in sorted(v)])[:-1].tolist()


def test_packing(spark, odd, empty):
    vocabulary = contents("word_bpe_49k.json")
    rows = packing.pack_documents(odd, vocabulary, capacity=64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    for v in by.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0] + [n for _, n in sorted(v)])[:-1].tolist() and sum(n for _, n in v) <= 64
    assert packing.pack_documents(empty, vocabulary).count() == 0


def plain_rules(model, rows):
    """Ids that the base rule and the label model keep, from rows of features."""
    kept = set()
    for r in rows:
        odds = np.log(model.prior / (1 - model.prior))
        for rule, ratios in zip(quality.RULES, model.ratios):
            odds += ratios[0] if rule_holds(rule.bad, r) else ratios[2] if rule_holds(rule.good, r) else ratios[1]
        if not plain_base_counts(r["_text"])[-1] and odds >= 0:
            kept.add(r["_text"])
    return kept


def plain_line_dedup(rows, min_sites=5):
    """(id, text) without lines of five or more sites, the first occurrence by id apart."""
    sites, first = collections.defaultdict(set), {}
    for d, text, site in sorted(rows):
        for i, line in enumerate(text.split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                sites[line.strip(" ")].add(site)
                first.setdefault(line.strip(" "), (d, i))
    out = {}
    for d, text, _ in rows:
        lines = text.split("\n")
        left = [x for i, x in enumerate(lines) if not (len(sites.get(x.strip(" "), ())) >= min_sites and first[x.strip(" ")] != (d, i))]
        if len(left) == len(lines) or re.search(r"[^\x20\x09-\x0D]", "\n".join(left)):
            out[d] = "\n".join(left)
    return out


def plain_redaction(text, spans):
    merged = []
    for s in spans:
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.stop)
        else:
            merged.append([s.start, s.stop, s.kind])
    for start, stop, kind in reversed(merged):
        text = text[:start] + f"<{pii.KINDS[kind].upper()}>" + text[stop:]
    return text


def test_pipeline_stages_equal_plain_versions(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400 or length(text) < 1500")
    source = docs.collect()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "redact", "pack"]

    good = pii.materialize(stages["quality_rules"](spark, docs, ""))
    features = [{**r.asDict()} for r in quality.measured(docs.withColumnRenamed("text", "_text"), "_text", keep=("_text",)).collect()]
    want = plain_rules(quality.fit(quality.measured(docs)), features)
    kept = good.collect()
    assert good.columns == docs.columns and sorted(kept) == sorted(r for r in source if r.text in want) and 0 < len(kept) < len(source)

    lines = pii.materialize(stages["line_dedup"](spark, good, ""))
    cleaned = lines.collect()
    assert {r.doc_id: r.text for r in cleaned} == plain_line_dedup([(r.doc_id, r.text, r.source) for r in kept])
    assert all(r.n_chars == len(r.text) for r in cleaned) and lines.columns == docs.columns

    single = pii.materialize(stages["near_duplicates"](spark, lines, ""))
    first = {d for d, _, least, _ in plain_jaccard([(r.doc_id, r.text) for r in cleaned]) if d == least}
    assert sorted(single.collect()) == sorted(r for r in cleaned if r.doc_id in first) and len(first) < len(cleaned)

    clean = pii.materialize(stages["redact"](spark, single, ""))
    spans = {r.doc_id: r.spans for r in pii.find_pii(single).collect()}
    redacted = {r.doc_id: r.text for r in clean.collect()}
    assert redacted == {r.doc_id: plain_redaction(r.text, spans[r.doc_id]) for r in single.collect()} and any("<EMAIL>" in t for t in redacted.values())

    library = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    ids = {d: [*library.encode(t, add_special_tokens=False).ids, 1] for d, t in redacted.items()}
    packed = stages["pack"](spark, clean, "").collect()
    check_packing(packed, ids, 4096)
    ran = []
    try:
        spark.catalog.clearCache()
        before, corpus_pipeline.STAGES = corpus_pipeline.STAGES, [(n, lambda s, d, f, g=g: ran.append(d.columns) or g(s, d, f)) for n, g in corpus_pipeline.STAGES]
        assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100 and len(ran) == 5
    finally:
        corpus_pipeline.STAGES = before


def check_packing(rows, ids, capacity):
    """All ids, cut only where too long, laid gapless into sequences, and as few of them as best-fit decreasing opens."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    cut = lambda x: [x[a : a + capacity] for a in range(0, len(x), capacity)]
    assert {d: sorted(v) for d, v in by_doc.items()} == {d: [(i, i * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, p in enumerate(cut(x))] for d, x in ids.items()}
    for v in by_sequence.values():
        v.sort()
        assert [o for o, _ in v] == np.cumsum([0] + [n for _, n in v])[:-1].tolist() and sum(n for _, n in v) <= capacity
    left = []
    for n in sorted((len(p) for x in ids.values() for p in cut(x)), reverse=True):
        at = bisect.bisect_left(left, n)
        room = left.pop(at) if at < len(left) else capacity
        bisect.insort(left, room - n)
    assert len(by_sequence) == len(left)


def test_pipeline_on_odd_tables(spark):
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long, _key string, spans long"
    empty, nulls = spark.createDataFrame([], columns), spark.createDataFrame([(None,) * 7] * 3, columns)
    same = spark.createDataFrame([(7, "the very same words stand here ten times or more in this text", None, None, None, "k", 1)] * 4, columns)
    for docs, left in ((empty, 0), (nulls, 0), (same, 4)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            docs = pii.materialize(out)
        assert docs.count() == left and stage is not None
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == left


def shuffled(spark):
    """Bytes of the shuffle files there are, by name."""
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split()
    return {n: os.path.getsize(n) for n in names if n.endswith(".data") and "shuffle" in n and os.path.exists(n)}


def test_written_tables_leave_no_shuffle_files(spark):
    from arbiterlake.llm.common import materialize

    before = set(shuffled(spark))
    made = materialize(spark.range(50_000).groupBy((F.col("id") % 9973).alias("k")).count())
    assert not set(shuffled(spark)) - before and made.count() == 9973


def test_near_duplicates_shuffle_no_text(spark):
    rng = random.Random(5)
    texts = [" ".join(f"{rng.getrandbits(60):x}" for _ in range(2000)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(100 + i, texts[i]) for i in range(5)] + [(None, "a b c"), (None, "a b c d e f"), (7, "a b c d e f")]
    before = set(shuffled(spark))
    kept = jaccard.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    kept.write.format("noop").mode("overwrite").save()
    assert sum(n for f, n in shuffled(spark).items() if f not in before) < 400_000 < sum(map(len, texts)) // 4
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == sorted([*range(60), 7]) and kept.filter("doc_id is null").count() == 2


def test_a_large_family_ships_few_sets(spark, monkeypatch):
    rng = random.Random(7)
    pool = [" ".join(f"{rng.getrandbits(30):x}" for _ in range(8)) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(3, 16)))) for i in range(300)]
    rows += [(1000 + i, f"{t} more") for i, t in rows[::20]]
    shipped, compare = [], jaccard.compare_blocks
    monkeypatch.setattr(jaccard, "compare_blocks", lambda df, percent: shipped.append(df.count()) or compare(df, percent))
    monkeypatch.setattr(jaccard, "LONGEST", 8)
    edges = jaccard.candidate_edges
    monkeypatch.setattr(jaccard, "candidate_edges", lambda leads, percent: edges(leads, percent, 8))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), block=4).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_jaccard(rows))
    assert shipped[0] <= 3 * jaccard.SPREAD * len(rows)  # 79 chunks of 4 before
