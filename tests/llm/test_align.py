"""Cross-tokenizer alignment against the libraries' whole-text ids and a plain overlap of byte ranges."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from arbiterlake.llm import align
from arbiterlake.llm.wordbpe import byte_symbols


@pytest.fixture(scope="module")
def files():
    import public_tokenizers as p

    with open(p.path("byte_bpe_50k.json"), encoding="utf-8") as f, open(p.path("piece_bpe_32k.model"), "rb") as g:
        return f.read(), g.read()


@pytest.fixture(scope="module")
def plain(files):
    """Rows of (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of texts, and the counted pairs."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_str(files[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_proto=files[1])
    of = {c: x for x, c in enumerate(byte_symbols())}
    bytes_a = {i: bytes(of[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items()}
    pieces = [b.id_to_piece(i) for i in range(b.vocab_size())]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]

    def one(text):
        nothing = [], [], [], [], ""
        if not text:
            return nothing
        raw, ids = (" " + text).encode(), (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
        parts = [bytes_a[i] for i in ids[0]], [bytes_b[i] for i in ids[1]]
        if b"".join(parts[0]) != raw or b"".join(parts[1]) != raw:
            return nothing
        spans = []
        for p in parts:
            spans.append([])
            for t in p:
                start = spans[-1][-1][1] if spans[-1] else 0
                spans[-1].append((start, start + len(t)))
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        shown = ";".join(
            "|".join(",".join(str(i) for i, (s, e) in zip(side, own) if at <= s and e <= to) for side, own in zip(ids, spans)) for at, to in zip([0, *ends], ends)
        )
        links = [(x, y) for x, (s, e) in zip(ids[0], spans[0]) for y, (t, u) in zip(ids[1], spans[1]) if s < u and t < e]
        return ids[0], ids[1], ends, links, hashlib.sha256(shown.encode()).hexdigest()

    def many(texts):
        rows = [one(t) for t in texts]
        count = collections.Counter(p for r in rows for p in set(r[3]))
        most = collections.Counter()
        for (x, _), c in count.items():
            most[x] = max(most[x], c)
        return [(len(x), len(y), len(g), len(k), sum(count[p] == most[p[0]] for p in k), sum(count[p] for p in k), h) for x, y, g, k, h in rows], count, most

    return many


def texts():
    rng = random.Random(13)
    words = "the of straße naïve tokenization 12345 don't \n\n \t   <s> </s> <|endoftext|> <0x41> 漢字 こんにちは 🙂🙃 ß. é (x) a b \u0085 \x00 ,.;!? re-entry ﬁ Ⅷ ​ ƒoo XMLHttp".split(" ")
    made = ["".join(rng.choice(words) + rng.choice([" ", " ", "", "  "]) for _ in range(rng.randint(1, 30))) for _ in range(150)]
    return [*made, None, "", " ", "  ", "a", " a", "a ", "a▁b", "a▁ b", "x" * 4000, "the " * 3000, "\n", "the of", "the of", "the  of"]


def test_equals_plain(spark, files, plain):
    want, count, most = plain(texts())
    docs = spark.createDataFrame(list(enumerate(texts())), "n_a int, text string").withColumn("n_links", F.lit("clash"))
    found, pairs = align.align_documents(docs, *files, id_col="n_a", stripes=7)
    assert found.columns == ["n_a_id", *align.OUTPUTS]
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert [got[i] for i in range(len(want))] == want and not any(want[i][0] for i in (150, 151, 157, 158))
    assert {(r.a_id, r.b_id): (r.n_docs, r.best) for r in pairs.collect()} == {p: (c, c == most[p[0]]) for p, c in count.items()}


def test_salts_and_batches_change_nothing(spark, files, monkeypatch):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id int, text string").repartition(5)
    one = align.align_documents(docs, *files)
    monkeypatch.setattr(align, "BATCH_LINKS", 500)
    other = align.align_documents(docs, *files, stripes=3, salt_bytes=2000)
    for x, y in zip(one, other):
        assert sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.collect()), key=str)


def test_real_texts_long_rows_and_null_ids(spark, files, plain):
    docs = [(None if r.doc_id % 9 == 0 else r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    found = align.align_documents(spark.createDataFrame([*docs, *docs], "doc_id long, text string"), *files)[0]
    want = [(i, *w) for (i, _), w in zip([*docs, *docs], plain([t for _, t in [*docs, *docs]])[0])]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)


def test_units_give_the_ids_of_whole_texts(files):
    own = align.Aligner(*files, stripes=64)
    assert own.cuts and own.quick
    for text in filter(None, texts()):
        units = own.cut(text)
        assert "".join(units) == " " + text
        ids = [i for u in units for i in own.a.encode(u, add_special_tokens=False).ids]
        assert ids == own.a.encode(" " + text, add_special_tokens=False).ids
        if "▁" not in text:
            assert [i for u in units for i in own.b.encode(u[1:])] == own.b.encode(text)


def test_empty(spark, files):
    found, pairs = align.align_documents(spark.createDataFrame([], "doc_id long, text string"), *files)
    assert found.count() == 0 and pairs.count() == 0 and found.columns == ["doc_id", *align.OUTPUTS]
