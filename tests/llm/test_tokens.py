"""Byte-level BPE, importance resampling and fill-in-middle against other implementations, brute force and round trips."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.llm import byte_bpe, infilling, resampling
from docloom.llm import queries as registered
from tests.compare import assert_same, database
from tests.llm.test_operators import table, words

LONG = words(20_000, 1, 5_000) + " " + "ab" * 50_000 + " " * 3_000 + "=" * 3_000
TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "naïve café — 日本語 😀 résumé's"), (6, "a b c"), (6, "a b c"), (7, LONG), (8, "<|endoftext|> and <P> or <S>"),
    (None, "x y z " * 30), (None, "x y z " * 30), (9, "THE The the [x] 1.2 I'll we've  \n\n\tend"), (10, "\x1c\x85  x　y"), (11, words(60, 3)), (12, words(60, 3)), (13, "é" * 300), (14, "aé日😀" * 40),
]


@pytest.fixture(scope="module")
def known():
    return byte_bpe.of_file(public_tokenizers.path(byte_bpe.VOCABULARY))


def library(known):
    return tiktoken.Encoding("own", pat_str=known.pattern, mergeable_ranks={t: i for i, t in enumerate(known.tokens) if t is not None}, special_tokens={})


def test_ids_are_those_of_the_library_and_decode_to_the_text(spark, known):
    docs, other = table(spark, TEXTS), library(known)
    got = byte_bpe.encoded(docs, known).select("doc.*", "ids", byte_bpe.decoded(F.col("ids"), known).alias("body")).collect()
    assert len(got) == len(TEXTS) and set(docs.columns) < set(got[0].asDict())
    for r in got:
        assert r["ids"] == other.encode_ordinary(r["text"] or "")
        assert bytes(r["body"]) == (r["text"] or "").encode()


def test_no_rows_and_unknown_ids(spark, known):
    assert byte_bpe.encoded(table(spark, []), known).count() == 0
    rows = spark.createDataFrame([([1, 2],), ([70_000],), ([-1],), ([None],), ([],), (None,)], "ids array<int>")
    assert [r[0] for r in rows.select(byte_bpe.decoded(F.col("ids"), known)).collect()][1:] == [None, None, None, b"", None]


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def coders(request):
    known = byte_bpe.of_file(public_tokenizers.path(request.param))
    return byte_bpe.Encoder(known), library(known)


def test_all_kinds_of_text(coders):
    encoder, other = coders

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.text(), st.text("ab "), st.text("then in"), st.text("0123456789.,"), st.text(" \t\n\r"), st.text("éàßñ—日本語")))
    def same(text):
        assert encoder.encoded(text).tolist() == other.encode_ordinary(text)

    same()


def test_vocabularies_of_any_merges():
    """Small alphabets, where nearly all tokens overlap, and dead ends are frequent."""
    rng = random.Random(4)
    for _ in range(150):
        ranks, parts = {bytes([b]): b for b in range(256)}, [b"a", b"b", b"c"]
        for _ in range(12):
            token = rng.choice(parts) + rng.choice(parts)
            if token not in ranks and len(byte_bpe.merged(token, ranks, len(ranks))) == 2:
                ranks[token] = len(ranks)
                parts.append(token)
        known = byte_bpe.vocabulary(ranks)
        encoder, other = byte_bpe.Encoder(known), library(known)
        for _ in range(60):
            text = "".join(rng.choices("abc", k=rng.randint(1, 40)))
            assert encoder.encoded(text).tolist() == other.encode_ordinary(text) == [ranks[p] for p in byte_bpe.merged(text.encode(), ranks)] or text.encode() in ranks


def test_vocabularies_that_are_refused():
    ranks = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="no merges"):
        byte_bpe.vocabulary(ranks | {b"abc": 256})
    with pytest.raises(ValueError, match="single bytes"):
        byte_bpe.vocabulary({b"a": 0})
    with pytest.raises(ValueError, match="at most"):
        byte_bpe.vocabulary(ranks | {b"ab": 2_000_000})


def test_pieces_are_forgotten_when_they_are_many(known, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PIECES", 10)
    encoder, other = byte_bpe.Encoder(known), library(known)
    text = words(300, 9, 10_000)
    for _ in range(3):
        assert encoder.encoded(text).tolist() == other.encode_ordinary(text)
        encoder.pieces.trim()
        assert len(encoder.pieces) == len(encoder.pieces.whole)


def plain_features(text, order):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]


def plain_resampling(texts, target, order, buckets, least, percent):
    bucket = lambda f: crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in side for f in plain_features(x, order)[1]) for side in ([x for _, x in texts], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    rows = []
    for i, x in texts:
        n, features = plain_features(x, order)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in map(bucket, features)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(gain), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    admitted = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    places = {id(r): k + 1 for k, r in enumerate(admitted[: percent * len(admitted) // 100])}
    return [(r[0], *r[2:], places.get(id(r))) for r in rows]


@pytest.mark.parametrize("order, buckets, most_nodes", [(1, 10_000, 200_000), (2, 64, 200_000), (3, 1000, 5)])
def test_resampling_equals_brute_force(spark, order, buckets, most_nodes):
    texts = [*TEXTS, *[(100 + k, words(15 + k, k, 60)) for k in range(60)]]
    target = [words(40, 70, 60), None, "", "THE end, the x y z"]
    docs, aim = table(spark, texts).repartition(5), table(spark, list(enumerate(target)))
    found = resampling.gains(docs, aim, order=order, buckets=buckets)
    rows = resampling.ranked(resampling.scored(docs, found, F.lit(None), order=order, most_nodes=most_nodes), 20, 50)
    want = plain_resampling(texts, target, order, buckets, 20, 50)
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(want, key=repr)
    counts = resampling.bucket_counts(docs, "text", order, buckets, most_nodes)
    assert {r["bucket"]: r["n"] for r in counts.collect()} == Counter(crc32(f.encode()) % buckets for _, x in texts for f in plain_features(x, order)[1])


def test_documents_drawn(spark):
    texts = [*TEXTS, *[(100 + k, words(15 + k, k, 60)) for k in range(60)]]
    docs, aim = table(spark, texts), table(spark, [(1, words(40, 70, 60))])
    ranks = resampling.ranked(resampling.scored(docs, resampling.gains(docs, aim), F.lit(None))).where("rank IS NOT NULL")
    got = resampling.resampled(docs, aim)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(r["id"] for r in ranks.collect())
    assert resampling.resampled(docs.where("length(text) < 5"), aim).count() == 0 == resampling.resampled(docs.where("false"), aim).count()
    assert resampling.resampled(docs, aim.where("false")).count() > 0


def plain_infilling(i, text, words_as_units=False):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", text) if words_as_units else text
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(x in text for x in infilling.SENTINELS) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("units", ["characters", "words"])
def test_infilling_equals_slices_and_is_restored(spark, units):
    mixed = random.Random(2)
    texts = [*TEXTS, *[(200 + k, "".join(mixed.choices("ab \t\né日😀<PSM>", k=mixed.randint(0, 60)))) for k in range(120)]]
    found = infilling.infilled(table(spark, texts), units=units)
    got = found.select("doc.*", "form", F.col("n").alias("units"), "prefix_chars", "middle_chars", "output", infilling.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(got) == len(texts) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert r["back"] == (r["text"] or "")
        assert (r["units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_infilling(r["doc_id"], r["text"], units == "words")
    assert infilling.infilled(table(spark, [])).count() == 0


def test_offsets_by_runs():
    for text in ("", "abc", "aé日😀b", "ééé", "日a日"):
        runs = infilling.character_runs(text.encode())
        assert runs.n == len(text) and [runs.offset(k) for k in range(len(text) + 1)] == [len(text[:k].encode()) for k in range(len(text) + 1)]


@pytest.mark.parametrize("name", ["op12_resampling", "op13_infilling"])
def test_same_as_sql(spark, data, name):
    assert_same(registered.QUERIES[name](spark, data).toPandas(), database(data).sql(registered.SQL[name]).df())


def test_op11_equals_the_library(spark, data, known):
    got, other = registered.op11_byte_bpe(spark, data).collect(), library(known)
    digest = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, text in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect():
        ids = other.encode_ordinary(text or "")
        want.append((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((text or "").encode())))
    assert sorted(map(tuple, got)) == sorted(want)
