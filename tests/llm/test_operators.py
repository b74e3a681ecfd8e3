"""The ten operators on small fixtures: brute force, held-out accuracy and the defined cases."""

import hashlib
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import boosting, decontaminate, graph, language, licences, mixing, neighbours, quality, simhash, suffix_dedup, suffixes, toxicity, training, url_filter
from docloom.llm import queries as registered
from tests.compare import assert_same, database

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, row string, label int, score double, doc string, n int, key string"


def words(n, seed=0, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{k}x" for k in rng.integers(0, vocabulary, n))


def table(spark, texts, lang=None, source=None):
    rows = [(i, t, lang[k] if lang else "en", source[k] if source else f"s{k % 3}", len(t or ""), 7, "r", 1, 0.5, "d", 3, "k") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    long = words(30_000, 1, 50_000)
    passage = words(80, 2)
    near = words(120, 3).split()
    other = near[:]
    other[60] = "changed"
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "One"), (5, "one two"), (6, "a b c"), (6, "a b c"), (7, long), (8, " ".join(near)), (9, " ".join(other)), (10, " ".join(near)),
        (11, f"{words(30, 4)} {passage} {words(30, 5)}"), (12, f"{words(20, 6)} {passage}\n{words(9, 7)}"), (13, "é" * 150 + "à" * 150), (14, "zé" + "é" * 149 + "à" * 120), (15, "ab" * 400), (16, "THE The the [x] 1.2"), (17, words(500, 8)),
    ]


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        for b in range(64):
            bits[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(shingles))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_equals_brute_force(spark, texts):
    got = sorted((r["id"], r["fp"] & (1 << 64) - 1, r["component"]) for r in simhash.near_duplicates(table(spark, texts)).collect())
    prints = {i: brute_fingerprint(t) for i, t in texts}
    root = brute_components(list(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert got == sorted((i, prints[i], root[i]) for i, _ in texts)


@pytest.mark.parametrize("cap", [1, 4, 1000])
def test_simhash_links_lose_nothing(spark, cap):
    """Dense clouds of fingerprints, with short postings and long ones."""
    rng = np.random.default_rng(3)
    prints = set()
    for c in rng.integers(0, 1 << 63, 4):
        for _ in range(40):
            prints.add(int(c) ^ sum({1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 5))}))
    prints = sorted(prints)
    nodes = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(nodes, posting_cap=cap)).collect()}
    want = brute_components(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    assert {p: roots.get(p, p) for p in prints} == want


def test_components_of_a_path_and_of_nothing(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(5, 5), (None, 3)], "a bigint, b bigint")
    assert {r["root"] for r in graph.components(path).collect()} == {0}
    assert graph.components(path.where("false")).count() == 0


def test_links_are_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(8)
    prints = sorted({int(rng.integers(0, 1 << 62)) & ~0xFFFF | int(x) for x in rng.integers(0, 1 << 16, 3)} | set(rng.integers(0, 1 << 16, 900).tolist()))
    nodes = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    want = {(a, b) for a in prints for b in prints if a > b and bin(a ^ b).count("1") <= 2}
    for cap in (2, 40):
        assert {tuple(r) for r in simhash.links(nodes, posting_cap=cap).collect()} == want
    assert {tuple(r) for r in simhash.links(nodes, bits=1).collect()} == {(a, b) for a, b in want if bin(a ^ b).count("1") == 1}


def test_simhash_deduplicates_beside_columns_of_any_name(spark):
    rows = [(1, "a b c", 1, "x"), (1, "a b c", 2, "x"), (2, "a b c", 3, "y"), (3, "quite another text here", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _text int, hash string")
    got = simhash.deduplicated(docs)
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_simhash_keeps_one_of_each(spark, texts):
    got = Counter(r["doc_id"] for r in simhash.deduplicated(table(spark, [*texts, (None, "x y z"), (None, "x y z")])).collect())
    assert got[None] == 2 and got[8] == 1 and got[10] == 0 and got[6] == 1 and got[1] == 1 and got[2] == 0


def brute_removed(texts, length):
    bodies = [(i, (t or "").encode()) for i, t in texts]
    count = Counter(b[k : k + length] for _, b in bodies for k in range(len(b) - length + 1))
    out = []
    for i, b in bodies:
        cover = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                cover[k : k + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        out.append((i, len(b), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("length, gram, part", [(200, 64, 4096), (48, 20, 4096), (48, 20, 1), (50, 20, 3)])
def test_suffix_dedup_equals_brute_force(spark, texts, length, gram, part):
    shared = [(100 + k, words(10, 50 + k) + " " + words(60, 2) + " " + words(10, 80 + k)) for k in range(6)]
    docs = table(spark, [*texts, *shared])
    got = suffix_dedup.removed_spans(docs, F.col("doc_id"), length=length, gram=gram, part=part, keep="bytes").collect()
    rows = sorted((r["id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), r["kept_sha256"]) for r in got)
    assert rows == brute_removed([*texts, *shared], length)
    assert all(hashlib.sha256(r["kept"] or b"").hexdigest() == r["kept_sha256"] for r in got)


def test_all_that_suffix_dedup_removes_comes_from_the_sort(spark, texts, monkeypatch):
    docs = table(spark, texts)
    assert suffix_dedup.removed_spans(docs, F.col("doc_id")).where("size(spans) > 0").count() > 0
    kind = "row bigint, tag int, lo int, hi int, body binary, key bigint, context bigint"
    monkeypatch.setattr(suffix_dedup, "_sorted_runs", lambda contexts, length, merge: spark.createDataFrame([], kind))
    assert suffix_dedup.removed_spans(docs, F.col("doc_id")).where("size(spans) > 0").count() == 0


def test_positions_of_several_suffixes_repeat_wherever_they_stand():
    rng = np.random.default_rng(2)
    body = bytes(rng.integers(97, 99, 600, dtype=np.uint8)) + bytes(rng.integers(97, 123, 600, dtype=np.uint8))
    buf, starts, length = np.frombuffer(body + bytes(48), np.uint8), np.arange(len(body) - 40), 40
    several = np.zeros(len(buf), bool)
    several[rng.integers(0, len(starts), 200)] = True
    found, leads = suffixes.repeated(buf, starts.copy(), length, None, several)
    of = {s: body[s : s + length] for s in starts.tolist()}
    counts = Counter(of.values())
    assert sorted(found.tolist()) == [s for s in starts.tolist() if several[s] or counts[of[s]] > 1]
    assert Counter(of[s] for s in found[leads].tolist()) == Counter({of[s] for s in found.tolist()})


def test_suffix_dedup_of_texts_beyond_a_piece(spark):
    body = words(260_000, 9, 1 << 40)
    assert len(body) > suffix_dedup.PIECE
    texts = [(1, body), (2, "head " + body[700_000:700_900] + " tail"), (3, words(200, 12))]
    got = {r["id"]: [tuple(s) for s in r["spans"]] for r in suffix_dedup.removed_spans(table(spark, texts), F.col("doc_id")).collect()}
    assert got == {1: [(700_000, 700_900)], 2: [(5, 905)], 3: []}


def test_suffix_dedup_keeps_whole_characters_and_columns(spark, texts):
    docs = table(spark, texts)
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(texts)
    by_id = {r["doc_id"]: r["text"] for r in got.collect()}
    assert by_id[1] is None and by_id[8] == "" and by_id[17] == dict(texts)[17] and "\ufffd" not in by_id[14]


@pytest.mark.parametrize("length", [32, 37, 48])
def test_sorted_suffixes_have_order_and_shared_prefixes(length):
    rng = np.random.default_rng(length)
    body = bytes(rng.integers(97, 99, 1500, dtype=np.uint8)) + b"q" * 90 + bytes(rng.integers(97, 99, 60, dtype=np.uint8)) * 9
    body += body[100 : 110 + length]
    buf, starts = np.frombuffer(body + bytes(8), np.uint8), np.arange(len(body) - length + 1)
    group = np.sort(rng.integers(0, 3, len(starts)))
    count = Counter((g, body[k : k + length]) for k, g in zip(starts.tolist(), group.tolist()))
    want = [k for k in starts.tolist() if count[group[k], body[k : k + length]] > 1]
    found, leads = suffixes.repeated(buf, starts.copy(), length, group)
    assert sorted(found.tolist()) == want
    assert sorted({(group[k], body[k : k + length]) for k in want}) == sorted((group[k], body[k : k + length]) for k in found[leads].tolist())
    ordered, shared, first, _ = suffixes.deep_shallow(buf, starts.copy(), group, length)
    for i in range(1, len(ordered)):
        if not first[i]:
            a, b = (body[k : k + length] for k in ordered[i - 1 : i + 1])
            assert a <= b and shared[i] == next((k for k in range(length) if a[k] != b[k]), length)


def test_blind_trie_orders_its_suffixes():
    order, shared = suffixes.blind_trie(b"abcdxabcdyabqqqabcdx", [0, 5, 10, 15], 2, 5)
    assert order == [0, 3, 1, 2] and shared == [2, 5, 4, 2]


def test_mixing_equals_sql(spark, data):
    assert_same(registered.op6_mixing(spark, data).toPandas(), database(data).sql(registered.OP6_SQL).df())


def test_mixing_with_hard_sources(spark):
    texts = [(k, "w " * (k % 7)) for k in range(60)] + [(None, "a b"), (1, None)]
    source = ["a"] * 30 + ["b"] * 25 + [None] * 5 + ["empty", "b"]
    docs = table(spark, [(i, "" if s == "empty" else t) for (i, t), s in zip(texts, source)], source=source)
    rows = mixing.mixed(docs, bucket_rows=4).collect()
    assert len(rows) == len(texts) and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mixed(docs, bucket_rows=1000).collect()), key=str)
    for s in set(source):
        own = [r for r in rows if r["source"] == s]
        assert sum(r["taken"] for r in own) == int(own[0]["target"]) and all(0 <= r["taken"] <= 2 * r["size"] for r in own)
    assert abs(sum({r["source"]: r["target"] for r in rows}.values()) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert mixing.mixed(docs.where("false")).count() == 0
    shuffled = mixing.mixed(docs.repartition(9), bucket_rows=4).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, shuffled), key=str)
    assert mixing.mixed(table(spark, [(1, "w " * 300_000), (2, None)], source=["a", "a"])).agg(F.sum("taken")).first()[0] == 450_000


def test_many_sources_are_ranked_and_levelled_as_by_hand(spark):
    rng = np.random.default_rng(2)
    sizes = [(f"s{k:03d}" if k else None, int(n)) for k, n in enumerate(rng.integers(0, 5000, 90))]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size bigint").repartition(7)).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(order)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * n, level * weight[s]) for s, n in sizes) < 1.5 * sum(n for _, n in sizes) else (low, level)
    assert all(abs(got[s] - min(2 * n, low * weight[s])) < 1e-6 for s, n in sizes)


def contaminated(docs, benchmark, **options):
    return {r["doc_id"]: (r["words"], sorted(r["hit_words"]), r["items"]) for r in decontaminate.contamination(docs, benchmark, **options).select("doc.doc_id", "words", "hit_words", "items").collect()}


def brute_contaminated(texts, items, width=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = {}
    for i, t in texts:
        w, hit, found = cut(t), set(), set()
        for item, b in items:
            b = cut(b)
            n = min(width, len(b))
            for k in range(len(b) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == b[k : k + n]:
                        hit |= set(range(p, p + n))
                        found.add(str(item))
        out[i] = (w, sorted(hit), sorted(found))
    return out


@pytest.mark.parametrize("most", [50_000, 0])
def test_decontamination_equals_brute_force(spark, most):
    item = words(14, 30)
    items = [(1, item), (2, "Short, item"), (30, None), (4, ""), (5, "9 é word"), (11, item.upper() + " more")]
    texts = [(1, None), (2, ""), (3, f"x {item} y"), (4, "a SHORT item; short Item"), (5, item[: len(item) // 2]), (6, "é 9 é word 9"), (7, f"{item} {item}"), (8, words(4000, 31)), (9, " ".join(item.split()[2:12]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = table(spark, texts)
    want = brute_contaminated(texts, items)
    for dealt in (docs, docs.repartition(7), docs.repartition(5, "text"), docs.orderBy(F.desc("doc_id"))):
        assert contaminated(dealt, benchmark, most_windows=most) == want
    twice = decontaminate.contamination(docs.union(docs).repartition(7), benchmark, most_windows=most).select("doc.doc_id", F.size("hit_words").alias("n")).collect()
    assert sorted(tuple(r) for r in twice) == sorted((i, len(h)) for i, (_, h, _) in want.items() for _ in "ab")
    kept = sorted(r["doc_id"] for r in decontaminate.decontaminated(docs, benchmark, most_windows=most).collect())
    assert kept == [1, 2, 5, 8]
    spans = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(docs, benchmark, remove="spans", most_windows=most).collect()}
    assert spans[3] == "x y" and spans[4] == "a " and spans[8] == texts[7][1] and spans[1] is None
    assert contaminated(docs, benchmark.where("false")) == {i: (w, [], []) for i, (w, _, _) in brute_contaminated(texts, []).items()}


def test_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [list(map(float, v)) for v in rng.normal(size=(150, 8)).astype(np.float32)]
    rows = [(k, v, 1) for k, v in enumerate(vectors)] + [(200 + k, vectors[3], 0) for k in range(30)] + [(20, vectors[20], 5), (20, vectors[20], 5)] + [(240, None, 0), (260, [0.0] * 8, 0), (280, [1.0, None] + [0.0] * 6, 0), (300, [float("nan")] * 8, 0), (320, [float("inf")] * 8, 0), (340, [], 0), (360, [1.0, 2.0], 0), (None, vectors[0], 0)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id int")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0, k=20, block_rows=32, query_rows=4, tiles_each=2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    every = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    good = dict(every)

    def score(a, b):
        s = 0.0
        for x, y in zip(a, b):
            s += x * y
        return s

    for q in (i for i in good if i % 20 == 0):
        best = sorted(((-score(good[q], v), i) for i, v in every if i != q and len(v) == len(good[q])))[:20]
        assert sorted(got.get(q, [])) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert set(got) == {i for i in good if i % 20 == 0 and len(good[i]) == 8}
    assert neighbours.nearest(frame.where("false"), F.lit(True)).count() == 0


def test_licences_of_one_family_are_told_apart(spark):
    gnu = "This program is free software: you can redistribute it under the terms. It is licensed under the GNU {}, version {}."
    notices = {
        gnu.format("General Public License", 1): "GPL-1.0", gnu.format("General Public License", 2): "GPL-2.0", gnu.format("General Public License", 3): "GPL-3.0", gnu.format("General Public License", 4): None,
        gnu.format("Lesser General Public License", "2.1"): "LGPL-2.1", gnu.format("Library General Public License", 2): "LGPL-2.0", gnu.format("Lesser General Public License", 3): "LGPL-3.0", gnu.format("Lesser General Public License", 2): None,
        gnu.format("Affero General Public License", 3): "AGPL-3.0", gnu.format("Affero General Public License", 1): None,
        "This work is licensed under a Creative Commons Attribution 3.0 International License.": "CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "CC-BY-NC-ND-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": "CC-BY-NC-4.0", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0", "Licensed under CC BY 2.5.": "CC-BY-2.5", "Licensed under CC BY 9.0.": None,
        "Released under the BSD 3-Clause License.": "BSD-3-Clause", "Released under the BSD 4-Clause License.": None, "Licensed under the Apache License, Version 1.1.": None,
    }
    docs = table(spark, [(k, f"Some words. {t} Copyright 2024 and more words.") for k, t in enumerate(notices)])
    got = {r["doc_id"]: r["licence"] for r in licences.scanned(docs).select("doc.doc_id", "licence").collect()}
    assert {t: got.get(k) for k, t in enumerate(notices)} == notices


def test_licences(spark):
    notice, mit = "Licensed under the Apache License, Version 2.0.", licences.TEMPLATES["MIT"][2]
    wrapped = "This work is licensed under the GNU General\nPublic License, version 3."
    docs = table(spark, [
        (1, None), (2, ""), (3, f"text\n{notice}\n{notice}"), (4, "LICENSED under the apache license version 2"), (5, "Released under the MIT License."), (6, wrapped), (7, words(3000, 40)), (8, "under the"),
        (9, "\n".join([words(6, k) for k in range(5)] + [wrapped] + [words(6, k) for k in range(9)])), (10, "Copyright 2024 X Corp. Licensed under the MIT License. All rights reserved."),
        (11, f"{words(50, 41)}\nMIT License\n\nCopyright (c) 2024\n\n{mit}\n{words(50, 42)}"), (12, f"{words(200_000, 43)} {notice}"), (13, notice), (13, notice),
    ])
    got = sorted((r["doc_id"], r["first_word"], r["n_words"], r["licence"]) for r in licences.scanned(docs).select("doc.doc_id", "first_word", "n_words", "licence").collect())
    n = len(licences.TEMPLATES["MIT"][2].replace("/", " ").split())
    assert [g for g in got if g[0] != 11] == [(3, 2, 8, "Apache-2.0"), (3, 10, 8, "Apache-2.0"), (4, 1, 7, "Apache-2.0"), (5, 1, 5, "MIT"), (6, 1, 12, "GPL-3.0"), (9, 31, 12, "GPL-3.0"), (10, 5, 5, "MIT"), (12, 200_001, 8, "Apache-2.0"), (13, 1, 8, "Apache-2.0"), (13, 1, 8, "Apache-2.0")]
    assert [(g[1], g[3]) for g in got if g[0] == 11] == [(56, "MIT")] and abs(next(g for g in got if g[0] == 11)[2] - n) <= 2
    own = spark.createDataFrame([("B", "one two three four"), ("A", "one two three four"), (None, "one two"), ("C", None), ("D", "word")], "licence string, text string")
    tied = table(spark, [(1, "x ONE two, three four y")])
    assert [tuple(r)[1:] for r in licences.scanned(tied, templates=own).collect()] == [(2, 4, "A", 1.0)]
    assert licences.scanned(docs.where("false")).count() == 0 and licences.scanned(docs, templates=own.where("false")).count() == 0


def test_url_rules_and_terms(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "buy viagra": ("", "", None, "block"), "http://A.example.COM/en/7x?q=1": ("a.example.com", "/en/7x", "example.com/en/7", "allow"), "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"),
        "https://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"), "https://x.net/de/9#f": ("x.net", "/de/9", "net/de/", "allow"), "https://notexample.org/es/": ("notexample.org", "/es/", "org/es/", "block"), "https://free-bets.example.com/fr/1": ("free-bets.example.com", "/fr/1", None, "block"),
        "https://freebets.example.com/fr/1": ("freebets.example.com", "/fr/1", None, "allow"), "https://free.example.com/free": ("free.example.com", "/free", None, "allow"), "https://CASINO.example.com?x": ("casino.example.com", "", None, "block"), "a://b://c/d": ("b:", "//c/d", None, "allow"),
    }
    cases |= {"https://x.example.com/" + "a/" * 50_000 + "casino": ("x.example.com", "/" + "a/" * 50_000 + "casino", None, "block")}
    rows = spark.createDataFrame([(u, 1, "x") for u in cases], "url string, host int, rule string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(rows).select("page.url", "host", "path", "rule", "verdict").collect()}
    assert got == cases and url_filter.judged(rows.where("false")).count() == 0
    assert url_filter.judged(rows.union(rows)).count() == 2 * len(cases)
    own = spark.createDataFrame([("Soon", 0.4), ("now", 0.7), ("now", 0.1), ("", 9.0), (None, 9.0), ("never", None)], "term string, weight double")
    urls = spark.createDataFrame([("x://a.b/now",), ("x://a.b/now-soon",), ("x://a.b/now-now",), ("x://a.b/nowhere-soon",)], "url string")
    found = {r["url"]: (r["verdict"], r["terms"]) for r in url_filter.judged(urls, rules=(), vocabulary=own).select("page.url", "verdict", "terms").collect()}
    assert found == {"x://a.b/now": ("allow", 1), "x://a.b/now-soon": ("block", 2), "x://a.b/now-now": ("allow", 1), "x://a.b/nowhere-soon": ("allow", 1)}


@pytest.mark.parametrize("name", ["op1_neighbours", "op3_licences", "op9_decontamination", "op10_url_filter"])
def test_same_as_sql(spark, data, name):
    assert_same(registered.queries()[name](spark, data).toPandas(), database(data).sql(registered.oracle_sql()[name]).df())


def medium():
    return "/root/testdata/sf0.1"


def held_out(spark, query, folder):
    return query(spark, folder).toPandas().query("held_out")


def test_language_on_held_out_rows(spark, data):
    small = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang").toPandas()
    got = held_out(spark, registered.op2_language, small).merge(truth, on="doc_id")
    assert (got.lang_pred == got.lang).mean() > 0.99 and got.score.between(0, 1).all()


def test_language_cases(spark):
    docs = table(spark, [(1, None), (2, "12 34 !"), (3, ""), (4, "the cat and the dog"), (4, "the cat and the dog")])
    model = language.fitted(table(spark, [(k, t) for k, t in enumerate(["the cat and the dog sat", "le chat et le chien sont"] * 20)], lang=["en", "fr"] * 20), F.lit(True))
    got = [(r["doc_id"], r["lang_pred"], r["accepted"]) for r in language.predicted(docs, model).select("doc.doc_id", "lang_pred", "accepted").orderBy("doc_id").collect()]
    assert [g[1] for g in got] == ["und", "und", "und", "en", "en"] and not got[0][2]
    assert language.fitted(docs.where("false"), F.lit(True)) is None
    assert {r["lang_pred"] for r in language.predicted(docs, None).collect()} == {"und"}
    assert language.predicted(docs.where("false"), model).count() == 0


def area(score, label):
    rank = score.rank()
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize("query, label", [(registered.op7_quality, "quality"), (registered.op8_toxicity, "toxic")])
def test_classifiers_on_held_out_rows(spark, data, query, label):
    truth = spark.read.parquet(f"{medium()}/labels.parquet").toPandas()
    all_rows = query(spark, medium()).toPandas()
    got = all_rows.query("held_out").merge(truth, on="doc_id")
    assert len(all_rows) == spark.read.parquet(f"{medium()}/documents.parquet").count() and all_rows.score.between(0, 1).all()
    assert area(got.score, got[label]) > 0.95 and (got.predicted == got[label]).mean() > 0.97


def test_classifiers_without_labels(spark):
    docs, none = table(spark, [(1, None), (2, ""), (3, "x" * 200_000), (4, "A b! c")]), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    one_kind = spark.createDataFrame([(4, 1, 1), (4, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    for labels in (none, one_kind):
        for module in (quality, toxicity):
            model = module.fitted(docs, labels, F.lit(True))
            got = module.scored(docs, model).select("doc.doc_id", "score").collect()
            assert len(got) == 4 and len({r["score"] for r in got}) == 1 and 0 < got[0]["score"] < 1
            assert module.scored(docs.where("false"), model).count() == 0


def plain_words(text):
    """Runs of ASCII letters, digits and everything beyond ASCII, as bytes."""
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", text)


def test_quality_scores_equal_a_plain_computation(spark, data, texts):
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fitted(docs, labels, F.lit(True))
    got = {}
    for r in quality.scored(table(spark, texts).repartition(5), model).select("doc.doc_id", "score").collect():
        got.setdefault(r["doc_id"], set()).add(r["score"])
    for i, t in texts:
        raw = (t or "").encode()
        count = Counter(int(quality.word_hashes(w)[0]) % quality.WORDS for w in plain_words(raw.lower()))
        n = max(1, sum(count.values()))
        stats = quality.features(raw)[2]
        assert stats[0] == np.log1p(len(raw)) and stats[1] == np.log1p(sum(count.values())) and stats[7] == raw.count(b"!") / max(1, len(raw))
        x = {b: 8 * c / n for b, c in count.items()} | {quality.WORDS + k: min(max((v - model.mean[k]) / model.scale[k], model.low[k]), model.high[k]) for k, v in enumerate(stats)}
        y = model.w0 + sum(model.w[k] * v for k, v in x.items()) + 0.5 * sum(sum(model.v[k, f] * v for k, v in x.items()) ** 2 - sum((model.v[k, f] * v) ** 2 for k, v in x.items()) for f in range(quality.RANK))
        want = 1 / (1 + np.exp(-min(35, max(-35, model.a * y + model.b))))
        assert all(abs(s - want) < 1e-9 for s in got[i])


def test_language_scores_equal_a_plain_computation(spark, data, texts):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fitted(docs, F.lit(True))
    more = [(50, "Grüße aus der Stadt und vom Land"), (51, "el perro y la casa"), (52, "a" * 20), (53, "x1y2z3"), (54, "the dog " * 40_000)]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predicted(table(spark, [*texts, *more]).repartition(6), model).select("doc.doc_id", "lang_pred", "score").collect()}
    mask = (1 << 64) - 1
    for i, t in [*texts[:6], *texts[12:], *more[:4]]:
        padded = " " + " ".join(re.findall(r"[^\W\d_]+", (t or "").lower())) + " "
        counts = np.zeros(language.BUCKETS)
        for n in (2, 3, 4):
            for k in range(len(padded) - n + 1):
                if padded[k : k + n].strip() and " " not in padded[k + 1 : k + n - 1]:
                    h = ord(padded[k]) * 0x9E3779B97F4A7C15 & mask
                    for c in padded[k + 1 : k + n]:
                        h = ((h ^ h >> 29) * 0xBF58476D1CE4E5B9 + ord(c) * 0x94D049BB133111EB) & mask
                    counts[((h ^ h >> 32) * 0xD6E8FEB86659FD93 & mask) >> 51] += 1
        if not padded.strip():
            assert got[i] == ("und", 0.0)
            continue
        logits = counts @ model.table / counts.sum() + model.bias
        p = np.exp(logits / model.temperature)
        p /= p.sum()
        assert got[i][0] == model.languages[p.argmax()] and abs(got[i][1] - p.max()) < 1e-9, i
    assert got[54][0] == "en"


def test_subwords_do_not_depend_on_pieces(monkeypatch):
    text = "Ein Wort, noch ein langesWort " + "ab" * 300 + " fin."
    whole = language.bucket_counts(text)
    for piece in (1, 7, 64):
        monkeypatch.setattr(language, "PIECE", piece)
        assert (language.bucket_counts(text) == whole).all()


def test_toxicity_scores_equal_a_plain_computation(spark, data, texts):
    docs, labels = (spark.read.parquet(f"{medium()}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fitted(docs, labels, F.lit(True), most_rows=3000)
    assert model.lexicon
    term = max((t for t in model.lexicon if t.endswith("$") and t[:-1].isalpha()), key=len)[:-1]
    more = [(60, f"You {term}! YOU {term.upper()} ÉCOLE"), (61, f"x {term[0]}*{term[1:]} y" if len(term) > 2 else term), (62, "quiet text about nothing"), (63, "so 3rd-party_code v1.2b " + "w" * 200_000)]
    got = {}
    for r in toxicity.scored(table(spark, [*texts, *more]).repartition(6), model).select("doc.doc_id", "score").collect():
        got.setdefault(r["doc_id"], set()).add(r["score"])

    def known(w):
        return any(t in model.lexicon for t in [w + "$", *(w[:n] for n in toxicity.STEMS if len(w) >= n)])

    for i, t in [*texts[:6], *texts[7:], *more]:
        t = t or ""
        words = re.findall(r"[^\W\d_]+", t.lower())
        hits, second = [k for k, w in enumerate(words) if known(w)], {k for k, w in enumerate(words) if w in toxicity.SECOND}
        mixed = [m for m in re.findall(r"[\w@$!*.-]+", t.lower()) if re.search(r"[^\W\d_][\d@$!*_.-]+[^\W\d_]", m)]
        gaps = [b - a <= toxicity.NEAR for a, b in zip(hits, hits[1:])]
        longest = max((len(list(g)) for v, g in groupby(gaps) if v), default=0)
        n, size = max(1, len(words)), max(1, len(t))
        x = [min(50, len(hits)), len(hits) / n, min(50, len({words[k] for k in hits})), sum(any(abs(k - s) <= toxicity.NEAR for s in second) for k in hits) / n, len(second) / n, sum(c.isupper() and c.isalpha() for c in t) / max(1, sum(map(len, words))),
             t.count("!") / size, sum(map(t.count, ".,;:?'\"()-")) / size, len(mixed) / n, float(min(20, sum(known(w.translate(toxicity.PLAIN)) for w in mixed))), np.log1p(len(words)), longest]
        f = model.trees.base
        for feature, cut, leaf in model.trees.trees:
            at = 0
            for level in range(model.trees.depth):
                node = 2**level - 1 + at
                j = feature[node]
                at = 2 * at + (np.searchsorted(model.trees.cuts[j], x[j], "right") > cut[node])
            f += leaf[at]
        want = np.interp(f, model.calibrated.x, model.calibrated.y)
        assert all(abs(s - want) < 1e-9 for s in got[i]), (i, x)


def test_samples_keep_their_size_at_any_count(spark):
    for n in (10, 5 * 10**9, 4 * 10**10, 10**13):
        share = (training.below(3000, n) + (1 << 63)) / 2**64
        assert abs(share * n - 3000) < 1e-3 * 3000 + 1
    rows = spark.range(50_000).withColumn("v", F.lit(1))
    assert 2_700 < training.sampled(rows, "id", 3000).count() < 3_300 and training.sampled(rows, "id", 50_000).count() == 50_000
    hot = spark.range(30_000).select(F.when(F.col("id") < 20_000, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.lit("the text").alias("text"), F.lit("en").alias("lang"))
    known = training.once_each(hot.withColumnRenamed("doc_id", "id"), "id", ["lang", "text"])
    assert known.count() == 10_001
    labels = hot.select("doc_id", F.lit(1).alias("quality"))
    assert training.labelled(hot, labels, "quality", "doc_id", "text", F.lit(True), 500).count() < 650


def test_fitted_models_score_hard_texts_within_reason(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    hard = table(spark, [(1, None), (2, ""), (3, "x" * 300_000), (4, "You IDIOT!! " * 20_000), (5, "\n" * 1000), (5, "\n" * 1000)])
    for module in (quality, toxicity):
        model = module.fitted(docs, labels, F.lit(True))
        got = module.scored(hard, model).select("doc.doc_id", "score").collect()
        assert len(got) == 6 and all(0 < r["score"] < 1 for r in got) and len({r["score"] for r in got if r["doc_id"] == 5}) == 1


def test_factorisation_machine_equals_its_pairs():
    rows = [quality.features(words(40, k).encode()) for k in range(60)] + [quality.features(words(40, k).upper().encode()) for k in range(60)]
    model = quality.Model(rows, np.repeat([1.0, 0.0], 60), epochs=3)
    at, share, stats = rows[0]
    x = model._dense([rows[0]])[0]
    pairs = sum(model.v[i] @ model.v[j] * x[i] * x[j] for i in np.flatnonzero(x) for j in np.flatnonzero(x) if i < j)
    assert abs(model._margin_of((at, share, stats)) - (model.w0 + x @ model.w + pairs)) < 1e-8


def test_trees_and_calibration():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = boosting.Trees(x[:2000], y[:2000])
    margins = trees.margins(x[2000:])
    assert ((margins > 0) == (y[2000:] == 1)).mean() > 0.95
    p = boosting.Isotonic(margins, y[2000:])(np.sort(margins))
    assert (np.diff(p) >= 0).all() and 0 < p.min() and p.max() < 1


def test_pipeline_stages_keep_columns_and_clean_documents(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "mixing"]
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), stage(spark, kept, data).checkpoint()
        assert kept.columns == columns and 0.5 * before < kept.count() <= before, name
    rows = corpus_pipeline.run(spark, data).toPandas()
    assert sorted(rows.doc_id) == sorted(r["doc_id"] for r in kept.collect())
    prints = [brute_fingerprint(r["text"]) for r in docs.join(rows_of(spark, rows), "doc_id").collect()]
    assert all(bin(a ^ b).count("1") > 2 for k, a in enumerate(prints) for b in prints[:k])


def rows_of(spark, rows):
    return spark.createDataFrame([(int(d),) for d in rows.doc_id], "doc_id bigint")


def test_empty_documents_pass_through_the_stages(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert simhash.deduplicated(docs).count() == 0 and suffix_dedup.without_repeats(docs).count() == 0 and mixing.mixed(docs).count() == 0
    benchmark = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontaminate.decontaminated(docs, benchmark).count() == 0
    import corpus_pipeline

    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0
