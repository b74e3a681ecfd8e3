"""Near copies by Jaccard 0.8 of five-word shingles against brute force."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from docloom.llm import near_copies
from tests.llm.test_operators import brute_components, brute_fingerprint, table, words


def varied():
    rng, texts = np.random.default_rng(7), []
    for g in range(12):
        base = words(int(rng.integers(20, 200)), 100 + g).split()
        for _ in range(8):
            body = list(base)
            for k in rng.integers(0, len(body), int(rng.integers(0, 5))):
                body[k] = f"new{rng.integers(0, 99)}"
            texts.append(" ".join(body))
    line = words(30, 77)
    texts += [f"{line} {words(40, 300 + k)}" for k in range(40)] + ["", None, " ", "a b", "A  b", "a b c d e f"]
    return list(enumerate(texts))


def jaccard(a, b):
    def of(t):
        w = (t or "").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}

    a, b = of(a), of(b)
    return len(a & b) / len(a | b)


def test_groups_equal_brute_force(spark):
    texts = varied()
    by_id, prints = dict(texts), {i: brute_fingerprint(t) for i, t in texts}
    root = brute_components(list(by_id), lambda a, b: jaccard(by_id[a], by_id[b]) >= 0.8 or bin(prints[a] ^ prints[b]).count("1") <= 2)
    got = corpus_pipeline.one_of_each(spark, table(spark, texts), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(root.values()))


@pytest.mark.parametrize("crowd, rounds, rows", [(0, 2, 0), (2, 8, 1_000_000)])
def test_groups_are_the_same_with_any_bound_on_crowds(spark, monkeypatch, crowd, rounds, rows):
    """Passages of several lengths that many texts share, texts that are little else, and near copies of all of these."""
    monkeypatch.setattr(near_copies, "CROWD", crowd)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    monkeypatch.setattr(near_copies, "BROADCAST_ROWS", rows)
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    rng, texts = np.random.default_rng(3), []
    passages = [words(n, 500 + n).split() for n in (6, 12, 40)]
    for k in range(90):
        body = words(int(rng.integers(4, 50)), 600 + k).split()
        for p in passages:
            if rng.integers(0, 3):
                at = int(rng.integers(0, len(body) + 1))
                body[at:at] = p
        texts.append(" ".join(body))
        if k % 4 == 0:
            body[int(rng.integers(0, len(body)))] = "changed"
            texts.append(" ".join(body))
    texts = list(enumerate(texts))
    by_id = dict(texts)
    root = brute_components(list(by_id), lambda a, b: jaccard(by_id[a], by_id[b]) >= 0.8)
    found = near_copies.groups(table(spark, texts)).collect()
    prints = {i: brute_fingerprint(t) for i, t in texts}
    both = brute_components(list(by_id), lambda a, b: jaccard(by_id[a], by_id[b]) >= 0.8 or bin(prints[a] ^ prints[b]).count("1") <= 2)
    named = {hashlib.md5(t.encode()).digest(): i for i, t in texts}
    got = {}
    for r in found:
        got.setdefault(bytes(r["root"]), set()).add(named[bytes(r["t"])])
    want = {}
    for i, r in both.items():
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1) and root


def test_pairs_that_meet_grow_with_the_table(spark, monkeypatch):
    """A passage in every tenth text, of which the sample shows nothing, brings no pairs together."""
    monkeypatch.setattr(near_copies, "SAMPLE", 8)
    compared = []
    whole = near_copies._compared
    monkeypatch.setattr(near_copies, "_compared", lambda texts, sets, pairs: compared.append(pairs.count()) or whole(texts, sets, pairs))
    passage, counts = words(12, 1), []
    for n in (1000, 4000):
        rng = np.random.default_rng(n)
        texts = [(k, " ".join(f"u{x}" for x in rng.integers(0, 1 << 40, 30)) + (f" {passage}" if k % 10 == 0 else "")) for k in range(n)]
        compared.clear()
        near_copies.groups(table(spark, texts))
        counts.append(sum(compared))
    assert counts[1] <= 4 * max(counts[0], 200), counts


def test_only_sets_that_post_others_take_part_in_later_rounds(spark, monkeypatch):
    """100 texts hold a common passage; each shares a phrase with two texts that do not."""
    monkeypatch.setattr(near_copies, "SAMPLE", 1)
    taking_part, met_in = [], near_copies._met_in
    monkeypatch.setattr(near_copies, "_met_in", lambda texts, sets, post, *more: taking_part.append(post.select("p.node").distinct().count()) or met_in(texts, sets, post, *more))
    passage, texts = words(20, 1), []
    for k in range(100):
        phrase = words(20, 1000 + k)
        texts += [f"{words(30, 2000 + 3 * k + i)} {phrase}{f' {passage}' if i == 0 else ''}" for i in range(3)]
    assert near_copies.groups(table(spark, list(enumerate(texts)))).count() == 0
    assert len(taking_part) > 1 and taking_part[0] > 200 and max(taking_part[1:]) <= 100, taking_part


def test_shingles_are_counted_over_a_share_of_the_table(spark, monkeypatch):
    """What a fiftieth of all texts has is known to the order of a table of any size."""
    monkeypatch.setattr(near_copies, "SAMPLE", 100)
    monkeypatch.setattr(near_copies, "OUT_OF", 200, raising=False)
    passage = words(8, 1)
    texts = [(k, f"{words(12, 100 + k)} {passage}" if k % 50 == 0 else words(20, 100 + k)) for k in range(1000)]
    rows = table(spark, texts).select(near_copies.text_hash("text").alias("t"), "text")
    assert set(near_copies.shingles(passage.encode()).tolist()) <= set(near_copies._counted(rows)[0].tolist())


def test_what_is_looked_at_for_a_passage_grows_with_its_places_alone(spark, monkeypatch):
    """Neither longer texts around a common passage nor copies of these make more rows, and all of the passage is found."""
    made, frame = [], type(spark.range(0))
    inner = frame.mapInArrow

    def spied(self, func, schema, *more, **named):
        out = inner(self, func, schema, *more, **named)
        if schema == "root bigint, key bigint":
            made.append(out.count())
        return out

    monkeypatch.setattr(frame, "mapInArrow", spied)
    passage = words(20, 1)
    common = near_copies.shingles(passage.encode()).view(np.int64).tolist()
    crowded = spark.createDataFrame([(common[0],)], "key bigint")
    for size, copies in ((200, 1), (1000, 3)):
        texts = [f"{words(size, 5000 + k)} {passage} {words(size, 6000 + k)} copy{c}" for k in range(40) for c in range(copies)]
        names = [(k, bytearray(hashlib.md5(t.encode()).digest()), t) for k, t in enumerate(texts)]
        named = spark.createDataFrame([(t, text) for _, t, text in names], "t binary, text string")
        sets = spark.createDataFrame([(k, t, common[:1]) for k, t, _ in names], "node bigint, t binary, keys array<bigint>")
        links = spark.createDataFrame([(k, k - k % copies) for k, _, _ in names if k % copies], "a bigint, b bigint")
        assert sorted(r["key"] for r in near_copies._crowding(named, sets, links, crowded).collect()) == sorted(common)
    assert len(made) == 2 and max(made) <= 40 * (2 * near_copies.REACH + 1), made


def test_any_order_of_shingles_lets_near_sets_meet():
    rng = np.random.default_rng(1)
    for n in range(1, 60):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.permutation(n)[: n - n // 9]], rng.integers(0, 1 << 63, n // 9, dtype=np.uint64)]))
        counted = np.unique(rng.choice(np.concatenate([a, b]), n // 2 + 1))
        counts = rng.integers(3, 9, len(counted))
        assert not near_copies.alike(a, b) or set(near_copies.prefix(a, counted, counts)) & set(near_copies.prefix(b, counted, counts))


def test_one_row_of_each_group_where_ids_repeat_or_lack(spark):
    a, b, c = (words(120, 900 + k) for k in range(3))
    rows = [(1, a), (2, a + " more"), (2, b), (2, b + " more"), (None, c), (None, c), (None, c + " more"), (3, b + " less"), (None, a)]
    got = [(r["doc_id"], r["text"][:20]) for r in corpus_pipeline.one_of_each(spark, table(spark, rows), "").collect()]
    assert sorted(got, key=repr) == sorted([(1, a[:20]), (2, b[:20]), (None, c[:20])], key=repr)
