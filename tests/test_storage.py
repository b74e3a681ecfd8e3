"""Tables merged in storage, and crawls that stop and go on."""

import glob
import hashlib
import os
from collections import deque

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docloom.operators import crawl
from docloom.sources import store, writers


def files(folder):
    return set(glob.glob(f"{folder}/data/**/part-*", recursive=True))


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(k, f"s{k % 40}", 1, f"old {k}") for k in range(200)] + [(None, None, 1, "none")]
    store.created(spark.createDataFrame(rows, "id bigint, source string, version int, text string"), path, ["id"], 16)
    return path


def test_a_merge_rewrites_the_buckets_that_it_touches(spark, table):
    before, old = files(table), store.read(spark, table)
    new = spark.createDataFrame([("new 7", 7, 2, "s7"), ("stale 9", 9, 0, "s9"), ("more", 900, 1, "x"), ("same", 11, 1, "s11"), ("nothing", None, 5, None)], "text string, id bigint, version int, source string")
    touched = store.merged(new, table, "version")
    got = {r["id"]: r["text"] for r in store.read(spark, table).collect()}
    assert got == {**{k: f"old {k}" for k in range(200)}, 7: "new 7", 900: "more", 11: "same", None: "nothing"}
    assert len(touched) <= 5 and before < files(table)
    live = {p for f in store.read(spark, table).inputFiles() for p in [f.removeprefix("file://")]}
    kept = {p for p in before if int(os.path.basename(os.path.dirname(p)).split("=")[1]) not in touched}
    assert kept <= live and not live & {p for p in before if p not in kept}
    assert {r["text"] for r in old.collect()} == {*(f"old {k}" for k in range(200)), "none"}  # a reader keeps to its version


def test_sources_are_replaced_and_of_two_writers_one_fails(spark, table, monkeypatch):
    new = spark.createDataFrame([(1000, "s3", 1, "x"), (1001, None, 1, "y"), (1002, "fresh", 1, "z")], "id bigint, source string, version int, text string")
    store.sources_replaced(new, table, "source")
    got = {r["id"]: r["source"] for r in store.read(spark, table).collect()}
    assert got == {**{k: f"s{k % 40}" for k in range(200) if k % 40 != 3}, 1000: "s3", 1001: None, 1002: "fresh"}
    real = writers._versions
    monkeypatch.setattr(writers, "_versions", lambda spark, path: real(spark, path)[:-1])  # as another writer saw it before
    with pytest.raises(Exception, match="(?i)exist"):
        writers.save_state(spark.range(3), f"{table}/versions")
    monkeypatch.undo()
    assert store.read(spark, table).count() == len(got)


def test_empty_tables_and_batches(spark, tmp_path):
    path, none = str(tmp_path / "t"), spark.createDataFrame([], "id int, v int")
    with pytest.raises(ValueError, match="no table"):
        store.read(spark, path)
    store.created(none, path, ["id"], 4)
    assert store.read(spark, path).count() == 0 and store.merged(none, path, "v") == []
    assert len(store.merged(spark.createDataFrame([(1, 1)], "id int, v int"), path, "v")) == 1 and store.read(spark, path).count() == 1


def walked(pages, seeds, most_depth, most_pages, allowed):
    """One queue, first in, first out."""
    visited, queue, out = set(), deque(), []
    for s in seeds:
        if allowed(s) and s not in [q[0] for q in queue]:
            queue.append((s, 0, None))
    while queue and len(out) < most_pages:
        url, depth, parent = queue.popleft()
        if url in visited:
            continue
        visited.add(url)
        final, links = pages.get(url, (url, None))
        final = final or url
        attempt = len(out) + 1
        if not allowed(final):
            out.append((url, final, parent, depth, attempt, "out_of_scope"))
            continue
        if final != url and final in visited:
            out.append((url, final, parent, depth, attempt, "already_visited"))
            continue
        visited.add(final)
        out.append((url, final, parent, depth, attempt, "scrape_failed" if url not in pages else "fetched"))
        if url in pages and depth < most_depth:
            for link in links or []:
                if allowed(link) and link not in visited and link not in [q[0] for q in queue]:
                    queue.append((link, depth + 1, final))
    return out


@pytest.mark.parametrize("seed, most_depth, most_pages", [(1, 3, 1000), (2, 2, 25), (3, 4, 60)])
def test_a_crawl_equals_one_queue_and_can_stop(spark, tmp_path, seed, most_depth, most_pages):
    """Pages that link at random, to themselves and to what is not there, and addresses that lead to others."""
    rng = np.random.default_rng(seed)
    names = [f"u{k:02d}" for k in range(70)]
    pages = {u: (names[int(rng.integers(0, 70))] if rng.integers(0, 3) == 0 else None if rng.integers(0, 5) == 0 else u, [names[int(k)] for k in rng.integers(0, 70, int(rng.integers(0, 6)))]) for u in names[:60]}
    seeds, allowed = ["u03", "u65", "u04", "u03", "u66"], lambda u: not u.endswith("7")
    want = walked(pages, seeds, most_depth, most_pages, allowed)
    table = spark.createDataFrame([(u, f, ls) for u, (f, ls) in pages.items()], "url string, final_url string, links array<string>")
    starts = spark.createDataFrame([(u, k) for k, u in enumerate(seeds)], "url string, pos int")
    run = lambda name, **more: crawl.crawled(table, starts, str(tmp_path / name), most_depth, most_pages, lambda u: ~F.endswith(u, F.lit("7")), **more)
    whole = sorted(map(tuple, run("whole").collect()), key=lambda r: r[4])
    assert whole == want
    stopped = run("stopped", most_levels=1).collect()
    assert 0 < len(stopped) <= len(want) and {r["depth"] for r in stopped} == {0}
    table_again = run("stopped")
    if most_pages >= len(want) + len(stopped):
        assert sorted(map(tuple, table_again.collect()), key=lambda r: r[4]) == want
        assert run("stopped").count() == len(want)  # nothing is left to do


def test_a_crawl_goes_on_where_its_pages_ran_out(spark, tmp_path):
    pages = {f"u{k}": (None, [f"u{2 * k + 1}", f"u{2 * k + 2}"]) for k in range(40)}
    table = spark.createDataFrame([(u, f, ls) for u, (f, ls) in pages.items()], "url string, final_url string, links array<string>")
    starts, path = spark.createDataFrame([("u0", 0)], "url string, pos int"), str(tmp_path / "crawl")
    for _ in range(4):
        found = crawl.crawled(table, starts, path, 5, 9)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[4]) == walked(pages, ["u0"], 5, 36, lambda u: True)
    assert crawl.crawled(table, starts.where("false"), str(tmp_path / "none")).count() == 0


def test_no_version_is_written_twice(spark, tmp_path):
    path = str(tmp_path / "state")
    assert writers.load_state(spark, path, "id bigint").count() == 0
    assert [writers.save_state(spark.range(n), path) for n in (1, 2)] == [0, 1] and writers.load_state(spark, path, "id bigint").count() == 2
    with pytest.raises(PySparkException):
        writers.save_state(spark.range(3).select(F.raise_error(F.lit("lost")).alias("id")), path)
    assert writers.load_state(spark, path, "id bigint").count() == 2


def test_artifacts_are_written_once(spark, tmp_path):
    path, kind = str(tmp_path / "out"), "chunk_index int, text string, n_chars int, preview string, source_id string"
    chunks = spark.createDataFrame([("s1", 0, "one"), ("s1", 1, "x" * 400), ("s 2/é", 0, None)], "source_id string, chunk_index int, text string")
    assert writers.chunk_artifact(chunks, path, "r1") and not writers.chunk_artifact(chunks.where("false"), path, "r1")
    got = writers.artifacts(spark, path, kind)
    assert sorted((r["source_id"], r["chunk_index"], r["n_chars"], len(r["preview"] or "")) for r in got.collect()) == [("s 2/é", 0, None, 0), ("s1", 0, 3, 3), ("s1", 1, 400, 300)]
    with pytest.raises(PySparkException):
        writers.chunk_artifact(chunks.withColumn("text", F.raise_error(F.lit("killed")).cast("string")), path, "r2")
    assert writers.artifacts(spark, path, kind).count() == 3
    assert writers.chunk_artifact(chunks, path, "r2") and writers.artifacts(spark, path, kind).groupBy("run").count().count() == 2


def test_the_evaluation_report_counts_its_results(spark, tmp_path):
    results = spark.createDataFrame([("q1", "passed", []), ("q2", "failed", ["no date"]), ("q3", "passed", [])], "query string, status string, errors array<string>")
    assert writers.evaluation_report(results, str(tmp_path / "eval"), "r1") and not writers.evaluation_report(results, str(tmp_path / "eval"), "r1")
    got = writers.artifacts(spark, str(tmp_path / "eval"), "query string, status string, errors array<string>, n bigint, by_status map<string,bigint>, part string").collect()
    assert [(r["n"], r["by_status"]) for r in got if r["part"] == "summary"] == [(3, {"failed": 1, "passed": 2})]
    assert sorted((r["query"], r["errors"]) for r in got if r["part"] == "results") == [("q1", []), ("q2", ["no date"]), ("q3", [])]


def test_the_registered_crawl_equals_one_queue(spark, data):
    """Over the links of all pages; addresses in capitals or with a full stop lead to the plain word, if pages link to it."""
    import re

    from docloom.plans import documents

    html = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html").orderBy("page_id").collect()
    linked = {r["page_id"]: re.findall('href="/([^"]*)"', r["html"]) for r in html}
    owner = {}
    for p, words in linked.items():
        for w in words:
            key = hashlib.md5(f"{w}{p}".encode()).hexdigest()
            owner[w] = min(owner.get(w, (key, p)), (key, p))
    site = "https://words.example.org/"
    final = lambda w: site + (v if (v := re.sub("[.]$", "", w.lower())) in owner else w)
    pages = {site + w: (final(w), [site + x for x in linked[p]]) for w, (_, p) in owner.items()}
    seeds = [site + linked[p][0] for p in sorted(linked) if p % 10 == 3 and linked[p]]
    got = sorted(map(tuple, documents.crawl_resumed(spark, data).collect()), key=lambda r: r[4])
    assert got == walked(pages, seeds, 3, 1_000_000, lambda u: not u.endswith(","))
    assert {r[5] for r in got} >= {"fetched"}
