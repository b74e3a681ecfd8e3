"""Behaviour of single operators on small inputs."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import citations, rules, text, urls
from docloom.operators import chunking, crawl, guards, html, records, remote, retrieval, scans, tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_chunks_overlap_and_stay_within_bounds():
    body = ("lorem ipsum dolor sit amet " * 80).strip()
    got = chunking.overlapping(body, 600, 120, 120)
    assert len(got) > 1
    assert all(len(t) <= 600 for t, _, _ in got[:-1]) and len(got[-1][0]) <= 720
    assert all(b[1] < a[2] for a, b in zip(got, got[1:]))


def test_a_short_remainder_joins_the_last_chunk():
    got = chunking.overlapping(" ".join(["abcdef"] * 220), 1000, 800, 100)
    assert len(got) == 2 and len(got[1][0]) > 500
    assert chunking.overlapping("", 100, 10, 10) == []


def test_a_table_row_is_kept_whole():
    row = "Table: fees | " + "amount | " * 30
    got = chunking.overlapping(f"{row}\nnext line " + "words " * 50, 140, 20, 20, 600)
    assert row.strip() in got[0][0]


def test_recursive_pieces_keep_all_words_and_the_size():
    body = "\n\n".join("para%d " % i + "word " * 40 for i in range(12))
    got = chunking.recursive(body, 300, 60)
    assert all(len(p) <= 300 for p in got)
    assert set(body.split()) == {w for p in got for w in p.split()}


def test_chunk_input_lines(spark):
    assert one(spark, text.normalize_chunk_input(F.lit("Line 1\r\n\r\n\r\n\tLine 2   with  spaces \n\n Line 3"))) == "Line 1\n\nLine 2 with spaces\n\nLine 3"


@pytest.mark.parametrize("raw, want", [("R179(b)", "IRPR_179b"), ("R205", "IRPR_205"), ("A40(1)(a)", "IRPA_A40_1a"), ("A25(1)", "IRPA_A25_1"), ("R200(1)(c)", "IRPR_200_1c"), ("none", "")])
def test_section_ids(spark, raw, want):
    assert one(spark, rules.section_id(F.lit(f"see {raw} now"))) == want


def test_citation_tokens(spark):
    assert one(spark, citations.tokens(F.lit("[p1] [ C2 ] [P1] [c2] [ d3 ]"))) == ["P1", "C2", "D3"]
    assert one(spark, citations.validated(F.lit("A claim [P1] , and [P9] ."), F.array(F.lit("P1")))) == "A claim [P1], and."
    assert one(spark, citations.validated(F.lit("[P1] x"), F.array().cast("array<string>"))) == "x"


def test_relevance_and_paragraphs(spark):
    assert one(spark, citations.relevance(F.lit(0.91))) == 91
    assert one(spark, citations.relevance(F.lit(None).cast("double"))) == 80
    assert one(spark, text.paragraph_numbers(F.array(*map(F.lit, ("1", "2", "2.8", "x"))))) == [1, 2, 2]


def test_wrapped_urls(spark):
    inner = "https://www.canada.ca/en/ircc/page.html?b=2&a=1&utm_source=x#top"
    from base64 import urlsafe_b64encode
    from urllib.parse import quote

    rows = [(0, inner), (1, "https://out.example.org/?url=" + quote(inner, safe="")), (2, "https://o.example.org/?next=" + quote("https://o.example.org/?target=" + quote("https://www.canada.ca//en/x/?b=2", safe=""), safe="")), (3, "https://o.example.org/?u=" + urlsafe_b64encode(inner.encode()).decode().rstrip("=")), (4, "mailto:x@y"), (5, None)]
    got = {r["k"]: r["canonical"] for r in urls.with_canonical(spark.createDataFrame(rows, "k int, url string"), "url").collect()}
    want = "https://www.canada.ca/en/ircc/page.html?a=1&b=2"
    assert got == {0: want, 1: want, 2: "https://www.canada.ca/en/x?b=2", 3: want, 4: None, 5: None}


def test_source_policy(spark):
    cases = {"https://www.canada.ca/en/ircc/x": "ALLOWED", "https://example.com/a": "HOST_BLOCKED", "https://www.canada.ca/wp-content/a": "PATH_BLOCKED", "https://www.canada.ca/x/outbound/a": "PATH_BLOCKED", "https://www.canada.ca/fr/a": "PATH_NOT_ALLOWED", "https://other.org/": "HOST_NOT_ALLOWED", "nothing": "INVALID_URL"}
    got = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.policy_reason(F.col("u")).alias("r")).collect()
    assert {r["u"]: r["r"] for r in got} == cases


def test_sections_follow_headings():
    got = html.sections_of(html.Page("<body><main><h1>Top</h1><p>" + "intro " * 40 + "</p><h2 id='eligibility'>Who</h2><ul><li>one<ul><li>two</li></ul></li></ul><h3 id='documents'>Papers</h3><p>list</p></main></body>"))
    assert [len(p) for p, _, _ in got] == [1, 2, 3]
    assert got[1][1] == "#eligibility" and got[1][2] == "- one - two"
    assert html.sections_of(html.Page("<html><title>T</title><body><p>x</p></body></html>")) == [(["T"], "", "x")]
    assert html.sections_of(html.Page("")) == []


LONG = "enough words that this is the content of the page and no mere notice of anything else, " * 2


def page_of(body, head=""):
    return html.Page(f"<html><head>{head}</head><body>{body}</body></html>")


def test_junk_goes_and_forms_stay():
    page = page_of(f'<div class="cookie-banner">We use cookies</div><div id="sidebar">beside</div><div id="main-content"><h1>T</h1><p>{LONG}</p><nav>n</nav><p id="x-consent">c</p></div>')
    assert html.sections_of(page) == [(["T"], "", LONG.strip())]
    page = page_of("<form><p>In a form</p></form><aside><p>In an aside</p></aside>", "<title>T</title>")
    assert html.sections_of(page) == [(["T"], "", "In a form In an aside")]


def test_containers_are_chosen_in_order():
    long, short = f"<p>{LONG}</p>", "<p>short</p>"
    for body, tag, attrs in (
        (f"<article>{long}{long}</article><main>{long}</main>", "main", {}),
        (f"<main>{short}</main><main>{long}</main><div class='a content'>{long}</div>", "div", {"class": "a content"}),
        (f"<div class='contents'>{long}</div><div role='main'>{long}</div>", "div", {"role": "main"}),
        (f"<div class='field--name-body'>{long}</div><div role='main'>{long}</div>", "div", {"class": "field--name-body"}),
        (f"<main class='banner'>{long}</main><p>{LONG}</p>", "body", {}),
        (f"<article>{long}</article>", "body", {}),
    ):
        got = page_of(body).content
        assert (got.tag, got.attrs) == (tag, attrs), body


def test_titles_and_dates_of_pages():
    assert page_of("<h1> </h1>", "<title>T</title>").title() == "T" and page_of("").title() == "Untitled PDI" and page_of("<nav><h1>n</h1></nav><h1>a <b>b</b></h1>").title() == "a b"
    dates = {"2024-03-05": "2024-03-05", "March 5, 2024": "2024-03-05", "Sept 31, 2024": "2024-10-01", "5 Mar 2024": "2024-03-05", "Foo 5, 2024": None, "Mar 32, 2024": None, "05/03/2024": None, "": None, "Foo 1, 2024 and 7 June 2022": "2022-06-07"}
    assert {d: html.iso_date(d) for d in dates} == dates
    assert page_of(f"<main>{LONG}</main><p>Date modified: 5 Mar 2024</p>").updated() == "2024-03-05"
    assert page_of(f"<main>{LONG}<p>last updated soon</p></main><p>Date modified: 5 Mar 2024</p>").updated() is None
    assert page_of("<td>Date modified: 2024-01-01</td>").updated() is None and page_of("<p>2024-01-01</p>").updated() is None
    assert page_of("<footer><p>Date modified: 2024-01-01</p></footer>").updated() is None


def test_links_of_the_crawled_part(spark):
    rows = [(1, "https://e.org/a/", "<nav><a href='/n'>n</a></nav><main><a href='b?utm_source=x'>b</a><a href='b'>b</a><a>none</a></main>"), (2, "https://e.org/", "<nav><a href='/n'>n</a></nav>"), (3, "https://e.org/", None), (4, "https://e.org/", "<div id='wb-cont'><a href='http://[bad'>x</a><a href='mailto:x'>m</a></div><a href='/c'>c</a>")]
    got = html.links(spark.createDataFrame(rows, "page_id int, url string, html string"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "https://e.org/a/b"), (2, 0, "https://e.org/n")]


def test_deep_pages_are_read():
    deep = "<div>" * 20_000 + "<p>in it</p><ul>" + "<li>x<ul>" * 3_000
    page = page_of(deep, "<title>T</title>")
    (path, _, text), = html.sections_of(page)
    assert path == ["T"] and text.startswith("in it - x - x") and page.updated() is None and html.lines_of(page)


def test_tables_are_labelled():
    page = html.Page("<table><caption>Fees</caption><tr><th>Kind</th><th>Cost</th></tr><tr><td>a</td><td>1</td></tr></table>")
    assert html.table_lines(page, page.root.children("table")[0]) == ["Table: Fees", "Kind: a | Cost: 1"]


def test_running_lines_go(spark):
    pages = spark.createDataFrame([(1, p, f"Manual\nBody {'abc'[p]}\n\nPage {p}") for p in range(3)], "doc int, page int, text string")
    got = chunking.without_running_lines(pages, "doc", "page", "text").orderBy("page").collect()
    assert [r["text"].strip() for r in got] == ["Body a", "Body b", "Body c"]


def test_batches_by_count_and_size(spark):
    rows = spark.createDataFrame([("s", k, n) for k, n in enumerate((700, 700, 10, 10, 10, 5000, 1))], "s string, k int, n int")
    got = [r["batch"] for r in tables.batches(rows, "s", "k", "n", 3, 1200).orderBy("k").collect()]
    assert got == [0, 1, 1, 1, 2, 3, 4]


def test_batches_keep_ties_and_null_groups(spark):
    rows = [(None, 1, 5), ("a", 1, 2), ("a", 1, 2), (None, 2, 6), ("a", 2, None), ("b", 1, 99)]
    got = tables.batches(spark.createDataFrame(rows, "s string, k int, n int"), "s", "k", "n", 2, 10).collect()
    assert sorted(tuple(r) for r in got if r["s"] is None) == [(None, 1, 5, 0), (None, 2, 6, 1)]
    assert sorted((r["k"], r["batch"]) for r in got if r["s"] == "a") == [(1, 0), (1, 0), (2, 1)]
    assert len(got) == 6 and tables.batches(spark.createDataFrame([], "s string, k int, n int"), "s", "k", "n", 2, 10).count() == 0


def test_long_groups_are_batched_in_one_pass(spark):
    rows = spark.range(200_000).select(F.lit("s").alias("s"), F.col("id").alias("k"), F.lit(7).alias("n"))
    got = tables.batches(rows, "s", "k", "n", 100, 70).groupBy("batch").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert [tuple(r) for r in got] == [(10, 20_000)]


def test_vectors_must_be_finite(spark):
    record = lambda x: F.struct(F.lit("i").alias("id"), F.array(F.lit(1.0), F.lit(x)).alias("values"), F.lit("t").alias("text"))
    assert [one(spark, guards.vector_valid(record(x), 2)) for x in (2.0, float("inf"), float("nan"), None)] == [True, False, False, False]


def test_nested_payloads_of_urls(spark):
    page = "https://www.canada.ca/study-permit.html"
    payloads = [
        ('{"urls":["https://e.com/redirect?url=https%3A%2F%2Fwww.canada.ca%2Fstudy-permit.html&utm_source=t",["' + page + '#eligibility",{"href":"' + page + '?utm_medium=email"}]]}', [page]),
        ('{"urls":["https://www.canada.ca/i.html?a=1&b=2","https://www.canada.ca/i.html?b=2&a=1","not-a-url","",null,123]}', ["https://www.canada.ca/i.html?a=1&b=2"]), ('{"url":"https://www.canada.ca/i.html"}', ["https://www.canada.ca/i.html"]), ("{}", []), (None, []), ("none", []),
        ('{"url":' + "[" * 8 + '"https://a.b/8",["https://a.b/9"]' + "]" * 8 + "}", ["https://a.b/8"]),
    ]
    rows = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(payloads)], "k int, p string").select("k", F.posexplode(urls.payload_strings(F.col("p"))).alias("pos", "u"))
    kept = tables.keep_first(rows.select("k", "pos", urls.kept_form(F.col("u")).alias("url"), urls.dedupe_key(F.col("u")).alias("key")).where("key is not null"), ["k", "key"], ["pos"])
    got = {}
    for r in kept.orderBy("k", "pos").collect():
        got.setdefault(r["k"], []).append(r["url"])
    assert got == {k: want for k, (_, want) in enumerate(payloads) if want}


def test_printed_pages_are_cleaned_and_cut(spark):
    raw = "Scope of rules ....... 12\n.....\n2024-01-01\nhyphen-\nated  word\n\n\n\nKept ... here"
    assert one(spark, chunking.cleaned_page(F.lit(raw))) == "Scope of rules\nhyphenated word\n\nKept here"
    pages = spark.createDataFrame([("d", 1, "lead\n\n1 First part\nbody"), ("d", 2, "more\n\n1.1 Inner part\nb"), ("d", 3, ""), ("d", 4, "end"), ("e", 5, "only"), ("f", 6, None)], "doc string, page int, text string")
    got = [tuple(r) for r in chunking.page_sections(pages, "doc", "page", "text").orderBy("doc", "section").collect()]
    assert got == [
        ("d", 0, "Document", ["Document"], 1, 1, "lead"), ("d", 1, "1 First part", ["1 First part"], 1, 2, "1 First part\nbody\n\nmore"), ("d", 2, "1.1 Inner part", ["1 First part", "1.1 Inner part"], 2, 4, "1.1 Inner part\nb\n\nend"),
        ("e", 0, "Document", ["Document"], 5, 5, "only"),
    ]


def test_cut_places_match_a_plain_walk():
    """Chunks against a walk that looks for each cut in the text itself."""
    import random

    rng = random.Random(5)
    for _ in range(60):
        body = "".join(rng.choice(["word " * rng.randint(1, 30), "Table: x", "a | b | " + "c" * rng.randint(1, 200), "\n", "\n\n", "x" * rng.randint(1, 300)]) for _ in range(rng.randint(1, 40))).strip()
        for most, least, overlap, room in ((140, 40, 20, 600), (600, 120, 120, 400)):
            got = chunking.overlapping(body, most, least, overlap, room)
            for (text_, a, b), after in zip(got, [*got[1:], None]):
                assert text_ == body[a:b].strip()
                hard = a + most
                if b < len(body) and b <= hard:
                    lines, spaces = ([k for k in range(a + int(most * 0.6), hard + 1) if body[k] == mark] for mark in "\n ")
                    assert b == (lines or spaces or [hard])[-1]
                elif b < len(body):
                    assert body[b] == "\n" and b - hard <= room
                assert after is None or after[1] == (b - overlap if b - overlap > a else a + most - overlap)


def test_chunks_touch_pages_across_stretches(spark):
    spans = spark.createDataFrame([("d", p, p * 3000, p * 3000 + 2998) for p in range(6)], "doc string, page int, first int, last int")
    chunks = spark.createDataFrame([("d", 0, 0, 2998), ("d", 1, 2999, 9500), ("d", 2, 17_000, 99_000)], "doc string, chunk_index int, start_char int, end_char int")
    assert sorted(tuple(r) for r in chunking.chunk_pages(chunks, spans, "doc").collect()) == [("d", 0, 0, 0), ("d", 1, 1, 3), ("d", 2, 5, 5)]


def test_markdown_and_state_are_stored_once(spark, tmp_path):
    from docloom.sources import store, writers

    folder, state = str(tmp_path / "md"), str(tmp_path / "state")
    pages = spark.createDataFrame([("a.md", "one\ntwo\n"), ("b.md", "")], "name string, content string")
    assert store.append_markdown(pages, folder) == 2
    again = spark.createDataFrame([("a.md", "changed"), ("c.md", "new")], "name string, content string")
    assert store.append_markdown(again, folder) == 1 and store.append_markdown(again, folder) == 0
    assert {r["name"]: r["content"] for r in store.read(spark, folder).collect()} == {"a.md": "one\ntwo\n", "b.md": "", "c.md": "new"}
    assert writers.load_state(spark, state, "path string, n int").count() == 0
    for n in (1, 2):
        assert writers.save_state(spark.createDataFrame([("f", n)], "path string, n int"), state) == n - 1
    (tmp_path / "state" / "version=7").mkdir()  # a save that was cut off
    assert [tuple(r) for r in writers.load_state(spark, state, "path string, n int").collect()] == [("f", 2)]


def test_questions_of_an_owner_rank_its_chunks(spark):
    asked = spark.createDataFrame([(1, "Alpha beta beta", "o"), (2, "zz", "o"), (3, "gamma", "none")], "query_id int, query string, owner string")
    chunks = spark.createDataFrame([("o", 0, "ALPHA only"), ("o", 1, "x alpha beta beta y"), ("o", 2, " "), ("o", 3, "nothing"), ("p", 4, "gamma")], "owner string, chunk_index int, text string")
    got = [tuple(r) for r in retrieval.lexical_rank(asked, chunks, 2).select("query_id", "chunk_index", F.round("score", 4), "position").orderBy("query_id", "position").collect()]
    assert got == [(1, 1, 1.0, 1), (1, 0, 0.3333, 2), (2, 0, 0.0, 1), (2, 1, 0.0, 2)]


def test_columns_of_any_name_are_carried(spark):
    rows = spark.createDataFrame([(1, "https://a.b/?url=https%3A%2F%2Fc.d%2Fx", "i", "c", "o")], "k int, url string, _inner string, _c string, _one string")
    got = urls.with_canonical(rows, "url").first()
    assert got["canonical"] == "https://c.d/x" and got["_inner"] == "i"
    chunk = chunking.chunked_documents(rows.withColumn("text", F.lit("some text")), "text").first()
    assert chunk["_c"] == "c" and chunk["_one"] == "o" and chunk["chunk_text"] == "some text"


def test_failure_states_have_precedence(spark):
    no = F.array().cast("array<string>")
    state = lambda blocked=False, calls=0, issues=no, sources=1, query="a long and precise question": one(spark, guards.failure_state(F.lit(blocked), F.lit(calls), F.lit(2), F.lit(0), F.lit(0), issues, F.lit(sources), F.lit(0), F.lit(query)))
    assert state(True, 3) == "OUT_OF_SCOPE_SOURCE"
    assert state(calls=3) == "BUDGET_EXCEEDED"
    assert state(issues=F.array(F.lit(guards.UNVERIFIED[0]))) == "CITATION_MISMATCH"
    assert state(sources=0) == "INSUFFICIENT_EVIDENCE"
    assert state(query="help me") == "INSUFFICIENT_FACTS"
    assert state() == "NONE"


def test_notices_are_put_once(spark):
    once = text.analysis_date_header(F.lit("body"), F.lit("2024-01-01"))
    assert one(spark, once) == "Analysis date basis: 2024-01-01 (today)\n\nbody"
    assert one(spark, text.analysis_date_header(once, F.lit("2024-01-01"))) == one(spark, once)
    assert one(spark, text.with_notice(F.lit("x"), F.lit("n"))) == "n\n\nx"


def test_tier_sizes():
    assert [retrieval.tier_sizes(k) for k in (1, 8, 99)] == [(1, 1), (4, 4), (8, 8)]


def test_questions_in_blocks_find_the_same(spark, data):
    from docloom.plans.binding import chunks, questions

    a = retrieval.top_k(questions(spark, data), chunks(spark, data), 3).select("query_id", "id", "position").collect()
    b = retrieval.top_k(questions(spark, data), chunks(spark, data), 3, blocks=4).select("query_id", "id", "position").collect()
    assert sorted(a) == sorted(b)


def test_crawl_of_an_empty_link_table(spark):
    seeds = spark.createDataFrame([("a", 0), ("a", 1)], "url string, pos int")
    edges = spark.createDataFrame([], "url string, pos int, link string")
    assert [tuple(r) for r in crawl.breadth_first(seeds, edges).collect()] == [("a", 0, 1)]


def test_streamed_documents_are_merged_once(spark, tmp_path):
    from docloom.streaming import ingest

    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000)))
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = ingest.first_seen(ingest.document_stream(spark, str(tmp_path / "in"), "doc_id bigint, text string, at timestamp"), "at", "1 hour")
    ingest.merged_into(stream, lambda df, _: seen.extend(r["text"] for r in df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_readers_and_writers(spark, tmp_path):
    from docloom.sources import readers, writers

    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("---\ntitle: \"T\"\n---\nbody\n")
    row = readers.markdown_files(spark, str(tmp_path / "md")).select(readers.front_matter(F.col("content")).alias("f")).first()["f"]
    assert row["meta"] == {"title": "T"} and row["body"].strip() == "body"
    vectors = spark.createDataFrame([("n1", 1), ("n2", 2)], "namespace string, id int")
    writers.partitioned_vectors(vectors, str(tmp_path / "v"))
    writers.partitioned_vectors(spark.createDataFrame([("n2", 3)], "namespace string, id int"), str(tmp_path / "v"))
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "v")).collect()) == [1, 3]
    writers.json_rows(spark.createDataFrame([("q", "2024-01-01", "NONE")], "query string, as_of string, expected_failure_state string"), str(tmp_path / "gold"))
    assert readers.gold_set(spark, str(tmp_path / "gold")).first()["query"] == "q"


def test_readers_of_files(spark, tmp_path):
    from docloom.sources import readers, writers

    for name in ("b.pdf", "a.pdf", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[1] for r in readers.binary_files(spark, str(tmp_path), most=9).collect()] == ["a.pdf", "b.pdf"]
    files = spark.createDataFrame([("a.pdf", b"one|two two two two two two two")], "path string, content binary")

    def extract(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame([(p, n, t) for p, c in zip(f["path"], f["content"]) for n, t in enumerate(c.decode().split("|"), 1)], columns=["path", "page", "text"])

    got = readers.pages_of_files(files, extract).orderBy("page").collect()
    assert [(r["page"], r["warning"] is not None) for r in got] == [(1, True), (2, False)]
    (tmp_path / "j").mkdir()
    for name, body in (("a.json", '{"source_id": "s", "text": "t",\n "sections": [{"heading": "h"}]}'), ("summary.json", "{}"), ("bad.json", "{no")):
        (tmp_path / "j" / name).write_text(body)
    assert [(r["source_id"], r["sections"][0]["heading"]) for r in readers.page_json(spark, str(tmp_path / "j")).collect()] == [("s", "h")]
    (tmp_path / "policy.json").write_text('[{"host": "a.b",\n "most": 3}, {"host": "c.d"}]')
    assert sorted(tuple(r) for r in readers.config(spark, str(tmp_path / "policy.json"), "host string, most int").collect()) == [("a.b", 3), ("c.d", None)]
    (tmp_path / "urls.txt").write_text("# list\nhttps://a.b\n\n https://c.d \n")
    assert [r["url"] for r in readers.url_list(spark, str(tmp_path / "urls.txt")).orderBy("pos").collect()] == ["https://a.b", "https://c.d"]
    writers.json_rows(spark.createDataFrame([("s", "t")], "source_id string, text string"), str(tmp_path / "out"))
    assert readers.page_json(spark, str(tmp_path / "out")).first()["text"] == "t"


def walked_batches(sizes, most_records, most_bytes):
    out, batch, n, held = [], -1, most_records, 0
    for size in sizes:
        if n and n + 1 <= most_records and held + size <= most_bytes:
            n, held = n + 1, held + size
        else:
            batch, n, held = batch + 1, 1, size
        out.append(batch)
    return out


@pytest.mark.parametrize("most_records, most_bytes", [(1, 50), (4, 30), (7, 1_000_000), (1000, 25)])
def test_batches_equal_a_walk_over_any_ranges(spark, most_records, most_bytes):
    """A group with most of the rows lies in many ranges, small ones share a range; sizes include none, null and too large ones."""
    rng = np.random.default_rng(most_records)
    groups = [None if g == 3 else "hot" if g > 5 else f"g{g}" for g in rng.integers(0, 40, 3_000)]
    rows = [(g, k, None if s == 13 else int(s) * 10 ** int(s == 28) * int(s != 29)) for k, (g, s) in enumerate(zip(groups, rng.integers(0, 30, 3_000)))]
    made = tables.batches(spark.createDataFrame(rows, "s string, k int, n int").repartition(8), "s", "k", "n", most_records, most_bytes)
    got = {r["k"]: r["batch"] for r in made.collect()}
    for g in set(groups):
        own = [(k, n or 0) for s, k, n in rows if s == g]
        assert [got[k] for k, _ in own] == walked_batches([n for _, n in own], most_records, most_bytes)


def test_scans_agree_with_walks_over_any_stretches():
    """State by state: a stretch's summary does what walking it does, whatever came before."""
    rng = np.random.default_rng(5)
    sizes, wide = scans.Batches(5, 40), scans.Outline("Document")
    kind = pa.list_(pa.struct([("level", pa.int32()), ("heading", pa.string())]))
    for trial in range(60):
        sized, lined = sizes.start(), wide.start()
        for stretch in range(8):
            column = [pa.array(rng.integers(0, 25, int(rng.integers(1, 12))))]
            _, after = sizes.walk(column, sized)
            assert sizes.after(sized, sizes.summary(column)) == after
            sized = after
            heads = [pa.array([[{"level": int(v), "heading": f"{trial}.{stretch}.{k}.{v}"} for v in rng.integers(1, 7, int(rng.integers(0, 3)))] for k in range(int(rng.integers(1, 4)))], kind)]
            _, after = wide.walk(heads, lined)
            assert wide.after(lined, wide.summary(heads)) == after
            lined = after


def test_sections_of_a_long_document_over_many_ranges(spark):
    """Against a plain walk with one stack, pages in any order."""
    rng = np.random.default_rng(9)
    docs = {}
    for doc, n in (("long", 400), (None, 7), ("short", 2), ("blank", 3)):
        for page in range(n):
            parts = [["", "plain words here", f"{'.'.join('1' * int(rng.integers(1, 6)))} Title {page}", "ALL CAPITALS"][int(k)] for k in rng.integers(0, 4, 4)] if doc != "blank" else ["", " "]
            docs[doc, page] = "\n\n".join(parts)
    pages = spark.createDataFrame([(d, p, t) for (d, p), t in docs.items()], "doc string, page int, text string").repartition(6)
    want = set()
    for doc in {d for d, _ in docs}:
        stack, section, held = ["Document"], (0, "Document", ("Document",), 0), []

        def done(doc=doc):
            if held:
                want.add((doc, *section[:4], held[-1][0], "\n\n".join(t for _, t in held)))

        for page in range(sum(d == doc for d, _ in docs)):
            for part in filter(None, map(str.strip, docs[doc, page].split("\n\n"))):
                level = part.split()[0].count(".") + 1 if part[0] == "1" else 1 if part.isupper() else None
                if level:
                    done()
                    stack = [*stack[: level - 1], part]
                    section, held = (section[0] + 1, part, tuple(stack), page), [(page, part)]
                else:
                    held.append((page, part))
        done()
    got = chunking.page_sections(pages, "doc", "page", "text").collect()
    assert {(r["doc"], r["section"], r["heading"], tuple(r["heading_path"]), r["page_start"], r["page_end"], r["text"]) for r in got} == want and len(got) == len(want)


def test_page_spans_and_even_batches_of_a_large_group(spark):
    rows = [("a" if k % 10 else None, k, "x" * (k % 7)) for k in range(900)]
    spans = {(r["doc"], r["page"]): (r["first"], r["last"]) for r in chunking.page_spans(spark.createDataFrame([*rows, ("b", 1, None), ("b", 2, "yy")], "doc string, page int, text string").repartition(5), "doc", "page", "text").collect()}
    for doc in ("a", None):
        at = 0
        for _, k, t in (r for r in rows if r[0] == doc):
            assert spans[doc, k] == (at, at + len(t))
            at += len(t) + 2
    assert spans["b", 1] == (0, 0) and spans["b", 2] == (2, 4)
    even = tables.even_batches(spark.createDataFrame([(d, k, len(t)) for d, k, t in rows], "s string, k int, n int"), "s", "k", "n", 100, 30).collect()
    place = {}
    for r in sorted(even, key=lambda r: r["k"]):
        fits = max(1, min(100, int(30 // max(1.0, np.mean([len(t) for d, _, t in rows if d == r["s"]])))))
        assert r["batch"] == place.setdefault(r["s"], 0) // fits
        place[r["s"]] += 1


def test_faults_of_a_batch_are_kept_apart(spark, tmp_path):
    tried = str(tmp_path / "tried")

    def call(texts):
        with open(tried, "a") as f:
            f.write(texts[0] + "\n")
        if "bad" in texts:
            raise ValueError("bad text")
        if "down" in texts:
            raise remote.Retryable("service is down")
        if "flaky" in texts and open(tried).read().split("\n").count("flaky") < 3:
            raise ConnectionError("try again")
        if "short" in texts:
            return [[1.0]]
        if "gap" in texts:
            return [None if t == "gap" else [1.0] for t in texts]
        return [[float(len(t))] for t in texts]

    plain = [("a", k, f"t{k}") for k in range(10)] + [(None, k, "x" * k) for k in range(3)]
    odd = [(g, 0, g) for g in ("bad", "down", "flaky", "short", "gap")] + [(g, 1, None) for g in ("bad", "down", "flaky", "short", "gap")]
    rows = spark.createDataFrame([*plain, *odd], "g string, k int, t string").repartition(3)
    found = remote.embedded(rows, call, "g", "k", "t", batch_size=4, concurrency=3, retries=2, wait=lambda attempt: 0.0)
    got = {(r["g"], r["k"]): r for r in found.collect()}
    assert len(got) == len(plain) + len(odd)
    assert all(got[g, k]["vector"] == [float(len(t))] and got[g, k]["error"] is None and got[g, k]["batch"] == k // 4 for g, k, t in plain)
    assert got["flaky", 0]["vector"] == [5.0] and got["flaky", 1]["vector"] == [0.0]
    faults = {g: {(got[g, k]["vector"], got[g, k]["error"]) for k in (0, 1)} for g in ("bad", "down", "short", "gap")}
    assert faults == {"bad": {(None, "bad text")}, "down": {(None, "service is down")}, "short": {(None, "1 vectors for 2 texts")}, "gap": {(None, "no vector for text 0")}}
    errors = {r["g"]: (r["stage"], r["start_index"], r["end_index"]) for r in remote.batch_errors(found, "g").collect()}
    assert errors == {g: ("embed", 0, 1) for g in ("bad", "down", "short", "gap")}
    assert remote.embedded(rows.where("false"), call, "g", "k", "t").count() == 0


def test_snippets_by_kind(spark):
    long = "x" * 5000
    sizes = {("search", None): 1200, ("document", None): 1200, ("decision", None): 1600, ("decision", 100): 500, ("decision", 9000): 4000, ("decision", 700): 700, ("error", None): 300, ("injection", None): 220, ("title", None): 80}
    assert {k: len(one(spark, text.snippet(F.lit(long), *k))) for k in sizes} == sizes
    assert one(spark, text.snippet(F.lit(" <p>a</p>\n <b>b</b> "), "search")) == "a b" and one(spark, text.snippet(F.lit(" <p>"), "document")) == "<p>" and one(spark, text.snippet(F.lit(None), "error")) is None
    with pytest.raises(KeyError):
        text.snippet(F.lit("x"), "other")


def test_nearest_chunks_are_those_of_brute_force(spark):
    from pyspark.sql import types as T

    random = np.random.default_rng(5)
    vectors = random.integers(-3, 4, (300, 5)).astype(float)
    vectors[:40] = vectors[0]  # exact copies tie
    vectors[40:80] = 3 * vectors[1]  # and those that differ in length alone, nearly
    vectors[80] *= 0
    vectors[81], vectors[82] = 1e-120 * vectors[2], 1e130 * vectors[2]
    lists = [v.tolist() for v in vectors] + [[1.0, 2.0], [2.0, 1.0], None, [], [1.0, None, 0.0, 0.0, 0.0]]
    rows = [(i, v, "ab"[i % 2]) for i, v in enumerate(lists)]
    chunks = spark.createDataFrame(rows, "id bigint, vector array<double>, kind string")
    queries = chunks.where("id % 3 = 0 OR id > 290").select(F.col("id").alias("query_id"), "vector", F.when(F.col("id") % 2 == 0, "a").otherwise("").alias("wants"))
    tiers = F.array_compact(F.array(F.lit("any"), F.when((F.col("wants") == "") | (F.col("kind") == F.col("wants")), "own")))

    def cosine(a, b):
        dot = lambda x, y: sum((p * q for p, q in zip(x, y)), 0.0)
        sound = a and b and len(a) == len(b) and None not in a and None not in b
        size = (dot(a, a) ** 0.5, dot(b, b) ** 0.5) if sound else (0, 0)
        return dot(a, b) / (size[0] * size[1]) if min(size) > 0 else None

    want = set()
    for q, v, wants in queries.collect():
        scored = sorted((-s, i, kind) for i, c, kind in rows if (s := cosine(v, c)) is not None)
        want |= {(q, i, "any", n, -s) for n, (s, i, _) in enumerate(scored[:7], 1)}
        want |= {(q, i, "own", n, -s) for n, (s, i, _) in enumerate([x for x in scored if wants in ("", x[2])][:3], 1)}
    for blocks in (1, 3):
        got = retrieval._nearest(queries, chunks, tiers, {"own": 3}, 7, ["wants"], ["kind"], blocks)
        assert isinstance(got.schema["score"].dataType, T.DoubleType)
        assert {tuple(r) for r in got.select("query_id", "id", "tier", "position", "score").collect()} == want


def test_tiles_of_vectors_keep_a_bounded_number(monkeypatch):
    vectors = np.ones((2000, 8))
    asked = retrieval._Asked(np.arange(50), [""] * 50, vectors[:50], np.full(50, 8**0.5))
    computed, exact = [], retrieval._cosines
    monkeypatch.setattr(retrieval, "_cosines", lambda a, b, n: computed.append(len(a)) or exact(a, b, n))
    for at in range(0, 2000, 500):
        asked.meet(np.arange(at, at + 500), [""] * 500, vectors[at : at + 500], np.full(500, 8**0.5), {"": {"": {""}}}, {}, 4)
    (tier, q, c, _), = asked.found()
    assert c.tolist() == [0, 1, 2, 3] * 50 and max(computed) <= retrieval.PAIRS


def test_one_page_at_a_time_is_a_tree(monkeypatch):
    alive, most = set(), []

    class Counted(html.Page):
        def __init__(self, text):
            alive.add(id(self))
            most.append(len(alive))
            super().__init__(text)

        def __del__(self):
            alive.discard(id(self))

    monkeypatch.setattr(html, "Page", Counted)
    pages = [f"<title>T{i}</title><p>text {i}</p>" for i in range(450)] + [None]
    batch = pa.RecordBatch.from_pydict({"key": list(range(451)), "url": [""] * 451, "html": pages})
    got = list(html._read(iter([batch]), ("title", "markdown")))
    assert max(most) <= 2 and max(len(b) for b in got) <= html.PAGES_OUT
    titles = [t for b in got for t in b.column("title").to_pylist()]
    assert titles == [f"T{i}" for i in range(450)] + ["Untitled PDI"] and sum(map(len, got)) == 451


def test_few_texts_at_a_time_are_chunks():
    alive, most = [0], [0]

    class Chunks(list):
        def __init__(self, of):
            super().__init__(of)
            alive[0] += 1
            most[0] = max(most[0], alive[0])

        def __del__(self):
            alive[0] -= 1

    texts = pa.array([f"a {i}" for i in range(501)] + [None])
    got = chunking._of_each(texts, lambda t: Chunks([t]) if t else Chunks([]), pa.list_(pa.string()))
    assert got.to_pylist() == [[f"a {i}"] for i in range(501)] + [[]] and most[0] <= 2 * chunking.TEXTS
    assert chunking._of_each(texts.slice(0, 0), Chunks, pa.list_(pa.string())).to_pylist() == []


def test_sums_of_a_scan_hold_no_rows(spark):
    class Small(scans.Sums):
        def summary(self, columns):
            buffer = columns[0].buffers()[1]
            while buffer.parent is not None:
                buffer = buffer.parent
            assert buffer.size < 1 << 20
            return super().summary(columns)

    rows = spark.range(0, 40, 1, 1).select("id", F.lit(1).alias("g"), F.repeat(F.lit("x"), 100_000).alias("text"))
    got = scans.scanned(rows, ["g"], ["id"], Small("n"), F.lit(1)).select("id", "n").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(40)]


def test_white_space_of_all_kinds_is_stripped(spark):
    points = [chr(i) for i in (*range(1, 0x300), *range(0x1680, 0x1681), *range(0x180E, 0x180F), *range(0x2000, 0x2070), 0x3000, 0xFEFF)]
    rows = spark.createDataFrame([(c,) for c in points], "c string").select(F.concat("c", "c", F.lit("a"), "c", F.lit("b"), "c").alias("t"))
    assert rows.where(text.strip(F.col("t")) != F.regexp_replace("t", r"(?U)^\s+|\s+$", "")).count() == 0


def test_plain_lines_take_one_expression(spark):
    lines = ["plain words here", "Smith went home", "1.2 Scope", ":-3) Deep", " :- 3) Deep", "TABLE OF RULES", "\tTAB  LED", "A  B C", "AB C", "", "4.5.6) Deep heading", "--OVERVIEW--", "-- OVERVIEW --", "- bullet", "PAGE DETAILS", "12", "1 x;", "Éa 1"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r["line"]: r["level"] for r in rows.select("line", chunking.heading_level(F.col("line")).alias("level")).collect()}
    assert {k: v for k, v in got.items() if v} == {"1.2 Scope": 2, ":-3) Deep": 1, "TABLE OF RULES": 1, "A  B C": 1, "4.5.6) Deep heading": 3, "--OVERVIEW--": 1}
    assert str(chunking.heading_level(F.col("line"))).lower().count("regexp_replace") == 2


def test_leaders_and_dates_of_a_page_are_cleaned(spark):
    page = " 2024-01-01 \n....\nRules ..... 12\nFees   7\n.... 5\nv1\n2024-01-0199\na...b\n12.5....\n\n\n\nhyphen-\nated  x\n"
    assert one(spark, chunking.cleaned_page(F.lit(page))) == "Rules\nFees\n5\nv1\n2024-01-0199\na b\n12.5\n\nhyphenated x"


def test_a_scan_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = spark.range(0, 60, 1, 3).withColumn("g", F.lit(1)).mapInArrow(counted, "id bigint, g int")
    got = scans.scanned(rows, ["g"], ["id"], scans.Sums("n"), F.lit(1)).select("id", "n").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(60)] and made.value == 60


def test_strings_of_three_letters_are_numbers():
    number = lambda s: sum("0123456789abcdefghijklmnopqrstuvwxyz".index(x) * 36**k for k, x in enumerate(reversed(s)))
    assert retrieval.grams("ab1 abcébcd abc".encode()).tolist() == sorted(map(number, ("ab1", "abc", "bcd")))
    assert [len(retrieval.grams(t)) for t in (b"", b"a", b"ab", b"abc", b"a-c")] == [0, 0, 0, 1, 0]


def test_sections_of_page_records(spark):
    """A section for each heading with a body in order, and the whole text of a page that has none."""
    rows = [("a", "before\n# A\none\n## B\n\n### C\ntwo"), ("b", "# Only\n## headings"), ("c", " \n"), ("d", None), ("d", "# D\nlast")]
    pages = spark.createDataFrame(rows, "url string, text string").selectExpr("concat('https://www.canada.ca/', url) AS url", "'T' AS title", "text", "'2024-01-01' AS crawled_at", "url AS path")
    got = records.with_sections(records.page_records(pages))
    assert got.schema["sections"].dataType.simpleString() == records.SECTIONS
    assert [[(s["heading"], s["heading_path"], s["anchor"], s["text"]) for s in r["sections"]] for r in got.orderBy("markdown_path", "text").collect()] == [
        [("Document", ["Document"], "#document", "before"), ("A", ["A"], "#a", "one"), ("C", ["A", "B", "C"], "#c", "two")],
        [("Document", ["Document"], "#document", "# Only\n## headings")], [("Document", ["Document"], "#document", "")], [("Document", ["Document"], "#document", "")], [("D", ["D"], "#d", "last")],
    ]
