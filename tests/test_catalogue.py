"""Every registered query of the operators against its SQL, or, without SQL, its rows' bounds."""

import pandas as pd
import pytest

from docloom.plans import documents, matches, records, retrieval, scalars, tables, text
from tests.compare import assert_same, database

QUERIES = {k: v for m in (retrieval, text, matches, scalars, tables, documents, records) for k, v in m.QUERIES.items()}
SQL = {k: v for m in (retrieval, text, matches, scalars, tables, documents, records) for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data).toPandas(), database(data).sql(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).limit(1).count() == 1


def test_no_branch_of_the_rules_is_idle(spark, data):
    from docloom.functions import rules

    got = text.chunk_metadata(spark, data).toPandas()
    assert set(got.doc_family) == {v for v, _ in rules.DOC_FAMILY} | {rules.DOC_FAMILY_DEFAULT}
    assert set(got.instrument) == {v for v, _ in rules.INSTRUMENT}
    assert set(got.program_stream) == {v for v, _ in rules.PROGRAM_STREAM} | {""}
    states = set(tables.failure_state(spark, data).toPandas().state)
    assert len(states) >= 7


@pytest.fixture(scope="module")
def cut_pages(data, tmp_path_factory):
    """The first pages, with titles and headings that are cut within the reference of a quote."""
    folder = tmp_path_factory.mktemp("cut")
    database(data).sql(r"SELECT page_id, url, regexp_replace(html, '</(h1|title)>', ' token = &quot</\1>', 'g') AS html FROM pages WHERE page_id < 6").df().to_parquet(folder / "pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["content_parts", "heading_counts", "html_sections"])
def test_references_cut_short_are_text(spark, cut_pages, name):
    assert_same(QUERIES[name](spark, cut_pages).toPandas(), database(cut_pages).sql(SQL[name]).df())


def test_page_records_keep_their_own_sections(spark, tmp_path):
    """Two pages whose short ids agree, one that is listed twice, and one without text."""
    docs = pd.DataFrame({"doc_id": [13467383, 30353422, 7, 7, 8], "text": ["one text", "another", "twice", "twice", ""]})
    docs.to_parquet(tmp_path / "documents.parquet")
    got = QUERIES["page_records"](spark, str(tmp_path)).toPandas()
    assert sorted(got.source_id.value_counts()) == [1, 2, 2]
    assert_same(got, database(str(tmp_path)).sql(SQL["page_records"]).df())
