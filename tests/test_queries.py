"""Registered queries against their SQL. LODESTONE_ALL_QUERIES=1 runs every one."""

import os

import pytest

import __spark_entry__ as entry
from workload import check
from workload.catalog import ORACLE, QUERIES

SF_DIR = "/root/testdata/sf0.001"
SOME = (
    "files", "postings", "search_and_terms", "search_indexed", "default_rank_page", "relevance_buckets", "scope_targets",
    "regex_search", "folder_search", "snippets_literal", "snapshot_diff", "scoped_delete", "folder_rollup", "delete_targets",
    "click_stream", "page_extract", "page_scope", "crawl_frontier", "record_search", "json_records", "import_metrics", "front_matter",
)
NAMES = tuple(QUERIES) if os.environ.get("LODESTONE_ALL_QUERIES") else SOME

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, note = check.compare(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
