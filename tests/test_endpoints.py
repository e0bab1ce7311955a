"""Addresses, GraphQL selections and cursors."""

from pyspark.sql.types import StructType

from quarrylight.schemas import MERGED_PRS
from quarrylight.sources import endpoints as E


def test_addresses():
    assert E.github("https://api.x.example", "org_repos", "o") == "https://api.x.example/orgs/o/repos?type=all"
    assert E.gitlab("https://h/api/v4", "members", "g/p") == "https://h/api/v4/projects/g%2Fp/members/all"
    assert "archived" not in E.gitlab("b", "accessible") and "archived=false" in E.gitlab("b", "accessible", archived="none")


def test_first_filled():
    def fetch(a):
        if a == "missing":
            raise RuntimeError("HTTP 404 for missing")
        return [] if a == "empty" else [a]

    assert E.first_filled(fetch, "missing", "empty", "full") == ["full"] and E.first_filled(fetch, "empty") == []


def test_selection(spark):
    text = E.merged_query(StructType.fromDDL(MERGED_PRS))
    assert "labels(first: 20) { nodes { name } }" in text and "author { login __typename }" in text
    assert "reviewThreads(first: 30)" in text and "comments(first: 20)" in text and "comments(first: 25)" in text and text.count("{") == text.count("}")


def test_cursor():
    served = {None: {"nodes": [1, 2], "pageInfo": {"hasNextPage": True, "endCursor": "c"}}, "c": {"nodes": [3], "pageInfo": {"hasNextPage": False}}}
    assert list(E.cursor_pages(served.__getitem__)) == [1, 2, 3]
