"""Addresses and queries of hosted services, for the hosted data source."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import quote

from pyspark.sql.types import ArrayType, DataType, StructType

#: Entries of a merged change's lists that one page holds; fixed values.
LIMITS = {"labels": 20, "files": 60, "closingIssuesReferences": 10, "comments": 25, "reviews": 25, "reviewThreads": 30}
INNER_LIMITS = {"comments": 20}
PAGE = 25


def github(base: str, what: str, name: str = "", affiliation: str = "owner,collaborator,organization_member") -> str:
    """The address of a list or document at a GitHub REST base: an organisation's or a user's repositories, those that
    a token reaches, one repository, its languages or contributors (anonymous ones too), organisations, installations."""
    paths = {
        "org_repos": f"orgs/{name}/repos?type=all",
        "user_repos": f"users/{name}/repos?type=all",
        "accessible": f"user/repos?affiliation={quote(affiliation)}",
        "repo": f"repos/{name}",
        "languages": f"repos/{name}/languages",
        "contributors": f"repos/{name}/contributors?anon=true",
        "user": "user",
        "orgs": "user/orgs",
        "installations": "app/installations",
    }
    return f"{base}/{paths[what]}"


def gitlab(base: str, what: str, name: str = "", item: int | None = None, archived: str = "all") -> str:
    """The address of a list or document at a GitLab API base. `archived`: all projects, only archived ones, or none."""
    key = quote(name, safe="")
    flag = {"all": "", "only": "&archived=true", "none": "&archived=false"}[archived]
    paths = {
        "group_projects": f"groups/{key}/projects?include_subgroups=true{flag}",
        "accessible": f"projects?membership=true&order_by=path&sort=asc{flag}",
        "project": f"projects/{key}",
        "languages": f"projects/{key}/languages",
        "members": f"projects/{key}/members/all",
        "merged": f"projects/{key}/merge_requests?state=merged",
        "request": f"projects/{key}/merge_requests/{item}",
        "notes": f"projects/{key}/merge_requests/{item}/notes",
        "changes": f"projects/{key}/merge_requests/{item}/changes",
        "groups": "groups?min_access_level=10",
    }
    return f"{base}/{paths[what]}"


#: The query that tells how many changes a repository has merged.
COUNT_QUERY = "query($owner: String!, $name: String!) { repository(owner: $owner, name: $name) { pullRequests(states: MERGED) { totalCount } } }"


def connection(body: object, repo: str) -> dict:
    """The list of changes in a GraphQL answer; its errors, or a repository that isn't there, are an error."""
    if not isinstance(body, dict) or body.get("errors"):
        raise RuntimeError(str(body.get("errors") if isinstance(body, dict) else body)[:500])
    found = (body.get("data") or {}).get("repository")
    if not found:
        raise RuntimeError(f"Repository not found: {repo}")
    return found["pullRequests"]


def first_filled(fetch: Callable[[str], list], *addresses: str) -> list:
    """The first list that is neither missing (HTTP 404) nor empty."""
    for address in addresses:
        try:
            if got := fetch(address):
                return got
        except RuntimeError as e:
            if "HTTP 404" not in str(e):
                raise
    return []


def selection(kind: DataType, limits: dict[str, int] = LIMITS) -> str:
    """The GraphQL selection that fills a schema: every list of nodes with its limit."""
    if isinstance(kind, ArrayType):
        return selection(kind.elementType, limits)
    if not isinstance(kind, StructType):
        return ""
    parts = []
    for f in kind.fields:
        paged = isinstance(f.dataType, StructType) and "nodes" in f.dataType.names
        inner = selection(f.dataType, INNER_LIMITS if paged else limits)
        parts.append(f.name + (f"(first: {limits[f.name]})" if paged else "") + (f" {{ {inner} }}" if inner else ""))
    return " ".join(parts)


def merged_query(schema: StructType) -> str:
    """The query of one page of merged pull requests, last updated first."""
    return (
        "query($owner: String!, $name: String!, $cursor: String) { repository(owner: $owner, name: $name) { "
        f"pullRequests(states: MERGED, first: {PAGE}, after: $cursor, orderBy: {{field: UPDATED_AT, direction: DESC}}) "
        f"{{ totalCount pageInfo {{ hasNextPage endCursor }} nodes {{ {selection(schema)} }} }} }} }}"
    )


def cursor_pages(ask: Callable[[str | None], dict]) -> Iterator[dict]:
    """All nodes of a list that is paged by cursor; `ask` gets the cursor and returns the list's page."""
    cursor = None
    while True:
        page = ask(cursor)
        yield from page.get("nodes") or []
        info = page.get("pageInfo") or {}
        if not info.get("hasNextPage"):
            return
        cursor = info.get("endCursor")
