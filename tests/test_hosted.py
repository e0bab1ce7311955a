"""Hosted services over pages that a server of our own serves."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

import pytest
from pyspark.sql import functions as F

from quarrylight.sources import credentials, hosted, platforms


class Service:
    """Answers by path: a list is paged, anything else is sent as it is; `asked` holds what came in."""

    def __init__(self, style):
        self.style, self.answers, self.asked, self.graph, self.total = style, {}, [], {}, None
        owner = self

        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *args):
                pass

            def answer(self, code, body, **headers):
                self.send_response(code)
                for k, v in headers.items():
                    self.send_header(k.replace("_", "-"), v)
                self.end_headers()
                self.wfile.write(json.dumps(body).encode())

            def do_GET(self):
                url = urlsplit(self.path)
                query = {k: v[0] for k, v in parse_qs(url.query).items()}
                owner.asked.append((unquote(url.path), query, dict(self.headers)))
                if unquote(url.path) not in owner.answers:
                    return self.answer(404, {"message": "none"})
                body = owner.answers[unquote(url.path)]
                if not isinstance(body, list):
                    return self.answer(200, body)
                size, page = int(query.get("per_page", 100)), int(query.get("page", 1))
                part, more = body[(page - 1) * size : page * size], len(body) > page * size
                told = {"X_Total": str(owner.total)} if owner.total is not None else {}
                if owner.style == "link":
                    return self.answer(200, part, **told, **({"Link": '<next>; rel="next"'} if more else {}))
                return self.answer(200, part, **told, X_Next_Page=str(page + 1) if more else "")

            def do_POST(self):
                asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
                owner.asked.append(("graphql", asked["variables"], dict(self.headers)))
                self.answer(200, owner.graph_answer(asked))

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.base = f"http://127.0.0.1:{self.server.server_port}"

    def graph_answer(self, asked):
        v = asked["variables"]
        nodes = self.graph.get(f"{v['owner']}/{v['name']}")
        if nodes is None:
            return {"data": {"repository": None}}
        if "totalCount }" in asked["query"] and "nodes" not in asked["query"]:
            return {"data": {"repository": {"pullRequests": {"totalCount": len(nodes)}}}}
        at = int(v.get("cursor") or 0)
        return {"data": {"repository": {"pullRequests": {"nodes": nodes[at : at + 2], "pageInfo": {"hasNextPage": at + 2 < len(nodes), "endCursor": str(at + 2)}}}}}

    def pages(self, path):
        return sum(a[0] == path for a in self.asked)


@pytest.fixture
def github():
    s = Service("link")
    yield s
    s.server.shutdown()


@pytest.fixture
def gitlab():
    s = Service("number")
    yield s
    s.server.shutdown()


def test_repositories_of_organisations_and_users(spark, github):
    repo = lambda n, **more: {"full_name": n, "name": n.split("/")[1], "created_at": "2020-01-01T00:00:00Z", "size": 5, "language": "Go", "default_branch": "main"} | more
    github.answers = {"/orgs/o/repos": [repo(f"o/{k}", archived=k == 1) for k in range(5)] + ["junk", {"name": "nameless"}], "/orgs/u/repos": [], "/users/u/repos": [repo("u/x", language=None, size=None)]}
    rows = platforms.repositories(spark, "github", github.base, ["o", "u", "gone"], page_size=2)
    got = [(r.org, r.full_name, r.size_kb, r.primary_language, r.archived) for r in rows.collect()]
    assert got == [*(("o", f"o/{k}", 5, "Go", k == 1) for k in range(5)), ("u", "u/x", 0, "", False)]
    assert [r.full_name for r in platforms.repositories(spark, "github", github.base, ["o"], archived="only").collect()] == ["o/1"]
    assert [tuple(r) for r in platforms.choices(rows.where("archived")).collect()] == [("o/1", "o/1", True)]
    github.answers["/user/repos"] = [repo("a/b"), repo("c/d")]
    assert [r.org for r in platforms.accessible(spark, "github", github.base).collect()] == ["a", "c"]
    assert [a[1]["affiliation"] for a in github.asked if a[0] == "/user/repos"][:1] == ["owner,collaborator,organization_member"]
    github.answers["/repos/o/0"] = repo("o/0")
    assert [r.full_name for r in platforms.repository(spark, "github", github.base, ["o/0", "o/none"]).collect()] == ["o/0"]


def test_projects_of_groups(spark, gitlab):
    project = lambda k, **more: {"id": k, "path_with_namespace": f"g/s/{k}", "created_at": "2020", "statistics": {"repository_size": 2048 * k}} | more
    gitlab.answers = {"/groups/g/s/projects": [project(1), project(2, archived=True), {"id": 3}]}
    rows = platforms.repositories(spark, "gitlab", gitlab.base, ["g/s"], page_size=2).collect()
    assert [(r.org, r.full_name, r.size_kb, r.archived) for r in rows] == [("g/s", "g/s/1", 2, False), ("g/s", "g/s/2", 4, True)]
    gitlab.answers["/projects"] = [project(7)]
    assert [(r.org, r.full_name) for r in platforms.accessible(spark, "gitlab", gitlab.base).collect()] == [("g", "g/s/7")]
    assert {k: v for k, v in gitlab.asked[-1][1].items() if k in ("order_by", "sort", "membership")} == {"order_by": "path", "sort": "asc", "membership": "true"}
    gitlab.answers["/projects/g/s/1"] = project(1, statistics=None)
    assert [(r.full_name, r.size_kb) for r in platforms.repository(spark, "gitlab", gitlab.base, ["g/s/1"]).collect()] == [("g/s/1", None)]


def test_what_a_token_sees(spark, github, gitlab):
    github.answers = {"/user": {"login": "me"}, "/orgs": [], "/user/orgs": [{"login": "Zed"}, {"login": "abc"}, {}], "/app/installations": [{"id": 9, "account": {"login": "Org", "type": "Organization"}}]}
    assert [r.id for r in platforms.organisations(spark, "github", github.base).collect()] == ["me", "Zed", "abc"]
    found = platforms.installations(spark, github.base)
    assert platforms.installation_label(found, 9).first().label == "Org" and platforms.installation_label(found, 1).first().label == "unknown"
    gitlab.answers = {"/groups": [{"full_path": "b", "name": "beta"}, {"full_path": "z", "name": "Alpha"}]}
    assert [tuple(r) for r in platforms.organisations(spark, "gitlab", gitlab.base).collect()] == [("z", "Alpha"), ("b", "beta")]


def test_languages_and_people(spark, github, gitlab):
    github.answers = {"/repos/o/r/languages": {"Go": 3, "C": 1, "Z": None}, "/repos/o/r/contributors": [{"login": "ann", "type": "User"}, {"name": "anon", "type": "Anonymous"}, {"login": "ci", "type": "Bot"}]}
    got = platforms.languages(spark, "github", github.base, ["o/r", "o/none"]).collect()
    assert [tuple(r) for r in got] == [("o/r", 0, "Go", 3.0), ("o/r", 1, "C", 1.0), ("o/r", 2, "Z", None)]
    people = platforms.is_bot(platforms.contributors(spark, "github", github.base, ["o/r"])).orderBy("seq").collect()
    assert [(r.login, r.is_bot) for r in people] == [("ann", False), ("anon", False), ("ci", True)]
    gitlab.answers = {"/projects/g/p/members/all": [{"id": 1, "username": "bob"}, {"id": 2}]}
    assert [r.login for r in platforms.contributors(spark, "gitlab", gitlab.base, ["g/p"]).collect()] == ["bob"]


def changes(n):
    """Merged changes, last updated first: one a day, each merged a day before its update."""
    return [{"number": n - k, "updatedAt": f"2024-01-{n - k + 1:02}T00:00:00Z", "mergedAt": f"2024-01-{n - k:02}T00:00:00Z", "author": {"login": "x", "__typename": "Bot" if k == 0 else "User"}} for k in range(n)]


def test_a_bound_on_the_time_ends_the_paging(spark, github):
    github.graph = {"o/r": changes(20)}
    rows = platforms.merged_prs(spark, github.base, ["o/r", "o/none"], since="2024-01-17T00:00:00Z")
    assert sorted(r.number for r in rows.collect()) == [17, 18, 19, 20]
    assert github.pages("graphql") == 3 + 1  # of ten pages, and one for the repository that isn't there
    github.asked.clear()
    got = platforms.merged_prs(spark, github.base, ["o/r"], until="2024-01-03T00:00:00Z").collect()
    assert sorted(r.number for r in got) == [1, 2, 3] and github.pages("graphql") == 10
    assert [r.author_is_bot for r in platforms.merged_prs(spark, github.base, ["o/r"]).where("number = 20").collect()] == [True]
    bad = hosted.load(spark, hosted.MergedChanges, ["o/none"], endpoint=github.base).collect()
    assert [(r.repo, r.number, r.error) for r in bad] == [("o/none", None, "Repository not found: o/none")]


def test_counts_without_rows(spark, github, gitlab):
    github.graph = {"o/r": changes(9), "o/q": []}
    counts = platforms.merged_counts(spark, "github", github.base, ["o/r", "o/q", "o/none"]).collect()
    assert sorted((r.repo, r.merged, r.error) for r in counts) == [("o/none", None, "Repository not found: o/none"), ("o/q", 0, None), ("o/r", 9, None)]
    assert github.pages("graphql") == 3
    ranged = platforms.merged_counts(spark, "github", github.base, ["o/r", "o/q"], since="2024-01-08T00:00:00Z")
    assert sorted((r.repo, r.merged) for r in ranged.collect()) == [("o/q", 0), ("o/r", 2)]
    gitlab.answers, gitlab.total = {"/projects/g/p/merge_requests": [{"iid": k} for k in range(5)]}, 777
    got = platforms.merged_counts(spark, "gitlab", gitlab.base, ["g/p"], since="2024-01-01T00:00:00Z").collect()
    assert [(r.repo, r.merged, r.told) for r in got] == [("g/p", 777, True)] and len(gitlab.asked) == 1
    assert gitlab.asked[0][1]["updated_after"] == "2024-01-01T00:00:00Z" and gitlab.asked[0][1]["state"] == "merged"
    gitlab.total = None
    assert [(r.merged, r.told) for r in platforms.merged_counts(spark, "gitlab", gitlab.base, ["g/p"], page_size=2).collect()] == [(5, False)]


def test_requests_with_their_parts(spark, gitlab):
    at = "/projects/g/p!x/merge_requests"
    gitlab.answers = {
        at: [{"iid": 1, "title": "one", "author": {"username": "ann"}}, {"iid": 2, "title": "two", "author": {"username": "dependabot"}}, {"title": "no iid"}],
        f"{at}/1": {"iid": 1, "title": "one in detail", "author": {"username": "ann"}},
        f"{at}/1/notes": [{"body": f"n{k}"} for k in range(3)],
        f"{at}/1/changes": {"changes": [{"new_path": "a"}, {"new_path": "b"}]},
    }
    got = {r.iid: r for r in platforms.merged_requests(spark, gitlab.base, ["g/p!x"], at_once=2, page_size=2).collect()}
    assert (got[1].title, got[1].repo, got[1].author_is_bot) == ("one in detail", "g/p!x", False)
    assert [json.loads(n)["body"] for n in got[1].notes] == ["n0", "n1", "n2"] and len(got[1].changes) == 2
    assert (got[2].title, got[2].notes, got[2].changes, got[2].author_is_bot) == ("two", [], [], True)


def test_hosted_facts_reach_the_summary(spark, github):
    from quarrylight.plans import summary

    github.answers = {"/orgs/o/repos": [{"full_name": "o/r", "created_at": "2019-01-01T00:00:00Z", "language": "Go", "size": 12, "default_branch": "dev"}], "/repos/o/r/languages": {"Go": 3, "C": 1}, "/repos/o/r/contributors": [{"login": "a"}, {"login": "b"}]}
    github.graph = {"o/r": changes(4)}
    repos = platforms.repositories(spark, "github", github.base, ["o"])
    facts = platforms.facts(repos, platforms.contributors(spark, "github", github.base, ["o/r"]), platforms.merged_counts(spark, "github", github.base, ["o/r"]))
    empty = lambda ddl: spark.createDataFrame([], ddl)
    commits = empty("repo string, log_pos long, sha string, author_name string, author_email string, author_date string, subject string, body string")
    rows = summary.summary(repos, commits, empty("repo string, path string, bytes long, lines long, sample string"), platforms.languages(spark, "github", github.base, ["o/r"]), empty("repo string, language string, code long"), F.current_timestamp(), hosted=facts)
    r = rows.first()
    assert (r.repo_created_at[:4], r.primary_language, r.size_kb, r.default_branch, r.contributor_count, r.merged_prs, r.languages_breakdown) == ("2019", "Go", 12, "dev", 2, 4, "Go:75.0%; C:25.0%")


def test_from_a_service_to_the_files_of_a_run(spark, github, gitlab, tmp_path):
    import csv
    import os

    from quarrylight.plans import profile

    repo = lambda n: {"full_name": n, "created_at": "2019-01-01T00:00:00Z", "language": "Go", "size": 12, "default_branch": "dev"}
    github.answers = {"/orgs/o/repos": [repo("o/r"), repo("o/q"), repo("o/bad")]}
    for n in ("o/r", "o/q"):
        github.answers |= {f"/repos/{n}/languages": {"Go": 3, "C": 1}, f"/repos/{n}/contributors": [{"login": "a"}, {"login": "b"}]}
    github.graph = {"o/r": changes(4), "o/q": [], "o/bad": []}
    out = str(tmp_path / "out")
    rows = {r.repo: r for r in profile.profile_hosted(spark, "github", github.base, ["o"], out, F.current_timestamp(), graphql=github.base).collect()}
    assert (rows["o/r"].merged_prs, rows["o/r"].contributor_count, rows["o/r"].languages_breakdown, rows["o/r"].error) == (4, 2, "Go:75.0%; C:25.0%", None)
    assert (rows["o/q"].merged_prs, rows["o/q"].default_branch) == (0, "dev")
    assert "HTTP 404" in rows["o/bad"].error and rows["o/bad"].languages_breakdown is None
    text = "".join(open(f"{out}/summary.csv/{f}", newline="").read() for f in os.listdir(f"{out}/summary.csv") if f.startswith("part-"))
    assert [r["repo"] for r in csv.DictReader(text.splitlines())] == ["o/bad", "o/q", "o/r"]
    gitlab.answers = {
        "/groups/g/projects": [{"id": 1, "path_with_namespace": "g/p x", "created_at": "2020", "default_branch": "main", "statistics": {"repository_size": 4096}}],
        "/projects/g/p x/languages": {"C": 100}, "/projects/g/p x/members/all": [{"id": 1, "username": "ann"}], "/projects/g/p x/merge_requests": [{"iid": 1}],
    }
    got = profile.profile_hosted(spark, "gitlab", gitlab.base, ["g"], str(tmp_path / "lab"), F.current_timestamp()).first()
    assert (got.repo, got.size_kb, got.contributor_count, got.merged_prs, got.languages_breakdown, got.error) == ("g/p x", 4, 1, 1, "C:100.0%", None)


def test_a_token_is_renewed_before_it_ends():
    now, minted = [0.0], []

    def mint():
        minted.append(now[0])
        return f"t{len(minted)}", "1970-01-01T01:00:00Z" if len(minted) == 1 else None

    s = credentials.TokenSupplier(mint, clock=lambda: now[0])
    got = []
    for t in (0, 1000, 3479, 3480, 3600, 6959, 6960):
        now[0] = t
        got.append(s.get())
    assert got == ["t1", "t1", "t1", "t2", "t2", "t2", "t3"] and minted == [0, 3480, 6960]
    assert credentials.end_of("no time", 5.0) == 3605.0


def some_token():
    return "secret-of-the-test", None


def test_tokens_reach_the_service_and_no_plan(spark, github, gitlab, monkeypatch):
    github.answers, gitlab.answers = {"/user": {"login": "me"}}, {"/groups": []}
    monkeypatch.setitem(credentials._suppliers, "m:f", credentials.TokenSupplier(some_token))
    assert credentials.headers({"token_supplier": "m:f"})["Authorization"] == "Bearer secret-of-the-test"
    monkeypatch.setenv("A_TOKEN", "from-the-environment")
    assert credentials.headers({"token_env": "A_TOKEN", "auth": "private"})["PRIVATE-TOKEN"] == "from-the-environment"
    rows = platforms.lists(spark, "github", [("0", [f"{github.base}/user"])], style="document", token_supplier="posixpath:basename")
    assert "secret" not in rows._jdf.queryExecution().toString()
    assert "Authorization" not in credentials.headers({})


def test_limits_are_waited_out(spark, github):
    tries = []

    def busy(url, headers):
        tries.append(url)
        if len(tries) < 2:
            raise RuntimeError("HTTP 429 for x")
        return [1], {}

    assert list(hosted.pages("u", "link", dict, 2, busy, wait=0)) == [1]
    assert list(hosted.pages("u", "link", {}, 2, lambda u, h: ({"message": "no list"}, {}))) == []
    assert list(hosted.pages("u", "number", {}, 2, lambda u, h: ({"a": 1}, {}))) == [{"a": 1}]
