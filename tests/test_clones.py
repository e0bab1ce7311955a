"""Clones made here: the commit graph, errors as rows, and a run from clones to its files."""

import csv
import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import scalars as S
from quarrylight.operators import history, trees
from quarrylight.plans import classify, profile
from quarrylight.sources import local

AS_OF = lambda: F.to_timestamp(F.lit("2024-03-01T00:00:00Z"))


def make(path, commits=(), *form):
    """A clone with commits (date, message)."""
    path.mkdir(parents=True)
    git = lambda *a, **env: subprocess.run(["git", "-C", str(path), "-c", "user.name=Ann", "-c", "user.email=a@x.example", *a], check=True, capture_output=True, env=os.environ | env)
    git("init", "-q", "-b", "main", *form)
    for date, message in commits:
        git("commit", "-q", "--allow-empty", "-m", message, GIT_AUTHOR_DATE=date, GIT_COMMITTER_DATE=date)
    return git


DATES = [("2021-05-05T00:00:00+00:00", "one"), ("2022-01-01T00:00:00+00:00", "two"), ("2020-01-02T00:00:00+00:00", "three")]


def test_first_and_last_commit_are_root_and_head(spark, tmp_path):
    make(tmp_path / "o" / "r", DATES)
    make(tmp_path / "o" / "long", DATES[:2], "--object-format=sha256")
    commits = history.commits_of_lines(local.commit_lines(spark, str(tmp_path)))
    got = {r.repo: r for r in history.git_stats(commits, AS_OF()).collect()}
    assert (got["o/r"].first_commit[:10], got["o/r"].last_commit[:10], got["o/r"].span_days) == ("2021-05-05", "2020-01-02", -489)
    assert (got["o/long"].total_commits, got["o/long"].first_commit[:10]) == (2, "2021-05-05")
    assert {len(r.sha) for r in commits.where("repo = 'o/long'").collect()} == {64}
    facts = {r.repo: (r.commits, r.roots, r.merges, r.tips) for r in history.graph_facts(commits).collect()}
    assert facts == {"o/r": (3, 1, 0, 1), "o/long": (2, 1, 0, 1)}


def test_two_roots_and_a_merge(spark, tmp_path):
    git = make(tmp_path / "r", DATES[:1])
    git("checkout", "-q", "--orphan", "other")
    git("commit", "-q", "--allow-empty", "-m", "late root", GIT_AUTHOR_DATE="2023-01-01T00:00:00+00:00", GIT_COMMITTER_DATE="2023-01-01T00:00:00+00:00")
    git("checkout", "-q", "main")
    git("merge", "-q", "--allow-unrelated-histories", "other", "-m", "both", GIT_AUTHOR_DATE="2023-02-01T00:00:00+00:00", GIT_COMMITTER_DATE="2023-02-01T00:00:00+00:00")
    commits = history.commits_of_lines(local.commit_lines(spark, str(tmp_path)))
    named = git("rev-list", "--max-parents=0", "HEAD").stdout.split()[0].decode()
    assert history.roots(commits).orderBy("log_pos").first().sha == named
    assert history.git_stats(commits, AS_OF()).first().first_commit[:4] == "2023"
    assert [tuple(r)[1:] for r in history.graph_facts(commits).collect()] == [(3, 2, 1, 1)]
    assert history.parent_edges(commits).count() == 2


@pytest.fixture
def clones(tmp_path):
    """Three clones: one whole, one without commits, one whose log never ends, one whose objects are gone."""
    root = tmp_path / "clones"
    git = make(root / "o" / "fine", DATES + [("2024-02-01T00:00:00+00:00", "Add it (#7)")])
    (root / "o" / "fine" / "readme.md").write_text("hello")
    (root / "o" / "fine" / "tests").mkdir()
    (root / "o" / "fine" / "tests" / "test_a.py").write_text("a\nb\n")
    git("add", ".")
    git("commit", "-qm", "files")
    make(root / "o" / "empty")
    make(root / "o" / "slow", DATES)
    git = make(root / "o" / "broken", DATES)
    for folder, _, names in os.walk(root / "o" / "broken" / ".git" / "objects"):
        for name in names:
            os.chmod(os.path.join(folder, name), 0o600)
            with open(os.path.join(folder, name), "wb") as file:
                file.write(b"junk")
    real = subprocess.run(["which", "git"], capture_output=True, text=True).stdout.strip()
    folder = tmp_path / "bin"
    folder.mkdir()
    (folder / "git").write_text(f'#!/bin/sh\ncase "$*" in *slow*\\ log*) exec sleep 60;; esac\nexec {real} "$@"\n')
    (folder / "git").chmod(0o755)
    return str(root), str(folder)


def test_errors_are_rows_and_the_others_finish(spark, clones, monkeypatch):
    root, folder = clones
    monkeypatch.setenv("PATH", f"{folder}:{os.environ['PATH']}")
    reader = local.CommitLogReader({"path": root, "seconds": "2"})
    rows = {p.repo: list(reader.read(p)) for p in reader.partitions()}
    assert rows["o/empty"] == []
    assert [r[-1] for r in rows["o/fine"] if r[-1]] == [] and len(rows["o/fine"]) > 5
    assert rows["o/slow"][-1][:4] == ("o/slow", None, None, None) and "took more than 2 s" in rows["o/slow"][-1][-1]
    assert "commit log: git log failed" in rows["o/broken"][-1][-1]


def test_from_clones_to_the_files_of_a_run(spark, clones, tmp_path):
    root, _ = clones
    out = str(tmp_path / "out")
    rows = {r.repo: r for r in profile.profile_clones(spark, root, out, AS_OF(), created_at="now").collect()}
    fine, empty, broken = rows["o/fine"], rows["o/empty"], rows["o/broken"]
    assert (fine.org, fine.total_commits, fine.merged_prs, fine.total_files, fine.has_tests, fine.default_branch, fine.error) == ("o", 5, 1, 2, True, "main", None)
    assert (fine.repo_created_at[:10], fine.test_source_loc_pct, fine.contributor_count) == ("2021-05-05", None, 1)
    assert empty.total_commits is None and empty.error is None and empty.default_branch == "main"
    assert "git log failed" in broken.error and broken.total_commits is None and broken.total_files == 0
    read = lambda name: "".join(open(os.path.join(out, name, f), newline="").read() for f in sorted(os.listdir(os.path.join(out, name))) if f.startswith("part-"))
    table = list(csv.DictReader(read("summary.csv").splitlines()))
    assert [r["repo"] for r in table] == ["o/broken", "o/empty", "o/fine", "o/slow"]
    assert [json.loads(x)["repo"] for x in read("failures.json").splitlines()] == ["o/broken"]
    told = json.loads(read("manifest.json"))
    assert (told["repos"], told["ok"], told["failed"]) == (4, 3, 1)
    assert profile.profile_clones(spark, str(tmp_path / "bin"), str(tmp_path / "none"), AS_OF()).count() == 0


def test_evidence_follows_the_walk(spark):
    rows = [("r", p, 10, 1, t) for p, t in (("docs/readme.md", "inner"), ("readme.md", "root"), ("src/b.py", "b"), ("src/a/z.py", "z"), ("a.py", "top"), ("README", ""), ("src/c.py", ""))]
    rows += [("q", f"d/{k:04}.py", 10, 1, "x") for k in range(300)]
    files = spark.createDataFrame(rows, "repo string, path string, bytes long, lines long, sample string")
    shown = trees.evidence(files)
    assert "WindowGroupLimit" in shown._jdf.queryExecution().toString()
    got = {r.repo: r for r in shown.collect()}
    assert got["r"].readme_excerpt == "root"
    assert got["r"].file_paths == ["README", "a.py", "readme.md", "docs/readme.md", "src/b.py", "src/c.py", "src/a/z.py"]
    assert [x.path for x in got["r"].source_excerpts] == ["a.py", "src/b.py", "src/a/z.py"]
    assert len(got["q"].file_paths) == 250 and len(got["q"].source_excerpts) == 4 and got["q"].readme_excerpt is None
    facts = spark.createDataFrame([("r", "o", "Py", "Py:100.0%", 5, 2, True)], "repo string, org string, primary_language string, languages_breakdown string, loc long, total_commits long, has_tests boolean")
    with_facts = {r.repo: r.repository for r in trees.with_repository(shown, facts).collect()}
    assert with_facts["r"].name == "r" and with_facts["r"].loc == 5 and with_facts["q"] is None


def test_answers_of_any_type_give_rows(spark):
    files = spark.createDataFrame([(f"r{k}", "a.py", 1, 1, "x") for k in range(5)], "repo string, path string, bytes long, lines long, sample string")
    answers = {
        "r0": {"codebase_description": " d ", "vibe_code_signals": [" a ", "", 3], "repo_type": " Mobile "},
        "r1": {"industry_domain": "  ", "vibe_code_signals": "one", "repo_type": None},
        "r2": ["no object"],
        "r3": {"codebase_description": 7, "industry_domain": None, "vibe_code_signals": None, "repo_type": 5},
        "r4": {},
    }
    got = {r.repo: r for r in classify.classify(trees.evidence(files), lambda row: answers[row["repo"]]).collect()}
    fields = lambda k: (got[k].codebase_description, got[k].industry_domain, got[k].vibe_code_signals, got[k].repo_type)
    assert fields("r0") == ("d", "unknown", '["a", "3"]', "mobile")
    assert fields("r1") == ("", "unknown", '["one"]', "other")
    assert got["r2"].llm_analysis_error == "the answer is no object" and got["r2"].repo_type is None
    assert fields("r3") == ("7", "None", '["None"]', "other")
    assert fields("r4") == ("", "unknown", "[]", "other")


def test_rounding_is_that_of_the_exact_value(spark):
    df = spark.range(1, 701).select(F.col("id").alias("t")).join(spark.range(0, 701).select(F.col("id").alias("v")), F.col("v") <= F.col("t"))
    x, y = 100.0 * F.col("v") / F.col("t"), F.col("v") / F.col("t")
    for r in df.select("v", "t", S.exact_round(x, 1).alias("a"), S.fixed_text(x, 1).alias("b"), S.exact_round(y, 4).alias("c")).collect():
        assert (r.a, r.b, r.c) == (round(100.0 * r.v / r.t, 1), f"{100.0 * r.v / r.t:.1f}", round(r.v / r.t, 4))
    odd = [2.675, 0.5, 1.5, 2.5, -0.25, -2.5, 1e17, 1e300, 0.0, 123456789.125]
    got = spark.createDataFrame([(v,) for v in odd], "v double").select(S.exact_round(F.col("v"), 2), S.exact_round(F.col("v"), 0)).collect()
    assert [tuple(r) for r in got] == [(round(v, 2), round(v, 0)) for v in odd]


def test_lines_of_a_counter(spark, clones, tmp_path, monkeypatch):
    root, folder = clones
    (tmp_path / "bin" / "count").write_text('#!/bin/sh\ncase "$3" in *fine) echo \'[{"Name":"Go","Code":3},{"name":"Go","code":4},{"Code":1}]\';; *empty) echo "{}";; *) echo broken >&2; exit 2;; esac\n')
    (tmp_path / "bin" / "count").chmod(0o755)
    reader = local.LineCountReader({"path": root, "counter": f"{folder}/count"})
    rows = {p.repo: list(reader.read(p)) for p in reader.partitions()}
    assert rows["o/fine"] == [("o/fine", "Go", 7, None), ("o/fine", "Unknown", 1, None)] and rows["o/empty"] == []
    assert "broken" in rows["o/slow"][0][-1]
    missing = local.LineCountReader({"path": root, "counter": "no-such-counter"})
    assert "there is no program no-such-counter" in list(missing.read(missing.partitions()[0]))[0][-1]
    out = {r.repo: r for r in profile.profile_clones(spark, root, str(tmp_path / "counted"), AS_OF(), counter=f"{folder}/count").collect()}
    assert (out["o/fine"].loc, out["o/fine"].primary_language, out["o/fine"].languages_breakdown) == (8, "Go", "Go:87.5%; Unknown:12.5%")
    assert "broken" in out["o/slow"].error and out["o/slow"].total_commits == 3 and out["o/slow"].total_files == 0
    assert local.is_clone(f"{root}/o/fine") and not local.is_clone(root)


def test_arguments():
    from datetime import datetime, timezone

    from quarrylight.plans.arguments import RunArguments as R

    for bad, why in (
        (R(offline=True), "folder"), (R(offline=True, clones="/c", github_orgs=("o",)), "hosted"), (R(github_orgs=("o",)), "tokens"),
        (R(offline=True, clones="/c", classify=True, environment={"CLASSIFIER_API_KEY": " "}), "environment"),
    ):
        with pytest.raises(ValueError, match=why):
            bad.check()
    assert R(offline=True, clones="/c/my clones/").check().label() == "my clones"
    assert R(offline=True, clones="/c/my clones/").folder(datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)) == "raw-extract-my_clones-20240102T030405Z"
    labels = [R(github_orgs=("a",), gitlab_groups=("b",)), R(gitlab_groups=("b",), github_accessible=True), R(gitlab_accessible=True), R(github_repos=("o/r",)), R(gitlab_repos=("g/p",)), R()]
    assert [x.label() for x in labels] == ["a", "b", "gitlab-accessible", "o_r", "g_p", "repos"]


def test_report_of_totals(spark, tmp_path):
    from quarrylight.sources import sinks

    counts = spark.createDataFrame([("GitHub", "o/b", 2), ("GitHub", "o/a", 0), ("GitLab", "g/p", 5)], "platform string, repo string, merged long")
    sinks.write_totals(counts, str(tmp_path / "t"))
    lines = "".join(open(tmp_path / "t" / f).read() for f in os.listdir(tmp_path / "t") if f.startswith("part-")).splitlines()
    assert lines == ["  o/a: 0", "  o/b: 2", "  GitHub subtotal: 2", "  g/p: 5", "  GitLab subtotal: 5", "Grand total: 7"]
