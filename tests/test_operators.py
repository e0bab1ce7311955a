"""Golden cases of operators, the stream against the batch, sources over files made here."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrylight.operators import history, progress, targets, trees
from quarrylight.plans import classify, summary
from quarrylight.sources import hosted, local, run_dir, sinks
from quarrylight.streaming import progress as streaming

NOW = lambda: F.to_timestamp(F.lit("2024-03-01T00:00:00Z"))


def commits(spark, rows):
    return spark.createDataFrame(rows, "repo string, log_pos long, sha string, author_name string, author_email string, author_date string, subject string, body string")


def test_fold_prefers_newest_merge_then_oldest_squash(spark):
    mk = lambda n, s: ("r", n, str(n), "A", "a@x", f"2024-01-{n:02}T00:00:00+00:00", s, "")
    squash, merge = "x (#5)", "Merge pull request #5 from a/b"
    assert history.fold_merged(commits(spark, [mk(1, squash), mk(9, squash)])).first()["merge_commit"] == "9"
    assert history.fold_merged(commits(spark, [mk(1, squash), mk(4, merge), mk(7, merge)])).first()["merge_commit"] == "4"


def test_fold_orders_by_text(spark):
    rows = [("r", k, str(k), "A", "a", t, f"x (#{k})", "") for k, t in ((1, "2024-01-02T01:00:00+02:00"), (2, "2024-01-01T23:30:00+00:00"))]
    assert [r["pr_number"] for r in history.fold_merged(commits(spark, rows)).collect()] == ["2", "1"]


def test_git_stats(spark):
    rows = [("r", 4 - k, str(k), n, "e", f"2024-01-0{k}T00:00:00+00:00", "s", "") for k, n in ((1, "Ann"), (2, "renovate"), (3, "Ann"))]
    got = history.git_stats(commits(spark, rows), NOW()).first()
    assert (got.total_commits, got.human_authors, got.bot_authors, got.bot_commit_count, got.span_days, got.bot_commit_ratio) == (3, 1, 1, 1, 2, 0.3333)
    assert got.authors[0].name == "Ann" and got.recency_days == 58


def test_commit_lines(spark):
    sha = "a" * 40
    lines = [f"\x1e{sha}\x1fp1 p2\x1fAnn\x1fa@x\x1f2024-01-01\x1fSubject", "3\t1\tsrc/a.py", "-\t-\tlogo.png"]
    got = history.commits_of_lines(spark.createDataFrame([("r", k, x) for k, x in enumerate(lines)], "repo string, line_no long, line string")).first()
    assert (got.sha, got.additions, got.deletions, [f.path for f in got.files]) == (sha, 3, 1, ["src/a.py", "logo.png"])
    assert got.parents == ["p1", "p2"] and got.log_pos == 1


def test_language_shares(spark):
    rows = [("r", 0, "b", 1.0), ("r", 1, "a", 3.0), ("e", 0, "x", None), ("t", 0, "b", 10.0), ("t", 1, "a", 10.0)]
    df = spark.createDataFrame(rows, "full_name string, map_pos int, language string, value double")
    got = {r.full_name: (r.languages_breakdown, r.primary_language) for r in trees.language_shares(df).collect()}
    assert got == {"r": ("a:75.0%; b:25.0%", "a"), "e": ("", ""), "t": ("b:50.0%; a:50.0%", "b")}
    assert {r.full_name: r.primary_language for r in trees.language_shares(df, by_name=True).collect()}["t"] == "a"


def test_tree_facts_and_evidence(spark):
    rows = [("o/r", "src/a.py", 2048, 10, "x"), ("o/r", "tests/test_a.py", 10, 5, "y"), ("o/r", "vendor/z.py", 9999, 99, "z"), ("o/q", "README.md", 1, 1, "hello")]
    files = spark.createDataFrame(rows, "repo string, path string, bytes long, lines long, sample string")
    got = {r.repo: r for r in trees.tree_facts(files).collect()}
    assert (got["o/r"].total_files, got["o/r"].size_kb, got["o/r"].has_tests, got["o/r"].test_source_loc_pct) == (2, 2, True, 50.0)
    assert got["o/q"].test_source_loc_pct is None and not got["o/q"].has_tests
    shown = {r.repo: r for r in trees.evidence(files).collect()}
    assert shown["o/q"].readme_excerpt == "hello" and [s.path for s in shown["o/r"].source_excerpts] == ["src/a.py"]
    said = {r.repo: r for r in classify.classify(trees.evidence(files)).collect()}
    assert said["o/r"].repo_type == "other" and said["o/r"].llm_analysis_error is None
    failed = classify.classify(trees.evidence(files), lambda row: 1 / 0).first()
    assert "division" in failed.llm_analysis_error


def test_targets(spark):
    t = lambda *rows: spark.createDataFrame(rows, "platform string, full_name string, pos int")
    got = targets.union_targets(t(("g", "a", 0)), t(("g", "a", 0), ("g", "b", 1))).collect()
    assert {(r.full_name, r.branch) for r in got} == {("a", 0), ("b", 1)}
    sel = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "pos int, selector string")
    assert [r.selector for r in targets.merge_selectors(sel("A/b", " ", "a/B")).collect()] == ["A/b"]
    base = t(("g", "org/Repo", 0), ("g", "org/other", 1))
    assert [r.full_name for r in targets.select_targets(base, sel("repo")).collect()] == ["org/Repo"]
    assert targets.select_targets(base, sel()).count() == 2
    none = targets.select_targets(base, sel("x"))  # no job runs yet
    with pytest.raises(Exception, match="the selectors match no target"):
        none.collect()
    groups = spark.createDataFrame([("a",), ("a/b",), ("ab",), ("a",)], "id string")
    assert {r.id for r in targets.top_level(groups).collect()} == {"a", "ab"}


LINES = ["Extracting 4 repos", "[1/4] OK a/b: 1", "noise", "FAIL a/c: x"]


def test_progress_batch_and_stream_agree(spark, tmp_path):
    rows = [("r", k, x) for k, x in enumerate(LINES)]
    batch = progress.progress(spark.createDataFrame(rows, "run string, seq long, line string"), "run").first()
    assert (batch.total, batch.completed, batch.failed, batch.done, batch.percent, batch.current) == (4, 1, 1, 2, 50, "a/c")
    for parts in (1, 2, 4):
        base = tmp_path / str(parts)
        (base / "log").mkdir(parents=True)
        step = -(-len(rows) // parts)
        for k in range(parts):
            body = "\n".join(json.dumps({"run": r, "seq": s, "line": x}) for r, s, x in rows[k * step : (k + 1) * step])
            (base / "log" / f"{k}.json").write_text(body)
            streaming.start(streaming.log_stream(spark, str(base / "log")), f"p{parts}_{k}", str(base / f"check{k}"), "run").awaitTermination()
        assert spark.table(f"p{parts}_{parts - 1}").first().asDict() == batch.asDict()


def test_summary_keeps_what_is_known(spark, tmp_path):
    tg = spark.createDataFrame([("o", "o/r"), ("o", "o/q")], "org string, full_name string")
    cs = commits(spark, [("o/r", 1, "s", "Ann", "a", "2020-01-01T00:00:00+00:00", "x (#1)", ""), ("o/r", 0, "t", "Ann", "a", "2024-01-01T00:00:00+00:00", "y", "")])
    files = spark.createDataFrame([("o/r", "a.py", 10, 1, "x")], "repo string, path string, bytes long, lines long, sample string")
    langs = spark.createDataFrame([("o/q", 0, "Go", 5.0)], "full_name string, map_pos int, language string, value double")
    locs = spark.createDataFrame([("o/r", "Python", 7)], "repo string, language string, code long")
    errors = spark.createDataFrame([("o/q", "e" * 900)], "repo string, error string")
    rows = summary.summary(tg, cs, files, langs, locs, NOW(), errors)
    q, r = rows.collect()
    assert (q.repo, len(q.error), q.languages_breakdown, q.total_files, q.has_tests, q.company_period) == ("o/q", 500, "Go:100.0%", 0, False, "2020–2024")
    assert (r.merged_prs, r.loc, r.primary_language, r.contributor_count, r.error) == (1, 7, "Python", 1, None)
    assert [x.repo for x in summary.failures(rows).collect()] == ["o/q"]
    sinks.write_summary(rows, str(tmp_path / "s"))
    assert run_dir.summary(spark, str(tmp_path / "s"), rows=1).first()["truncated"] is True
    assert json.loads(sinks.manifest(rows, "now"))["failed"] == 1


def test_local_clone(spark, tmp_path):
    repo = tmp_path / "o" / "r"
    repo.mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=Ann", "-c", "user.email=a@x.example", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "a.py").write_text("one\ntwo\n")
    run("add", ".")
    run("commit", "-qm", "First (#3)")
    got = history.commits_of_lines(local.commit_lines(spark, str(tmp_path))).first()
    assert (got.repo, got.subject, got.additions) == ("o/r", "First (#3)", 2)
    assert local.files(spark, str(tmp_path)).select("path", "lines").collect() == [("a.py", 2)]


def test_hosted_pages():
    served = {1: ([1, 2], {"link": '<x>; rel="next"'}), 2: ([3], {})}
    fetch = lambda url, headers: served[int(url.rsplit("=", 1)[1])]
    assert list(hosted.pages("u", "link", {}, 2, fetch)) == [1, 2, 3]
    tries = []

    def limited():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("API rate limit exceeded")
        return "ok"

    waits = []
    assert hosted.with_retry(limited, waits.append) == "ok" and waits == [30, 60]


def test_config(spark):
    lines = spark.createDataFrame([("# c",), ("a=b=c",), ("",), (" k = v ",)], "value string")
    assert {tuple(r) for r in targets.config(lines).collect()} == {("a", "b=c"), ("k", "v")}


def test_lines_that_tell_how_a_repository_ended(spark):
    lines = ["OK a/a: no space before", "[1/2] OK a/b c: 1", "x OK ", "a FAIL b OK c: FAIL d: e", "FAIL a/c FAIL y", "nothing"]
    df = spark.createDataFrame([("r", k, x) for k, x in enumerate(lines)] + [("s", 0, "nothing")], "run string, seq long, line string")
    got = {r.run: r for r in progress.progress(df, "run").collect()}
    assert (got["r"].completed, got["r"].failed, got["r"].current) == (3, 1, "a/c FAIL y")
    assert (got["s"].total, got["s"].completed, got["s"].percent, got["s"].current) == (0, 0, 0, "")


def test_completion_reads_whole_paths_and_the_run_object(spark):
    lines = ["Done. summary=/a b/s.csv ", "Zip=/a b/x.zip", '{"run_dir": "/a b", "ok": 3}', '{"other": 1}', "{broken", "[1]"]
    got = progress.completion(spark.createDataFrame(list(enumerate(lines)), "seq long, line string")).first()
    assert (got.summary, got.archive, got.manifest) == ("/a b/s.csv", "/a b/x.zip", '{"run_dir": "/a b", "ok": 3}')


def test_merged_changes_of_a_clone(spark, tmp_path):
    at = tmp_path / "org" / "repo"
    at.mkdir(parents=True)
    git = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    for text in ("Merge branch 'x'\n\nWork\n\nSee merge request g/p!9", "fix\ttabs (#3)", "Merge pull request #5 from a/b\n\nTitle"):
        git("commit", "-q", "--allow-empty", "-m", text)
    texts = local.commit_texts(spark, str(tmp_path))
    got = {r.pr_number: (r.method, r.source_branch, r.title, r.merged_by_name) for r in history.fold_merged(texts).collect()}
    assert got == {"9": ("merge-commit", "", "Merge branch 'x'", "A"), "3": ("squash", "", "fix\ttabs", "A"), "5": ("merge-commit", "a/b", "Title", "A")}
    commits_ = history.commits_of_lines(local.commit_lines(spark, str(tmp_path)))
    assert {r.subject for r in commits_.collect()} == {"Merge branch 'x'", "fix\ttabs (#3)", "Merge pull request #5 from a/b"}
    one = spark.createDataFrame([("org", "org/repo")], "org string, full_name string")
    empty = spark.createDataFrame([], "full_name string, map_pos int, language string, value double")
    loc = spark.createDataFrame([], "repo string, language string, code long")
    rows = summary.summary(one, commits_, local.files(spark, str(tmp_path)), empty, loc, NOW(), texts=texts).collect()
    assert [(r.repo, r.merged_prs, r.total_commits) for r in rows] == [("org/repo", 3, 3)]
    assert local.default_branch(str(at)) not in ("", "not_collected_offline") and local.default_branch(str(tmp_path)) == "not_collected_offline"
