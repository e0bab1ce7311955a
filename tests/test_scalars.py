"""Golden cases of the scalar functions and predicates."""

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import predicates as P
from quarrylight.functions import scalars as S


def one(spark, column, **values):
    row = spark.range(1)
    for k, v in values.items():
        row = row.withColumn(k, v if not isinstance(v, (str, int, float, type(None))) else F.lit(v))
    return row.select(column.alias("x")).first()["x"]


c = F.col


def test_names(spark):
    assert one(spark, S.safe_name(c("t")), t="ü/a b") == "ü_a_b"
    assert one(spark, S.repo_slug(c("t")), t="a/b c") == "a__b_c"


@pytest.mark.parametrize("path,want", [(".", ("R", "R")), ("r", ("R", "r")), ("o/r", ("o", "o/r")), ("github/o/r", ("o", "o/r"))])
def test_org_of_path(spark, path, want):
    assert tuple(one(spark, S.org_of_path(c("root"), c("p")), root="R", p=path)) == want


@pytest.mark.parametrize("date,want", [("1969-01-01", None), ("2101-01-01", None), ("", None), ("2020-05-05", 2020), ("x", None)])
def test_commit_year(spark, date, want):
    assert one(spark, S.commit_year(c("d")), d=date) == want


@pytest.mark.parametrize("a,b,want", [(2020, 2020, "2020"), (2020, 2024, "2020–2024"), (None, 2024, "2024"), (2020, None, "2020"), (None, None, "")])
def test_period_label(spark, a, b, want):
    assert one(spark, S.period_label(c("a"), c("b")), a=F.lit(a).cast("int"), b=F.lit(b).cast("int")) == want


def test_floor_days(spark):
    a, b = "2024-01-03T00:10:00+00:00", "2024-01-02T01:00:00+02:00"
    assert one(spark, S.floor_days(F.to_timestamp("a"), F.to_timestamp("b")), a=a, b=b) == -2


def test_in_range(spark):
    t = F.to_timestamp(F.lit("2024-01-01"))
    assert one(spark, S.in_range(t, t, t)) is True
    assert one(spark, S.in_range(F.lit(None).cast("timestamp"), t, t)) is False


@pytest.mark.parametrize(
    "subject,body,want",
    [
        ("Merge pull request #5 from a/b", "Title here\nmore", ("5", "merge-commit", "a/b", "Title here")),
        ("Merged in topic (pull request #7)", "", ("7", "merge-commit", "topic", "Merged in topic (pull request #7)")),
        ("Merge branch 'x'", "Work\n\nSee merge request g/p!9", ("9", "merge-commit", "", "Merge branch 'x'")),
        ("Merged in topic (pull request #7)", "Body line", ("7", "merge-commit", "topic", "Merged in topic (pull request #7)")),
        ("Merge pull request #5 from a/b", " \r\n kept\r\nmore ", ("5", "merge-commit", "a/b", "kept")),
        ("Fix it (#12)", "", ("12", "squash", "", "Fix it")),
        ("Fix it", "", None),
    ],
)
def test_merge_marker(spark, subject, body, want):
    got = one(spark, S.merge_marker(c("s"), c("b")), s=subject, b=body)
    assert (tuple(got) if got else None) == want


def test_small_scalars(spark):
    assert one(spark, S.mask_credentials(c("t")), t="https://oauth2:abc@h/x") == "https://***@h/x"
    assert one(spark, S.digits_or_zero(c("t")), t="-") == 0 and one(spark, S.digits_or_zero(c("t")), t="12") == 12
    assert one(spark, S.percent_done(c("a"), c("b")), a=2, b=4) == 50 and one(spark, S.percent_done(c("a"), c("b")), a=2, b=0) == 0
    assert one(spark, S.percent_encoded(c("t")), t="a b/c") == "a%20b%2Fc"
    assert one(spark, S.line_count(c("t")), t="a\nb") == 2 and one(spark, S.line_count(c("t")), t="a\n") == 1 and one(spark, S.line_count(c("t")), t="") == 0
    assert [one(spark, S.exact_round(c("v"), 1), v=v) for v in (0.25, 0.35, 12.25, 66.65)] == [0.2, 0.3, 12.2, 66.7]
    assert one(spark, S.json_truthy(c("t"), "main"), t='{"main": "x"}') and not one(spark, S.json_truthy(c("t"), "main"), t="{broken")
    assert one(spark, S.is_under(c("a"), c("b")), a="/x", b="/x/y") and not one(spark, S.is_under(c("a"), c("b")), a="/x", b="/xy")
    assert one(spark, S.gitlab_api(c("h")), h="h.example/") == "https://h.example/api/v4"
    assert one(spark, S.redact_arguments(F.array(F.lit("-t"), F.lit("s"), F.lit("a")), ("-t",))) == ["-t", "***", "a"]


def test_dates(spark):
    assert str(one(spark, S.parse_bound(c("t")), t="2024-01-02")) == "2024-01-02 00:00:00"
    assert one(spark, S.parse_bound(c("t")), t="yesterday") is None
    with pytest.raises(Exception, match="not a date"):
        one(spark, S.checked_bound(c("t")), t="yesterday")


@pytest.mark.parametrize("name,want", [("foo[bot] x", False), ("dependabot[bot] x", True), ("Ann a@b.example", False)])
def test_bot_author(spark, name, want):
    assert one(spark, P.is_bot_author(c("n"), c("e")), n=name, e="e@x.example") is want


def test_bot_login(spark):
    assert one(spark, P.is_bot_login(c("n"), c("k")), n="abbott", k="User") is True
    assert one(spark, P.is_bot_login(c("n"), c("k")), n="", k="User") is False


def test_paths(spark):
    assert one(spark, P.shows_tests(c("p")), p="latest/a.py") is True and one(spark, P.is_test_path(c("p")), p="latest/a.py") is False
    assert one(spark, P.is_test_path(c("p")), p="src/x.test.ts") is True
    assert one(spark, P.is_walked(c("p")), p="a/vendor/b.py") is False
    assert one(spark, P.shows_ci(c("p")), p=".github/workflows/a.yml") is True and one(spark, P.shows_ci(c("p")), p="Jenkinsfile.release") is True
    assert one(spark, P.shows_runner(c("p"), c("s")), p="package.json", s='{"x": "jest"}') is True
    assert one(spark, P.shows_library(c("p"), c("s")), p="package.json", s='{"main": "x"}') is True
    assert one(spark, P.shows_library(c("p"), c("s")), p="a/lib/b.c", s="") is True


def test_truth_bots_and_secret_settings(spark):
    truthy = lambda t: one(spark, S.json_truthy(c("t"), "main"), t=t)
    assert all(truthy(t) for t in ('{"main": "0"}', '{"main": "false"}', '{"main": "null"}', '{"main": [0]}', '{"main": 0.5}', '{"main": true}'))
    assert not any(truthy(t) for t in ('{"main": ""}', '{"main": 0}', '{"main": 0.0}', '{"main": false}', '{"main": null}', '{"main": []}', '{"main": {}}', "{}", "[1]", "{broken"))
    assert [one(spark, P.is_bot_login(c("n"), c("k")), n=n, k="User") for n in ("renovate", "mergify", "greenkeeper", "anna")] == [True, True, True, False]
    settings = F.create_map(F.lit("Token"), F.lit("x"), F.lit("API_KEY"), F.lit("y"), F.lit("org"), c("n"))
    assert one(spark, S.redact_map(settings), n="z") == {"org": "z"}
