"""Sinks: summary CSV, commits as JSON lines, failures and manifest as JSON. Only columns of the summary are written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import summary as plan
from ..schemas import SUMMARY


def write_summary(rows: DataFrame, path: str, python_booleans: bool = False) -> None:
    """One ordered CSV with doubled quotes and CRLF; it has one row per repository, so one task writes it."""
    out = rows.select(*SUMMARY)
    if python_booleans:
        flags = [c for c, k in SUMMARY.items() if k == "boolean"]
        out = out.withColumns({c: F.initcap(F.col(c).cast("string")) for c in flags})
    out.coalesce(1).sortWithinPartitions("org", "repo").write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", lineSep="\r\n")


def write_commits(commits: DataFrame, path: str) -> None:
    """JSON lines, a folder for each repository."""
    commits.write.mode("overwrite").partitionBy("repo").json(path)


def write_failures(rows: DataFrame, path: str) -> None:
    plan.failures(rows).coalesce(1).write.mode("overwrite").json(path)


#: Where the summary's columns come from, for the manifest.
PROVENANCE = {
    "commits, dates, authors": "the log of the clone: HEAD, and the root that it names first",
    "merged_prs": "the service's total, else merge and squash marks in the commits' texts",
    "languages": "lines of code by language, else what the service tells",
    "repo_created_at, default_branch, contributor_count": "the service, else the clone",
    "files, tests, ci, library": "the clone's file tree, without folders that walks skip",
    "company_period": "first and last year of commits of all repositories of the organisation",
}


def manifest(rows: DataFrame, created_at: str, **more: object) -> str:
    """Counts of a run as a JSON document, with where its columns come from: one row reaches the driver."""
    counts = plan.outcome_counts(rows).first().asDict()
    return json.dumps({"created_at": created_at, **counts, **more, "provenance": PROVENANCE}, indent=2, ensure_ascii=False)


def totals(counts: DataFrame) -> DataFrame:
    """The lines of a report on merged changes (platform, repo, merged): each repository, each platform, all.

    Rows (platform, level, repo, line) in the order of the report; a platform without repositories has no lines.
    """
    rolled = counts.rollup("platform", "repo").agg(F.coalesce(F.sum("merged"), F.lit(0)).alias("merged"), F.grouping_id().alias("level"))
    n = F.col("merged").cast("string")
    line = (
        F.when(F.col("level") == 0, F.concat(F.lit("  "), "repo", F.lit(": "), n))
        .when(F.col("level") == 1, F.concat(F.lit("  "), "platform", F.lit(" subtotal: "), n))
        .otherwise(F.concat(F.lit("Grand total: "), n))
    )
    return rolled.select("platform", "level", "repo", line.alias("line")).orderBy(F.asc_nulls_last("platform"), "level", "repo")


def write_totals(counts: DataFrame, path: str) -> None:
    """The report as one text file: it has a line per repository."""
    order = [F.asc_nulls_last("platform"), "level", "repo"]
    totals(counts).coalesce(1).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
