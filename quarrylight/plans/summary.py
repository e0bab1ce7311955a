"""The summary: one row per repository from all its facts, in one lazy plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import history, trees
from ..schemas import SUMMARY, SUMMARY_DEFAULTS


#: Facts of a repository that only its hosted service knows, or knows better.
HOSTED_FACTS = ("repo_created_at", "primary_language", "size_kb", "default_branch", "contributor_count", "merged_prs")


def fill(rows: DataFrame) -> DataFrame:
    """Rows with exactly the columns of the summary, in order and type, defaults where a fact is missing."""
    have = set(rows.columns)

    def column(name: str, kind: str) -> Column:
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return (F.coalesce(value, F.lit(SUMMARY_DEFAULTS[name])) if name in SUMMARY_DEFAULTS else value).alias(name)

    return rows.select(*(column(n, k) for n, k in SUMMARY.items()))


#: The stages of a repository's work, in order; facts of later stages than one that failed are left out.
HOSTED, GIT, LINES, TREE = range(4)


def first_errors(errors: DataFrame) -> DataFrame:
    """(repo, failed, error): of every repository the error of its earliest stage, cut to 500 characters."""
    one = errors.groupBy("repo").agg(F.min_by(F.struct("stage", "error"), F.struct("stage", "error")).alias("e"))
    return one.select("repo", F.col("e.stage").alias("failed"), F.left("e.error", F.lit(500)).alias("error"))


def summary(
    targets: DataFrame, commits: DataFrame, files: DataFrame, languages: DataFrame, lines: DataFrame, as_of: Column,
    errors: DataFrame | None = None, texts: DataFrame | None = None, hosted: DataFrame | None = None,
) -> DataFrame:
    """One row per target (org, full_name): left joins on the full name, so a missing fact leaves its default.

    `lines` (repo, language, code) wins over `languages` for the label; `errors` (repo, error, and the stage that
    failed, if known) marks failed targets, which keep what was known before they failed: with a stage, facts of later
    stages are left out. `texts` are the commits with their bodies, if `commits` lack them. `hosted` (repo and any of
    repo_created_at, primary_language, size_kb, default_branch, contributor_count, merged_prs) comes from a hosted
    service and wins over what the clone tells. Without it, the first commit's date stands for the date of creation,
    and the clone's authors for its contributors. Ordered by organisation and repository.
    """
    stats = history.git_stats(commits, as_of).withColumnRenamed("last_commit", "last_commit_date").drop("authors", "bot_commit_count")
    merged = history.fold_merged(commits if texts is None else texts).groupBy("repo").agg(F.count(F.lit(1)).alias("merged_prs"))
    loc = lines.groupBy("repo").agg(F.sum("code").alias("loc"))
    shares = lambda df, by_name, p: trees.language_shares(df, by_name).select(F.col("full_name").alias("repo"), F.col("languages_breakdown").alias(f"{p}l"), F.col("primary_language").alias(f"{p}p"))
    counted = lines.select(F.col("repo").alias("full_name"), F.lit(0).alias("map_pos"), "language", F.col("code").cast("double").alias("value"))
    facts = [(GIT, stats), (LINES, merged), (LINES, loc), (TREE, trees.tree_facts(files)), (HOSTED, shares(languages, False, "a")), (LINES, shares(counted, True, "b"))]
    known = [c for c in HOSTED_FACTS if hosted is not None and c in hosted.columns]
    if known:
        facts.append((HOSTED, hosted.select("repo", *(F.col(c).alias(f"h_{c}") for c in known))))
    base = targets.select("org", F.col("full_name").alias("repo"), S.last_segment(F.col("full_name")).alias("project_name"))
    if errors is not None:
        staged = errors if "stage" in errors.columns else errors.withColumn("stage", F.lit(TREE + 1))
        base = base.join(first_errors(staged), "repo", "left")
    else:
        base = base.withColumn("failed", F.lit(None).cast("int"))

    def joined(rows: DataFrame, fact: tuple[int, DataFrame]) -> DataFrame:
        stage, df = fact
        held = [c for c in df.columns if c != "repo"]
        out = rows.join(df, "repo", "left")
        return out.withColumns({c: F.when(F.col("failed").isNull() | (F.col("failed") > stage), F.col(c)) for c in held})

    rows = reduce(joined, facts, base)
    rows = rows.withColumn("languages_breakdown", F.coalesce(F.nullif("bl", F.lit("")), "al")).withColumn("primary_language", F.coalesce(F.nullif("bp", F.lit("")), "ap"))
    rows = rows.withColumn("contributor_count", F.col("human_authors") + F.col("bot_authors"))
    if not known:
        rows = rows.withColumn("repo_created_at", F.col("first_commit"))
    for c in known:
        rows = rows.withColumn(c, F.coalesce(f"h_{c}", c) if c in rows.columns else F.col(f"h_{c}"))
    return fill(history.company_periods(rows)).orderBy("org", "repo")


def failures(rows: DataFrame) -> DataFrame:
    return rows.where(F.length("error") > 0).select("org", "repo", "error")


def outcome_counts(rows: DataFrame) -> DataFrame:
    bad = F.count_if(F.length("error") > 0)
    return rows.agg(F.count(F.lit(1)).alias("repos"), (F.count(F.lit(1)) - bad).alias("ok"), bad.alias("failed"))
