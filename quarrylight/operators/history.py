"""Commits and merged changes: git statistics, authors, churn, the fold of merged changes, periods, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S


#: How a commit is printed so that its lines can be told apart: a mark before each header, a mark between its fields
#: (hash, parents, name, e-mail, date, subject), numstat lines after it.
HEADER, FIELD = "\x1e", "\x1f"
LINE_FIELDS = ("%H", "%P", "%aN", "%aE", "%aI", "%s")
#: The fields of a commit that is printed with its body, as one record.
TEXT_FIELDS = ("%H", "%aI", "%an", "%ae", "%s", "%b")


def commits_of_lines(lines: DataFrame) -> DataFrame:
    """Commits with their parents and files from log lines (repo, line_no, line): a header line, then its numstat lines.

    `log_pos` counts the commits of a repository from the newest, 1; where the lines carry it already they are grouped
    by it, else a running count of headers tells which commit a line belongs to. Lines before the first header are
    dropped, and so are rows without a line. Hashes may be of any length.
    """
    lines = lines.where("line is not null").withColumn("is_header", F.col("line").startswith(HEADER))
    if "log_pos" not in lines.columns:
        lines = lines.withColumn("log_pos", F.sum(F.col("is_header").cast("long")).over(Window.partitionBy("repo").orderBy("line_no")))
    parts, stat = F.split(F.substring("line", F.lit(2), F.length("line")), FIELD, len(LINE_FIELDS)), F.split("line", "\t")
    head = lambda k: F.max(F.when(F.col("is_header"), F.get(parts, F.lit(k))))
    file = F.struct(F.col("line_no").alias("n"), stat[2].alias("path"), S.digits_or_zero(stat[0]).alias("additions"), S.digits_or_zero(stat[1]).alias("deletions"))
    grouped = lines.where("log_pos > 0").groupBy("repo", "log_pos").agg(
        head(0).alias("sha"), head(1).alias("p"), head(2).alias("author_name"), head(3).alias("author_email"), head(4).alias("author_date"), head(5).alias("subject"),
        F.array_sort(F.collect_list(F.when(~F.col("is_header") & (F.size(stat) == 3), file))).alias("f"),
    )
    files = F.transform("f", lambda x: F.struct(x["path"].alias("path"), x["additions"].alias("additions"), x["deletions"].alias("deletions")))
    parents = F.filter(F.split("p", " "), lambda x: x != "")
    return with_churn(grouped.withColumn("parents", parents).withColumn("files", files).drop("f", "p"))


def commits_of_records(records: DataFrame) -> DataFrame:
    """Commits with subject and body from records (repo, log_pos, record): the fields of TEXT_FIELDS, in order."""
    parts = F.split("record", FIELD, len(TEXT_FIELDS))
    names = ("sha", "author_date", "author_name", "author_email", "subject", "body")
    fields = [F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)]
    rows = records.where(F.size(parts) >= len(TEXT_FIELDS) - 1).select("repo", "log_pos", *fields)
    return rows.withColumn("body", F.coalesce("body", F.lit("")))


def parent_edges(commits: DataFrame) -> DataFrame:
    """One row per edge of the commit graph: repo, child, parent, and the parent's number among the child's."""
    return commits.select("repo", F.col("sha").alias("child"), F.posexplode("parents").alias("nth", "parent"))


def roots(commits: DataFrame) -> DataFrame:
    """The commits without parents, newest first in each repository."""
    return commits.where(F.size("parents") == 0).select("repo", "log_pos", "sha", "author_date")


def graph_facts(commits: DataFrame) -> DataFrame:
    """One row per repository: commits, roots, merges (two parents or more) and tips (no commit's parent).

    Parents are matched to commits by an anti-join on the hash, within a repository.
    """
    shape = commits.groupBy("repo").agg(
        F.count(F.lit(1)).alias("commits"), F.count_if(F.size("parents") == 0).alias("roots"), F.count_if(F.size("parents") > 1).alias("merges")
    )
    held = parent_edges(commits).select("repo", F.col("parent").alias("sha")).distinct()
    tips = commits.join(held, ["repo", "sha"], "left_anti").groupBy("repo").agg(F.count(F.lit(1)).alias("tips"))
    return shape.join(tips, "repo", "left").withColumn("tips", F.coalesce("tips", F.lit(0)))


def with_churn(commits: DataFrame) -> DataFrame:
    """Commits with the sums of their files' additions and deletions; none where there are no files."""
    total = lambda field: F.aggregate(F.coalesce("files", F.array()), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x[field], F.lit(0)))
    return commits.withColumn("additions", total("additions")).withColumn("deletions", total("deletions")).withColumn("is_bot", P.is_bot_author(F.col("author_name"), F.col("author_email")))


def author_tally(commits: DataFrame) -> DataFrame:
    """Commits of every author (name and e-mail) of a repository, and whether it is a bot."""
    return commits.groupBy("repo", "author_name", "author_email").agg(F.count(F.lit(1)).alias("commits")).withColumn("is_bot", P.is_bot_author(F.col("author_name"), F.col("author_email")))


def _edges(columns: list[str]) -> tuple[Column, Column]:
    """What the first and the last commit are the smallest by; null where a commit can't be one.

    With the commit graph, the last is HEAD, the first of the log, and the first is the root that the log names first,
    whatever their dates; with places in the log alone it is the last of the log; else dates decide.
    """
    if "log_pos" not in columns:
        time = F.unix_micros(F.to_timestamp("author_date"))
        return time, -time
    if "parents" not in columns:
        return -F.col("log_pos"), F.col("log_pos")
    return F.when(F.size("parents") == 0, F.col("log_pos")), F.col("log_pos")


def git_stats(commits: DataFrame, as_of: Column, top: int = 50) -> DataFrame:
    """One row per repository: commits, first and last date, span, recency, human and bot authors, their commits.

    `as_of` is the time that recency counts from. The author list holds the `top` busiest; the counts are over all.
    Commits are read once and reduced to one row per author, from which all is taken.
    """
    first_key, last_key = _edges(commits.columns)
    edge = lambda key: F.min(F.when(key.isNotNull(), F.struct(key.alias("k"), F.col("author_date").alias("d"))))
    by_author = commits.groupBy("repo", "author_name", "author_email").agg(F.count(F.lit(1)).alias("commits"), edge(first_key).alias("f"), edge(last_key).alias("l"))
    tally = by_author.withColumn("is_bot", P.is_bot_author(F.col("author_name"), F.col("author_email")))
    totals = tally.groupBy("repo").agg(
        F.sum("commits").alias("total_commits"),
        F.min("f")["d"].alias("first_commit"),
        F.min("l")["d"].alias("last_commit"),
        F.count_if(~F.col("is_bot")).alias("human_authors"),
        F.count_if("is_bot").alias("bot_authors"),
        F.coalesce(F.sum(F.when(F.col("is_bot"), F.col("commits"))), F.lit(0)).alias("bot_commit_count"),
    )
    ratio = F.coalesce(S.exact_round(F.col("bot_commit_count") / F.nullif(F.col("total_commits"), F.lit(0)), 4), F.lit(0.0))
    first, last = F.to_timestamp("first_commit"), F.to_timestamp("last_commit")
    return (
        totals.join(_listed(top_authors(tally, top)), "repo", "left")
        .withColumn("span_days", S.floor_days(first, last))
        .withColumn("recency_days", S.floor_days(last, as_of))
        .withColumn("bot_commit_ratio", ratio)
    )


def top_authors(tally: DataFrame, top: int = 50) -> DataFrame:
    """The busiest authors of every repository with their rank; the limit applies before the shuffle, too."""
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("commits"), "author_name", "author_email"))
    return tally.withColumn("rank", rank).where(F.col("rank") <= top)


def _listed(ranked: DataFrame) -> DataFrame:
    row = F.struct("rank", F.col("author_name").alias("name"), F.col("author_email").alias("email"), "commits", "is_bot")
    rows = ranked.groupBy("repo").agg(F.array_sort(F.collect_list(row)).alias("a"))
    return rows.select("repo", F.transform("a", lambda x: x.dropFields("rank")).alias("authors"))


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def fold_merged(commits: DataFrame) -> DataFrame:
    """One row per merged change of a repository, from markers in commit texts; log_pos counts from the newest.

    The newest merge commit wins; without one, the oldest squash. Ordered by the text of `merged_at`.
    """
    found = commits.withColumn("m", S.merge_marker(F.col("subject"), F.col("body"))).where("m is not null")
    rows = found.select("repo", "log_pos", "m.*", F.col("author_date").alias("merged_at"), F.col("author_name").alias("merged_by_name"), F.col("author_email").alias("merged_by_email"), F.col("sha").alias("merge_commit"))
    merge = F.col("method") == "merge-commit"
    best = first_by(rows, ["repo", "pr_number"], F.desc(merge), F.when(merge, F.col("log_pos")).otherwise(-F.col("log_pos")))
    return best.drop("log_pos").orderBy("repo", "merged_at", "pr_number")


def company_periods(rows: DataFrame) -> DataFrame:
    """Rows with the period of their organisation: from its first to its last year of commits."""
    w = Window.partitionBy("org")
    first, last = F.min(S.commit_year(F.col("first_commit"))).over(w), F.max(S.commit_year(F.col("last_commit_date"))).over(w)
    return rows.withColumn("company_period", S.period_label(first, last))


def merged_counts(changes: DataFrame, since: Column, until: Column) -> DataFrame:
    """Merged changes (platform, repo, merged_at) in a range, counted by repository, by platform and in all."""
    kept = changes.where(F.col("merged_at").isNotNull() & S.in_range(F.col("merged_at"), since, until))
    return kept.rollup("platform", "repo").agg(F.count(F.lit(1)).alias("merged"), F.grouping_id().alias("level"))


def enrich_requests(requests: DataFrame, detail: DataFrame, notes: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("iid",)) -> DataFrame:
    """Merge requests with their details, notes and changes; what is missing falls back to the request or to nothing.

    Notes and changes come as columns `note` and `change`; notes in the order of `seq`, if they have it.
    """
    on = list(keys)
    rest = [c for c in requests.columns if c not in on]

    def listed(df: DataFrame, c: str) -> DataFrame:
        if "seq" in df.columns:
            return df.groupBy(*on).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", c))), lambda x: x[c]).alias(c))
        return df.groupBy(*on).agg(F.collect_list(c).alias(c))

    d = detail.select(*on, *[F.col(c).alias(f"d_{c}") for c in rest])
    out = requests.join(d, on, "left").select(*on, *[F.coalesce(f"d_{c}", c).alias(c) for c in rest])
    out = out.join(listed(notes, "note"), on, "left").join(listed(changes, "change"), on, "left")
    empty = F.array().cast("array<string>")
    out = out.withColumn("notes", F.coalesce("note", empty)).withColumn("changes", F.coalesce("change", empty)).drop("note", "change")
    return out.withColumn("author_is_bot", P.is_bot_login(F.col("author.username"), F.lit(None).cast("string")))
