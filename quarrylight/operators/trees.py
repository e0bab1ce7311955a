"""Languages and file trees: shares, sizes, counts, ratios, detectors, evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S


def language_shares(languages: DataFrame, by_name: bool = False) -> DataFrame:
    """One row per repository: its languages with their shares, largest first, and the first of them.

    Equal shares keep the order of the source (`map_pos`), or with `by_name` that of the names, where zeros are
    dropped besides. Null values are dropped; a total of 0 or less gives an empty label.
    """
    rows = languages.where(F.col("value").isNotNull() & ((F.col("value") != 0) if by_name else F.lit(True)))
    tie = "language" if by_name else "map_pos"
    total = F.sum("value").over(Window.partitionBy("full_name"))
    share = F.concat("language", F.lit(":"), S.fixed_text(100.0 * F.col("value") / F.col("total"), 1), F.lit("%"))
    parts = rows.withColumn("total", total).where("total > 0").withColumn("part", F.struct((-F.col("value")).alias("k"), F.col(tie).alias("t"), F.col("language").alias("l"), share.alias("s")))
    grouped = parts.groupBy("full_name").agg(F.array_sort(F.collect_list("part")).alias("p"))
    known = grouped.select("full_name", F.array_join(F.transform("p", lambda x: x["s"]), "; ").alias("languages_breakdown"), F.col("p")[0]["l"].alias("primary_language"))
    every = languages.select("full_name").distinct()
    return every.join(known, "full_name", "left").select("full_name", *(F.coalesce(c, F.lit("")).alias(c) for c in known.columns[1:]))


def lines_by_language(counts: DataFrame) -> DataFrame:
    """Lines of code of every language and repository, with the repository's total."""
    by = counts.groupBy("repo", "language").agg(F.sum("code").alias("code"))
    return by.withColumn("loc", F.sum("code").over(Window.partitionBy("repo")))


def tree_facts(files: DataFrame) -> DataFrame:
    """One row per repository from one scan of its files: size, count, detectors and the ratio of test lines.

    The ratio is null if there are no lines of source that are not tests.
    """
    path, repo, sample = F.col("path"), F.col("repo"), F.col("sample")
    walked = P.is_walked(path)
    test = P.is_test_path(path)
    code = walked & P.is_code(path)
    lines = lambda which: F.coalesce(F.sum(F.when(code & which, F.col("lines"))), F.lit(0))
    some = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    facts = files.groupBy("repo").agg(
        F.coalesce(F.bround(F.sum(F.when(walked, F.col("bytes"))) / 1024, 0).cast("long"), F.lit(0)).alias("size_kb"),
        F.count_if(walked).alias("total_files"),
        some(walked & P.shows_tests(path, repo)).alias("has_tests"),
        some(walked & P.shows_runner(path, sample)).alias("has_test_runner"),
        some(P.shows_ci(path)).alias("has_ci_cd"),
        some(walked & P.shows_library(path, sample, repo)).alias("has_library_code"),
        lines(test).alias("test_loc"),
        lines(~test).alias("source_loc"),
    )
    ratio = F.when(F.col("source_loc") > 0, 100.0 * F.col("test_loc") / F.col("source_loc"))
    return facts.withColumn("test_source_loc_pct", S.exact_round(ratio, 1)).drop("test_loc", "source_loc")


def walk_key(path: Column) -> Column:
    """A sortable key of a file's place in a walk: a folder's files by name, then its subfolders by name, each whole."""
    return F.concat(F.transform(P.folders(path), lambda d: F.concat(F.lit("1"), d)), F.array(F.concat(F.lit("0"), F.element_at(F.split(path, "/"), -1))))


def evidence(files: DataFrame, paths: int = 250, samples: int = 4) -> DataFrame:
    """What a classifier gets to see of a repository: first paths, first readme, first source samples, all cut.

    First is the order of a walk (`walk_key`). A readme or sample that is empty is passed over. A file goes once to each need that it meets,
    and each need keeps its first files; the largest limit applies before the shuffle, so no repository's files
    meet in one task.
    """
    path, text = F.col("path"), F.coalesce("sample", F.lit(""))
    need = lambda name, ok, shown: F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("need"), shown.alias("shown")))
    readme = P.file_name(path).startswith("readme") & (text != "")
    needs = F.array(
        need("path", F.lit(True), F.lit(None).cast("string")),
        need("readme", readme, F.left(text, F.lit(4000))),
        need("source", P.is_sampled(path, F.col("bytes"), F.col("sample")), F.left(text, F.lit(1500))),
    )
    rows = files.where(P.is_walked(path)).select("repo", "path", walk_key(path).alias("at"), F.explode(F.array_compact(needs)).alias("x")).select("repo", "path", "at", "x.*")
    rank = F.row_number().over(Window.partitionBy("repo", "need").orderBy("at"))
    limit = F.when(F.col("need") == "path", paths).when(F.col("need") == "source", samples).otherwise(1)
    kept = rows.withColumn("n", rank).where(F.col("n") <= max(paths, samples, 1)).where(F.col("n") <= limit)
    listed = lambda name, value: F.transform(F.array_sort(F.collect_list(F.when(F.col("need") == name, F.struct("n", value.alias("v"))))), lambda x: x["v"])
    return kept.groupBy("repo").agg(
        F.max(F.when(F.col("need") == "readme", F.col("shown"))).alias("readme_excerpt"),
        listed("path", path).alias("file_paths"),
        listed("source", F.struct("path", F.col("shown").alias("content"))).alias("source_excerpts"),
    )


#: The facts of a repository that go with its evidence.
REPOSITORY_FACTS = ("repo", "org", "primary_language", "languages_breakdown", "loc", "total_commits", "has_tests")


def with_repository(shown: DataFrame, rows: DataFrame) -> DataFrame:
    """Evidence with the known facts of its repository (rows of the summary), null where there are none."""
    facts = rows.select("repo", F.struct(*(F.col(c).alias("name" if c == "repo" else c) for c in REPOSITORY_FACTS)).alias("repository"))
    return shown.join(facts, "repo", "left")
