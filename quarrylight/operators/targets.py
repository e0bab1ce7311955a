"""Targets and selections: unions, first-wins, selectors, path ancestors, what is there already."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .history import first_by


def union_targets(*branches: DataFrame) -> DataFrame:
    """All branches (platform, full_name, pos, ...) in their order; of a target, the first stays."""
    parts = [b.withColumn("branch", F.lit(k)) for k, b in enumerate(branches)]
    return first_by(reduce(DataFrame.unionByName, parts), ["platform", "full_name"], F.col("branch"), F.col("pos"))


def merge_selectors(*groups: DataFrame) -> DataFrame:
    """Selectors (pos, selector) of all groups without blanks; of spellings that differ in case, the first stays."""
    parts = [g.select(F.lit(k).alias("branch"), "pos", F.trim("selector").alias("selector")) for k, g in enumerate(groups)]
    rows = reduce(DataFrame.unionByName, parts).where("selector <> ''").withColumn("key", F.lower("selector"))
    return first_by(rows, ["key"], F.col("branch"), F.col("pos")).drop("key")


def select_targets(targets: DataFrame, selectors: DataFrame) -> DataFrame:
    """Targets that a selector names: in full, by a suffix that begins at a slash, or all if there are no selectors.

    A target's suffixes are its keys, so this is an equi-join whatever the number of selectors. Selectors that name no
    target at all are an error, which the job raises that reads the result: how many selectors and hits there are is
    one row of the plan, and no job runs while it is made.
    """
    wanted = selectors.select(F.lower(F.trim("selector")).alias("__key")).where("__key <> ''").distinct()
    parts = F.split(F.lower("full_name"), "/")
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(parts, k, n), "/"))
    keyed = targets.withColumn("__id", F.struct("platform", "full_name"))
    hits = keyed.select("__id", F.explode(suffixes).alias("__key")).join(wanted, "__key", "left_semi").select("__id").distinct()
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("__one", F.lit(1))
    told = count(wanted, "__wanted").join(count(hits, "__hits"), "__one")
    marked = keyed.join(hits.withColumn("__hit", F.lit(True)), "__id", "left").withColumn("__one", F.lit(1)).join(F.broadcast(told), "__one")  # one row
    none = F.raise_error(F.lit("the selectors match no target")).cast("boolean")
    keep = F.when(F.col("__wanted") == 0, True).when(F.col("__hits") == 0, none).otherwise(F.coalesce("__hit", F.lit(False)))
    return marked.where(keep).select(*targets.columns)


def top_level(groups: DataFrame, column: str = "id") -> DataFrame:
    """Groups that no other group is an ancestor of; equal groups count once.

    A path's ancestors are its keys, so this is an anti-join on equality, not on prefixes.
    """
    rows = groups.select(column).distinct()
    parts = F.split(column, "/")
    n = F.size(parts)
    above = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))
    covered = rows.select(column, F.explode(above).alias("__up")).join(rows.select(F.col(column).alias("__up")), "__up", "left_semi").select(column).distinct()
    return rows.join(covered, column, "left_anti")


def missing_targets(targets: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Targets that are not present yet."""
    return targets.join(present.select(key).distinct(), key, "left_anti")


def clone_stats(outcomes: DataFrame) -> DataFrame:
    """Outcomes (target, outcome) counted per target: listed, cloned, skipped, failed."""
    of = lambda what: F.count_if(F.col("outcome") == what).alias(what)
    return outcomes.groupBy("target").agg(F.count(F.lit(1)).alias("listed"), of("cloned"), of("skipped"), of("failed"))


def find_installation(installations: DataFrame, login: str) -> DataFrame:
    """The first installation of an account, whatever the case of its name."""
    return installations.where(F.lower("account_login") == login.lower()).orderBy("installation_id").limit(1)


def installations_view(installations: DataFrame) -> DataFrame:
    return installations.select("installation_id", "account_login", "account_type", "repository_selection", "suspended_at")


def active(repos: DataFrame, archived: str = "none") -> DataFrame:
    """Repositories by whether they are archived: 'none' of those, 'only' those, or 'all'."""
    flag = F.coalesce(F.col("archived"), F.lit(False))
    return repos if archived == "all" else repos.where(flag if archived == "only" else ~flag)


def config(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, value) of lines `key=value`, without comments; the first equals sign splits."""
    text = F.trim(column)
    rows = lines.where((text != "") & ~text.startswith("#") & F.contains(text, F.lit("=")))
    parts = F.split(text, "=", 2)
    return rows.select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def local_targets(paths: DataFrame, root_name: Column) -> DataFrame:
    """Targets of local clones, from their paths below the root, ordered by full name whatever its case."""
    return paths.select(F.lit("local").alias("platform"), S.org_of_path(root_name, F.col("path")).alias("t"), "path").select("platform", "t.*", "path").orderBy(F.lower("full_name"))
