"""From clones or a hosted service to the files of a run: raw rows, summary, failures, manifest."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history, targets
from ..schemas import COMMITS, FILES
from ..sources import local, platforms, sinks
from . import summary as plan


def written(rows: DataFrame, path: str) -> DataFrame:
    """Rows written as Parquet and read back: a clone is read once, whatever is made of its rows."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_clones(spark: SparkSession, root: str, raw: str, **options: object) -> tuple[dict[str, DataFrame], DataFrame]:
    """The rows of all clones below `root` (commits, texts, files, facts), kept in `raw`, and the errors of all readers."""
    counter = options.pop("counter", None)
    readers = {
        "facts": (local.clone_facts, plan.GIT), "commits": (local.commit_lines, plan.GIT),
        "texts": (local.commit_records, plan.LINES), "files": (local.files, plan.TREE),
    }
    if counter:
        readers["lines"] = (lambda *a, **o: local.line_counts(*a, counter=counter, **o), plan.LINES)
    parts = {name: local.routed(written(read(spark, root, **options), f"{raw}/{name}"), stage) for name, (read, stage) in readers.items()}
    data = {name: rows for name, (rows, _) in parts.items()}
    data["commits"] = history.commits_of_lines(data["commits"])
    data["texts"] = history.commits_of_records(data["texts"])
    return data, reduce(DataFrame.unionByName, (bad for _, bad in parts.values()))


def read_hosted(spark: SparkSession, platform: str, base: str, names: Iterable[str], raw: str, graphql: str = "", **options: object) -> tuple[dict[str, DataFrame], DataFrame]:
    """What a hosted service tells of the repositories of `names`, kept in `raw`: targets, facts, languages; and the errors.

    The list of repositories is read first; the tasks that hold it read what belongs to each. `graphql` is the address
    that tells GitHub's totals.
    """
    repos = written(platforms.repositories(spark, platform, base, names, **options), f"{raw}/repositories")
    langs = written(platforms.read_languages(spark, platform, base, repos, **options), f"{raw}/languages")
    people = written(platforms.read_people(spark, platform, base, repos, **options), f"{raw}/people")
    merged = written(platforms.merged_totals(repos, platform, graphql or base, **options), f"{raw}/merged")
    failed = [platforms.errors(x).withColumnRenamed("key", "repo") for x in (langs, people)] + [merged.where("error is not null").select("repo", "error")]
    errors = reduce(DataFrame.unionByName, failed).select("repo", F.lit(plan.HOSTED).alias("stage"), "error")
    facts = platforms.facts(repos, platforms.as_people(people, platform), merged)
    return {"targets": repos, "facts": facts, "languages": platforms.as_languages(langs)}, errors


def profile_hosted(spark: SparkSession, platform: str, base: str, names: Iterable[str], out: str, as_of: Column, clones: str = "", graphql: str = "", created_at: str = "", **options: object) -> DataFrame:
    """Profile the repositories of organisations or groups and write the run's files to `out`; returns the summary's rows.

    `clones` is a folder in which they lie under their full names, if they are cloned; without it there are only the
    service's facts. A repository of which a part can't be read is a row with its error.
    """
    told, errors = read_hosted(spark, platform, base, names, f"{out}/raw", graphql, **options)
    empty = lambda form: spark.createDataFrame([], form)
    data = {"commits": empty(COMMITS), "texts": empty(COMMITS), "files": empty(FILES)}
    if clones:
        data, more = read_clones(spark, clones, f"{out}/raw")
        errors = errors.unionByName(more)
    lines = empty("repo string, language string, code long")
    rows = plan.summary(told["targets"], data["commits"], data["files"], told["languages"], lines, as_of, errors, data["texts"], told["facts"])
    return _put(rows, out, created_at)


def _put(rows: DataFrame, out: str, created_at: str) -> DataFrame:
    """Write the summary, the failures and the manifest of a run."""
    rows = written(rows, f"{out}/raw/summary")
    sinks.write_summary(rows, f"{out}/summary.csv")
    sinks.write_failures(rows, f"{out}/failures.json")
    told = sinks.manifest(rows, created_at, summary_csv=f"{out}/summary.csv", failures_json=f"{out}/failures.json")
    rows.sparkSession.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest.json")
    return rows


def profile_clones(spark: SparkSession, root: str, out: str, as_of: Column, root_name: str = "local", created_at: str = "", **options: object) -> DataFrame:
    """Profile all clones below `root` and write the run's files to `out`; returns the rows of the summary.

    The option `counter` names a program that counts lines of code; without it there are none. `summary.csv`,
    `failures.json` and the raw rows are written, and `manifest.json` with the run's counts. A clone that can't be
    read is a row with its error. Without clones the summary is empty.
    """
    data, errors = read_clones(spark, root, f"{out}/raw", **options)
    paths = data["facts"].select("repo").union(errors.select("repo")).distinct().withColumnRenamed("repo", "path")
    found = targets.local_targets(paths, F.lit(root_name))
    named = lambda df: df.join(found.select(F.col("path").alias("repo"), "full_name"), "repo").drop("repo").withColumnRenamed("full_name", "repo")
    lines = named(data["lines"]) if "lines" in data else spark.createDataFrame([], "repo string, language string, code long")
    none = spark.createDataFrame([], "full_name string, map_pos int, language string, value double")
    rows = plan.summary(
        found, named(data["commits"]), named(data["files"]), none, lines, as_of, named(errors), named(data["texts"]),
    ).drop("default_branch")
    branch = named(data["facts"]).select("repo", F.coalesce("default_branch", F.lit("")).alias("default_branch"))
    return _put(plan.fill(rows.join(branch, "repo", "left")).orderBy("org", "repo"), out, created_at)
