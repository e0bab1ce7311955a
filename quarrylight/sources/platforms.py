"""Hosted services as typed tables: repositories, languages, people, groups, merged changes and their counts.

Each reader takes the names it is to read and a base address, and gives the rows of all of them with the name in `key`;
rows that lack what names them are dropped as malformed. `errors` gives what failed. The order of a list is kept in
`seq`. Names are a list, dealt to partitions, `per_task` to each; what is read of repositories takes a table of them
(`full_name`), too, whose own tasks then read, `at_once` of them.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import history, targets
from . import endpoints as E
from . import hosted, run_dir

#: How each platform pages its lists and takes its token.
STYLE = {"github": {"style": "link", "auth": "bearer"}, "gitlab": {"style": "number", "auth": "private"}}


def lists(spark: SparkSession, platform: str, chains: Iterable[tuple[str, list[str]]], **options: object) -> DataFrame:
    """The items of lists: each name with a chain of addresses, the first that is neither missing nor empty counts."""
    return hosted.load(spark, hosted.Hosted, (f"{key}\t{' '.join(chain)}" for key, chain in chains), **(STYLE[platform] | options))


def _of(spark: SparkSession, platform: str, base: str, names: Iterable[str] | DataFrame, what: str, style: str | None = None, at_once: int = 8, **options: object) -> DataFrame:
    """The lists or documents of repositories: languages, contributors, members."""
    options = STYLE[platform] | options | ({"style": style} if style else {})
    make = E.github if platform == "github" else E.gitlab
    if not isinstance(names, DataFrame):
        return hosted.load(spark, hosted.Hosted, (f"{n}\t{make(base, what, n)}" for n in names), **options)
    before, after = make(base, what, "\0").replace("%00", "\0").split("\0")
    name = F.col("full_name") if platform == "github" else S.percent_encoded(F.col("full_name"))
    lines = names.select(F.concat("full_name", F.lit("\t" + before), name, F.lit(after)).alias("line")).repartition(at_once)
    return hosted.fetched(lines, **options)


def errors(rows: DataFrame) -> DataFrame:
    """What failed: (key, error)."""
    return rows.where("error is not null").select("key", "error")


def typed(rows: DataFrame, schema: str, named: str) -> DataFrame:
    """Items as columns; those without a value in `named` are malformed and go."""
    items = rows.where("error is null").select("key", "seq", F.from_json("item", schema).alias("x")).select("key", "seq", "x.*")
    return items.where(F.col(named).isNotNull() & (F.col(named).cast("string") != ""))


def repositories(spark: SparkSession, platform: str, base: str, names: Iterable[str], archived: str = "all", **options: object) -> DataFrame:
    """The repositories of organisations or groups as targets (platform, org, full_name, ...), as the service orders them.

    On GitHub a name is an organisation, or else a user. `archived`: all, none of those or only those.
    """
    chain = (lambda n: [E.github(base, "org_repos", n), E.github(base, "user_repos", n)]) if platform == "github" else (lambda n: [E.gitlab(base, "group_projects", n)])
    return _targets(lists(spark, platform, ((n, chain(n)) for n in names), **options), platform, F.col("key"), archived)


def accessible(spark: SparkSession, platform: str, base: str, affiliation: str = "owner,collaborator,organization_member", archived: str = "all", **options: object) -> DataFrame:
    """The repositories that the token reaches; on GitLab in order of their path."""
    url = E.github(base, "accessible", affiliation=affiliation) if platform == "github" else E.gitlab(base, "accessible")
    return _targets(lists(spark, platform, [("", [url])], **options), platform, None, archived)


def repository(spark: SparkSession, platform: str, base: str, names: Iterable[str], **options: object) -> DataFrame:
    """Single repositories by full name."""
    address = (lambda n: E.github(base, "repo", n)) if platform == "github" else (lambda n: E.gitlab(base, "project", n))
    rows = lists(spark, platform, ((n, [address(n.strip("/"))]) for n in names), **(options | {"style": "document"}))
    return _targets(rows, platform, None, "all")


def _targets(rows: DataFrame, platform: str, org: Column | None, archived: str) -> DataFrame:
    if platform == "github":
        out = typed(rows, schemas.GITHUB_REPO, "full_name").withColumn("size_kb", F.coalesce(F.col("size").cast("long"), F.lit(0)))
    else:
        out = typed(rows, schemas.GITLAB_PROJECT, "path_with_namespace").withColumnRenamed("path_with_namespace", "full_name")
        out = out.withColumn("size_kb", F.floor(F.col("statistics.repository_size") / 1024).cast("long")).withColumn("language", F.lit(""))
    first = F.get(F.split("full_name", "/", 2), F.lit(0))
    out = targets.active(out, archived).withColumn("org", first if org is None else org)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    kept = ["id", F.coalesce("archived", F.lit(False)).alias("archived"), "size_kb", text("default_branch"), F.coalesce("created_at", F.lit("")).alias("repo_created_at"), F.coalesce("language", F.lit("")).alias("primary_language")]
    return out.select(F.lit(platform).alias("platform"), "org", "full_name", "seq", *kept).orderBy("org", "seq")


def choices(repos: DataFrame) -> DataFrame:
    """What a list to choose from shows of repositories: id, name, archived."""
    return repos.select(F.col("full_name").alias("id"), F.col("full_name").alias("name"), "archived")


def organisations(spark: SparkSession, platform: str, base: str, **options: object) -> DataFrame:
    """(id, name) of what the token sees: on GitHub its own user, then its organisations as listed; on GitLab its
    groups by name, whatever the case."""
    if platform == "gitlab":
        groups = typed(lists(spark, platform, [("", [E.gitlab(base, "groups")])], **options), schemas.GROUP, "full_path")
        return groups.select(F.col("full_path").alias("id"), F.coalesce("name", "full_path").alias("name")).orderBy(F.lower("name"), "id")
    own = typed(lists(spark, platform, [("0", [E.github(base, "user")])], **(options | {"style": "document"})), schemas.ACCOUNT, "login")
    orgs = typed(lists(spark, platform, [("1", [E.github(base, "orgs")])], **options), schemas.ACCOUNT, "login")
    return own.unionByName(orgs).orderBy("key", "seq").select(F.col("login").alias("id"), F.col("login").alias("name"))


def installations(spark: SparkSession, base: str, **options: object) -> DataFrame:
    """The installations of an app: installation_id, account_login, account_type, repository_selection, suspended_at."""
    rows = typed(lists(spark, "github", [("", [E.github(base, "installations")])], **options), schemas.INSTALLATION, "id")
    return targets.installations_view(rows.select(
        F.col("id").alias("installation_id"), F.col("account.login").alias("account_login"), F.col("account.type").alias("account_type"), "repository_selection", "suspended_at",
    ))


def installation_label(found: DataFrame, installation_id: int) -> DataFrame:
    """The account of an installation, for the log: one row, `unknown` where the id is not listed."""
    one = found.where(F.col("installation_id") == installation_id).agg(F.coalesce(F.first("account_login", ignorenulls=True), F.lit("unknown")).alias("label"))
    return one


def read_languages(spark: SparkSession, platform: str, base: str, names: Iterable[str] | DataFrame, **options: object) -> DataFrame:
    """The languages of repositories, one document each."""
    return _of(spark, platform, base, names, "languages", "document", **options)


def read_people(spark: SparkSession, platform: str, base: str, names: Iterable[str] | DataFrame, **options: object) -> DataFrame:
    """Contributors of GitHub repositories, anonymous ones too; members of GitLab projects, inherited ones too."""
    return _of(spark, platform, base, names, "contributors" if platform == "github" else "members", **options)


def as_languages(rows: DataFrame) -> DataFrame:
    """(full_name, map_pos, language, value): bytes or percent of each language, in the order of the source."""
    held = rows.where("error is null").select(F.col("key").alias("full_name"), F.from_json("item", "map<string,double>").alias("m"))
    return held.select("full_name", F.posexplode(F.map_entries("m")).alias("map_pos", "e")).select("full_name", "map_pos", F.col("e.key").alias("language"), F.col("e.value").alias("value"))


def as_people(rows: DataFrame, platform: str) -> DataFrame:
    """(repo, seq, login, type, contributions)."""
    if platform == "github":
        people = rows.where("error is null").select("key", "seq", F.from_json("item", schemas.ACCOUNT).alias("x")).select("key", "seq", "x.*")
        return people.select(F.col("key").alias("repo"), "seq", F.coalesce("login", "name").alias("login"), "type", "contributions")
    members = typed(rows, schemas.MEMBER, "username")
    return members.select(F.col("key").alias("repo"), "seq", F.col("username").alias("login"), F.lit("User").alias("type"), F.lit(None).cast("long").alias("contributions"))


def languages(spark: SparkSession, platform: str, base: str, names: Iterable[str] | DataFrame, **options: object) -> DataFrame:
    return as_languages(read_languages(spark, platform, base, names, **options))


def contributors(spark: SparkSession, platform: str, base: str, names: Iterable[str] | DataFrame, **options: object) -> DataFrame:
    return as_people(read_people(spark, platform, base, names, **options), platform)


def merged_prs(spark: SparkSession, endpoint: str, names: Iterable[str], since: str | None = None, until: str | None = None, **options: object) -> DataFrame:
    """Merged pull requests with all their lists; a bound on the time of the merge ends the paging early.

    `since` and `until` are ISO texts as the service writes them, both included.
    """
    rows = hosted.load(spark, hosted.MergedChanges, names, endpoint=endpoint, **options).where("error is null")
    if since:
        rows = rows.where(F.col("merged_at") >= since)
    if until:
        rows = rows.where(F.col("merged_at") <= until)
    return run_dir.with_flags(rows.select("repo", F.from_json("item", schemas.MERGED_PRS).alias("x")).select("repo", "x.*"))


def merged_requests(spark: SparkSession, base: str, names: Iterable[str], at_once: int = 8, **options: object) -> DataFrame:
    """Merged requests of GitLab projects with details, notes and changes; a part that can't be read is left out.

    What is listed stays distributed: `at_once` tasks read the parts of the requests that they hold.
    """
    listed = typed(lists(spark, "gitlab", ((n, [E.gitlab(base, "merged", n)]) for n in names), **options), schemas.MERGE_REQUEST, "iid")
    key = F.concat("key", F.lit("!"), F.col("iid").cast("string"))
    item = F.concat(F.lit(f"{base}/projects/"), S.percent_encoded(F.col("key")), F.lit("/merge_requests/"), F.col("iid").cast("string"))

    def part(what: str, style: str) -> DataFrame:
        lines = listed.select(F.concat(key, F.lit("\t"), item, F.lit(what)).alias("line")).repartition(at_once)
        rows = hosted.fetched(lines, **(STYLE["gitlab"] | options | {"style": style})).where("error is null")
        at = F.length("key") - F.instr(F.reverse("key"), "!")
        return rows.select(F.left("key", at).alias("repo"), F.expr("substr(key, length(key) - instr(reverse(key), '!') + 2)").cast("long").alias("iid"), "seq", "item")

    detail = part("", "document").select("repo", "iid", F.from_json("item", schemas.MERGE_REQUEST).alias("x")).select("repo", "iid", "x.state", "x.title", "x.merged_at", "x.updated_at", "x.author")
    notes = part("/notes", "number").select("repo", "iid", "seq", F.col("item").alias("note"))
    changes = part("/changes", "document").select("repo", "iid", F.explode(F.from_json(F.get_json_object("item", "$.changes"), "array<string>")).alias("change"))
    return history.enrich_requests(listed.withColumnRenamed("key", "repo").drop("seq"), detail, notes, changes, keys=("repo", "iid"))


def merged_totals(repos: DataFrame, platform: str, base: str, at_once: int = 8, **options: object) -> DataFrame:
    """(repo, merged, told, error) of a table of repositories (`full_name`): its own tasks ask."""
    if platform == "github":
        line = F.col("full_name")
    else:
        line = F.concat("full_name", F.lit(f"\t{base}/projects/"), S.percent_encoded(F.col("full_name")), F.lit("/merge_requests?state=merged"))
    lines = repos.select(line.alias("line")).repartition(at_once)
    return hosted.fetched(lines, hosted.MergedCounts, platform=platform, endpoint=base, **(STYLE[platform] | options))


def merged_counts(spark: SparkSession, platform: str, base: str, names: Iterable[str], since: str | None = None, until: str | None = None, **options: object) -> DataFrame:
    """(repo, merged, told, error): merged changes of each repository, without fetching them where the service tells the number.

    GitHub tells the total; with bounds on the time of the merge the changes are scanned, from the newest update down
    to the lower bound. GitLab tells the length of a list, which bounds narrow by the time of the update.
    """
    if platform == "gitlab":
        bound = (f"&updated_after={since}" if since else "") + (f"&updated_before={until}" if until else "")
        lines = (f"{n}\t{E.gitlab(base, 'merged', n)}{bound}" for n in names)
        return hosted.load(spark, hosted.MergedCounts, lines, platform=platform, **(STYLE[platform] | options))
    if not since and not until:
        return hosted.load(spark, hosted.MergedCounts, names, platform=platform, endpoint=base, **options)
    rows = hosted.load(spark, hosted.MergedChanges, names := list(names), endpoint=base, **(options | ({"since": since} if since else {})))
    fits = F.col("merged_at").isNotNull() & ((F.col("merged_at") >= since) if since else F.lit(True)) & ((F.col("merged_at") <= until) if until else F.lit(True))
    found = rows.groupBy("repo").agg(F.count_if(fits).alias("merged"), F.max("error").alias("error"))
    every = spark.createDataFrame([(n,) for n in names], "repo string").join(found, "repo", "left")
    return every.select("repo", F.when(F.col("error").isNull(), F.coalesce("merged", F.lit(0))).alias("merged"), F.lit(False).alias("told"), "error")


def facts(repos: DataFrame, people: DataFrame, merged: DataFrame) -> DataFrame:
    """What a hosted service knows of each repository, for the summary: from targets, contributors and counts."""
    known = repos.select(F.col("full_name").alias("repo"), "repo_created_at", "primary_language", "size_kb", "default_branch")
    n = people.groupBy("repo").agg(F.count(F.lit(1)).alias("contributor_count"))
    count = merged.select("repo", F.col("merged").alias("merged_prs"))
    out = known.join(n, "repo", "left").join(count, "repo", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("contributor_count", "merged_prs")})


def is_bot(people: DataFrame) -> DataFrame:
    """People with whether each is a bot, by kind or login."""
    return people.withColumn("is_bot", P.is_bot_login(F.col("login"), F.col("type")))
