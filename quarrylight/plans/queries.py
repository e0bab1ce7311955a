"""Every operator as a registered query over the test tables, with its SQL twin.

Binding: region = organisation, nation = repository, orders = commits, customer = author (segment MACHINERY = bot),
lineitem = numstat lines, part and documents = files, events = log lines (error = failed, purchase = ended well,
signup = squash), conversations = review threads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import history, progress, targets, trees
from ..registry import query
from ..session import table
from ..sources import platforms
from . import classify

BOT = "MACHINERY"


def _commits(spark, d) -> DataFrame:
    """orders with author and repository: the facts of a commit."""
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    people = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows, whatever the scale
    return table(spark, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"))


_COMMITS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_DAYS = "CAST(floor((epoch_us({b}) - epoch_us({a})) / 86400000000.0) AS BIGINT)"


@query(
    "repo_git_stats",
    f"""
    WITH g AS (
        SELECT r_name AS org, n_name AS repo, count(*) AS total_commits, min(o_orderdate) AS f, max(o_orderdate) AS l,
            count(DISTINCT o_custkey) AS authors, count(*) FILTER (c_mktsegment = '{BOT}') AS bot_commit_count
        FROM {_COMMITS} GROUP BY ALL)
    SELECT org, repo, total_commits, strftime(f, '%Y-%m-%d') AS first_commit, strftime(l, '%Y-%m-%d') AS last_commit,
        {_DAYS.format(a="f", b="l")} AS span_days, authors, bot_commit_count,
        CAST(min(year(f)) OVER (PARTITION BY org) AS VARCHAR) || '–' || CAST(max(year(l)) OVER (PARTITION BY org) AS VARCHAR) AS company_period
    FROM g""",
)
def repo_git_stats(spark, d):
    rows = _stats(spark, d, 50).join(F.broadcast(_repos(spark, d)), "repo").withColumnRenamed("last_commit", "last_commit_date")
    people = (F.col("human_authors") + F.col("bot_authors")).alias("authors")
    return history.company_periods(rows).select(
        "org", "repo", "total_commits", F.left("first_commit", F.lit(10)).alias("first_commit"), F.left("last_commit_date", F.lit(10)).alias("last_commit"), "span_days", people, "bot_commit_count", "company_period"
    )


_LOG = f"""
    c AS (
        SELECT n_name AS repo, o_orderkey AS sha, o_orderpriority AS p, strftime(o_orderdate, '%Y-%m-%d') AS author_date, o_orderdate AS t,
            row_number() OVER w AS log_pos, lead(o_orderkey) OVER w AS one, lead(o_orderkey, 2) OVER w AS two
        FROM {_COMMITS} WINDOW w AS (PARTITION BY n_name ORDER BY o_orderkey DESC)),
    e AS (
        SELECT *, list_filter(CASE p WHEN '1-URGENT' THEN [] WHEN '2-HIGH' THEN [one, two] ELSE [one] END, lambda x: x IS NOT NULL) AS parents FROM c)"""


def _graph(spark, d) -> DataFrame:
    """The same commits as a graph: a commit's parent is the one before it, a 2-HIGH one merges the two before it, a
    1-URGENT one is a root."""
    rows = _commits(spark, d)
    w = Window.partitionBy("n_name").orderBy(F.desc("o_orderkey"))
    near = rows.withColumn("log_pos", F.row_number().over(w)).withColumn("one", F.lead("o_orderkey").over(w)).withColumn("two", F.lead("o_orderkey", 2).over(w))
    kind = F.col("o_orderpriority")
    parents = F.when(kind == "1-URGENT", F.array().cast("array<bigint>")).when(kind == "2-HIGH", F.array_compact(F.array("one", "two"))).otherwise(F.array_compact(F.array("one")))
    name, email = F.col("c_name"), F.col("c_custkey").cast("string")
    return near.select(
        F.col("n_name").alias("repo"), "log_pos", F.col("o_orderkey").cast("string").alias("sha"), parents.cast("array<string>").alias("parents"),
        name.alias("author_name"), email.alias("author_email"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("author_date"),
    )


@query(
    "commit_graph",
    f"""
    WITH {_LOG},
    x AS (SELECT DISTINCT repo, unnest(parents) AS sha FROM e),
    n AS (SELECT repo, count(*) AS commits, count(*) FILTER (len(parents) = 0) AS roots, count(*) FILTER (len(parents) > 1) AS merges FROM e GROUP BY repo),
    t AS (SELECT repo, count(*) AS tips FROM e ANTI JOIN x USING (repo, sha) GROUP BY repo)
    SELECT repo, commits, roots, merges, coalesce(tips, 0) AS tips FROM n LEFT JOIN t USING (repo)""",
)
def commit_graph(spark, d):
    return history.graph_facts(_graph(spark, d))


@query(
    "first_and_last_commit",
    f"""
    WITH {_LOG}
    SELECT repo, arg_min(author_date, log_pos) FILTER (len(parents) = 0) AS first_commit, arg_min(author_date, log_pos) AS last_commit,
        date_diff('day', arg_min(t, log_pos) FILTER (len(parents) = 0), arg_min(t, log_pos)) AS span_days
    FROM e GROUP BY repo""",
)
def first_and_last_commit(spark, d):
    return history.git_stats(_graph(spark, d), F.lit("2000-01-01").cast("timestamp")).select("repo", "first_commit", "last_commit", "span_days")


@query(
    "company_period",
    f"""
    WITH g AS (SELECT r_name AS org, n_name AS repo, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM {_COMMITS} GROUP BY ALL),
    w AS (SELECT org, repo, min(a) OVER (PARTITION BY org) AS a, max(b) OVER (PARTITION BY org) AS b FROM g)
    SELECT org, repo, CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '–' || CAST(b AS VARCHAR) END AS company_period FROM w""",
)
def company_period(spark, d):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    g = _commits(spark, d).groupBy(F.col("r_name").alias("org"), F.col("n_name").alias("repo")).agg(F.min("o_orderdate").alias("f"), F.max("o_orderdate").alias("l"))
    return history.company_periods(g.select("org", "repo", day("f").alias("first_commit"), day("l").alias("last_commit_date"))).select("org", "repo", "company_period")


def _repos(spark, d) -> DataFrame:
    """(org, repo): 25 rows, whatever the scale."""
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("org"), F.col("n_name").alias("repo"))


def _authored(spark, d) -> DataFrame:
    """The same commits as a clone gives them: repo, author_name, author_email, author_date; bots by their name."""
    name = F.concat("c_name", F.when(F.col("c_mktsegment") == BOT, F.lit(" renovate")).otherwise(F.lit("")))
    email = F.concat(F.col("c_custkey").cast("string"), F.lit("@people.org"))
    return _commits(spark, d).select(F.col("n_name").alias("repo"), name.alias("author_name"), email.alias("author_email"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("author_date"))


_AUTHOR = f"c_name || CASE WHEN c_mktsegment = '{BOT}' THEN ' renovate' ELSE '' END"


@query(
    "author_tally",
    f"""SELECT n_name AS repo, {_AUTHOR} AS author_name, c_custkey || '@people.org' AS author_email, count(*) AS commits,
        coalesce(c_mktsegment = '{BOT}', false) AS is_bot FROM {_COMMITS} GROUP BY ALL""",
)
def author_tally(spark, d):
    return history.author_tally(_authored(spark, d))


def _stats(spark, d, top: int) -> DataFrame:
    return history.git_stats(_authored(spark, d), F.lit("2000-01-01").cast("timestamp"), top)


@query(
    "bot_ratio",
    f"""SELECT n_name AS repo, count(*) AS commits, count(*) FILTER (c_mktsegment = '{BOT}') AS bot_commits,
        CAST(printf('%.4f', count(*) FILTER (c_mktsegment = '{BOT}') / count(*)) AS DOUBLE) AS bot_commit_ratio, count(DISTINCT o_custkey) AS contributor_count FROM {_COMMITS} GROUP BY ALL""",
)
def bot_ratio(spark, d):
    people = F.col("human_authors") + F.col("bot_authors")
    return _stats(spark, d, 50).select("repo", F.col("total_commits").alias("commits"), F.col("bot_commit_count").alias("bot_commits"), "bot_commit_ratio", people.alias("contributor_count"))


def _top(spark, d, n):
    rows = history.top_authors(history.author_tally(_authored(spark, d)), n)
    return rows.select("repo", F.col("author_name").alias("author"), "commits", F.col("rank").cast("long").alias("rank"))


_TOP = (
    f"SELECT repo, author, commits, rank FROM (SELECT n_name AS repo, {_AUTHOR} AS author, count(*) AS commits, "
    f"row_number() OVER (PARTITION BY n_name ORDER BY count(*) DESC, {_AUTHOR}, o_custkey || '') AS rank FROM {_COMMITS} GROUP BY n_name, {_AUTHOR}, o_custkey) WHERE rank <= "
)


@query("top_authors", _TOP + "50")
def top_authors(spark, d):
    return _top(spark, d, 50)


@query("top_authors_small", _TOP + "5")
def top_authors_small(spark, d):
    return _top(spark, d, 5)


@query("commit_churn", "SELECT l_orderkey AS sha, CAST(sum(l_quantity) AS BIGINT) AS additions, CAST(sum(l_linenumber) AS BIGINT) AS deletions, count(*) AS files FROM lineitem GROUP BY 1")
def commit_churn(spark, d):
    items = table(spark, d, "lineitem")
    fields = F.concat_ws(history.FIELD, F.col("l_orderkey").cast("string"), F.lit(""), F.lit("A"), F.lit("a@x"), F.lit("2024-01-01"), F.lit("Work"))
    heads = items.select("l_orderkey").distinct().select(F.lit("all").alias("repo"), (F.col("l_orderkey") + 1).alias("log_pos"), F.lit(0).cast("long").alias("line_no"), F.concat(F.lit(history.HEADER), fields).alias("line"))
    stat = F.concat_ws("\t", F.col("l_quantity").cast("long"), F.col("l_linenumber"), F.col("l_partkey"))
    rows = items.select(F.lit("all").alias("repo"), (F.col("l_orderkey") + 1).alias("log_pos"), F.col("l_linenumber").cast("long").alias("line_no"), stat.alias("line"))
    commits = history.commits_of_lines(heads.unionByName(rows))
    return commits.select(F.col("sha").cast("long").alias("sha"), "additions", "deletions", F.size("files").cast("long").alias("files"))


@query("commit_files_nested", "SELECT l_orderkey AS sha, count(*) AS files, CAST(sum(l_quantity) AS BIGINT) AS additions, CAST(sum(l_linenumber) AS BIGINT) AS deletions FROM lineitem GROUP BY 1")
def commit_files_nested(spark, d):
    item = F.struct(F.col("l_partkey").cast("string").alias("path"), F.col("l_quantity").cast("long").alias("additions"), F.col("l_linenumber").cast("long").alias("deletions"))
    nested = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sha")).agg(F.collect_list(item).alias("files"))
    with_names = nested.withColumn("author_name", F.lit("")).withColumn("author_email", F.lit(""))
    return history.with_churn(with_names).select("sha", F.size("files").cast("long").alias("files"), "additions", "deletions")


@query("loc_by_language", "SELECT p_type AS language, CAST(sum(p_size) AS BIGINT) AS code, CAST(sum(sum(p_size)) OVER () AS BIGINT) AS loc FROM part GROUP BY 1")
def loc_by_language(spark, d):
    counts = table(spark, d, "part").select(F.lit("all").alias("repo"), F.col("p_type").alias("language"), F.col("p_size").alias("code"))
    return trees.lines_by_language(counts).drop("repo")


_LANG = "SELECT source AS repo, lang AS language, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY ALL"


def _languages(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.col("source").alias("full_name"), F.col("lang").alias("language")).agg(F.sum("n_chars").alias("value"))


@query(
    "language_breakdown",
    f"""
    WITH g AS ({_LANG}), t AS (SELECT *, sum(size) OVER (PARTITION BY repo) AS total FROM g)
    SELECT repo, string_agg(language || ':' || printf('%.1f', 100.0::DOUBLE * size / total) || '%', '; ' ORDER BY size DESC, language) AS languages FROM t GROUP BY repo""",
)
def language_breakdown(spark, d):
    shares = trees.language_shares(_languages(spark, d).withColumn("map_pos", F.lit(0)))
    return shares.select(F.col("full_name").alias("repo"), F.col("languages_breakdown").alias("languages"))


@query("primary_language", f"SELECT repo, arg_min(language, (-size, language)) AS primary_language FROM ({_LANG}) GROUP BY repo")
def primary_language(spark, d):
    shares = trees.language_shares(_languages(spark, d).withColumn("map_pos", F.lit(0)), by_name=True)
    return shares.select(F.col("full_name").alias("repo"), "primary_language")


@query("tree_size_kb", "SELECT source AS repo, CAST(sum(n_chars) AS BIGINT) AS size, CAST(sum(n_chars) // 1024 AS BIGINT) AS size_kb FROM documents GROUP BY 1")
def tree_size_kb(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("repo")).agg(F.sum("n_chars").alias("size")).withColumn("size_kb", S.kib(F.col("size")))


@query("file_count", "SELECT source AS repo, count(*) FILTER (lang IS DISTINCT FROM 'de') AS total_files FROM documents GROUP BY 1")
def file_count(spark, d):
    folder = F.when(F.col("lang") == "de", F.lit("node_modules/")).otherwise(F.lit("lib/"))  # vendored files aren't walked
    files = table(spark, d, "documents").select(
        F.col("source").alias("repo"), F.concat(folder, F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("n_chars").alias("bytes"), F.lit(0).cast("long").alias("lines"), F.lit("").alias("sample"),
    )
    return trees.tree_facts(files).select("repo", "total_files")


_LINES = "CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(text) - len(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END"


@query("line_count", f"SELECT doc_id, CAST({_LINES} AS BIGINT) AS lines FROM documents")
def line_count(spark, d):
    return table(spark, d, "documents").select("doc_id", S.line_count(F.col("text")).alias("lines"))


@query(
    "test_source_ratio",
    f"""
    WITH l AS (SELECT source AS repo, lang, {_LINES} AS n FROM documents),
    g AS (SELECT repo, sum(n) FILTER (lang = 'en') AS t, sum(n) FILTER (lang <> 'en') AS s FROM l GROUP BY repo)
    SELECT repo, CASE WHEN s > 0 THEN 100.0::DOUBLE * coalesce(t, 0) / s END AS test_source_loc_pct FROM g""",
)
def test_source_ratio(spark, d):
    n = S.line_count(F.col("text"))
    g = table(spark, d, "documents").groupBy(F.col("source").alias("repo")).agg(F.sum(F.when(F.col("lang") == "en", n)).alias("t"), F.sum(F.when(F.col("lang") != "en", n)).alias("s"))
    return g.select("repo", F.when(F.col("s") > 0, 100.0 * F.coalesce("t", F.lit(0)) / F.col("s")).alias("test_source_loc_pct"))


@query(
    "pr_fold",
    """
    SELECT pr_number, method, log_pos FROM (
        SELECT user_id AS pr_number, CASE WHEN event_type = 'purchase' THEN 'merge-commit' ELSE 'squash' END AS method, event_id AS log_pos,
            row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'purchase' DESC, CASE WHEN event_type = 'purchase' THEN event_id ELSE -event_id END) AS n
        FROM events WHERE event_type IN ('purchase', 'signup')) WHERE n = 1""",
)
def pr_fold(spark, d):
    merge = F.col("event_type") == "purchase"
    subject = F.when(merge, F.concat(F.lit("Merge pull request #"), F.col("user_id"), F.lit(" from a/b"))).otherwise(F.concat(F.lit("Work (#"), F.col("user_id"), F.lit(")")))
    rows = table(spark, d, "events").where(F.col("event_type").isin("purchase", "signup"))
    marked = rows.select(S.merge_marker(subject, F.lit("")).alias("m"), F.col("event_id").alias("log_pos")).select("m.*", "log_pos")
    is_merge = F.col("method") == "merge-commit"
    best = history.first_by(marked, ["pr_number"], F.desc(is_merge), F.when(is_merge, F.col("log_pos")).otherwise(-F.col("log_pos")))
    return best.select(F.col("pr_number").cast("long").alias("pr_number"), "method", "log_pos")


@query("merged_counts_rollup", f"SELECT r_name AS platform, n_name AS repo, count(*) AS merged, CAST(grouping(r_name, n_name) AS BIGINT) AS level FROM {_COMMITS} WHERE o_orderstatus IN ('O', 'F') GROUP BY ROLLUP (r_name, n_name)")
def merged_counts_rollup(spark, d):
    rows = _commits(spark, d).where(F.col("o_orderstatus").isin("O", "F")).select(F.col("r_name").alias("platform"), F.col("n_name").alias("repo"), F.col("o_orderdate").cast("timestamp").alias("merged_at"))
    nothing = F.lit(None).cast("timestamp")
    return history.merged_counts(rows, nothing, nothing)


@query(
    "merged_report",
    f"""
    WITH g AS (
        SELECT r_name AS platform, n_name AS repo, count(*) AS n, grouping(r_name, n_name) AS level FROM {_COMMITS} WHERE o_orderstatus IN ('O', 'F') GROUP BY ROLLUP (r_name, n_name))
    SELECT platform, level, repo, CASE level WHEN 0 THEN '  ' || repo || ': ' || n WHEN 1 THEN '  ' || platform || ' subtotal: ' || n ELSE 'Grand total: ' || n END AS line FROM g""",
)
def merged_report(spark, d):
    from ..sources import sinks

    rows = _commits(spark, d).where(F.col("o_orderstatus").isin("O", "F")).groupBy(F.col("r_name").alias("platform"), F.col("n_name").alias("repo")).agg(F.count(F.lit(1)).alias("merged"))
    return sinks.totals(rows)


@query("merged_in_range", "SELECT o_orderkey AS pr, o_orderdate AS merged_at FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-01-01'")
def merged_in_range(spark, d):
    bound = lambda v: S.parse_bound(F.lit(v)).cast("timestamp_ntz")
    return table(spark, d, "orders").where(S.in_range(F.col("o_orderdate"), bound("1996-01-01"), bound("1997-01-01"))).select(F.col("o_orderkey").alias("pr"), F.col("o_orderdate").alias("merged_at"))


@query("run_ok_failed", "SELECT user_id AS run, count(*) FILTER (event_type = 'purchase') AS ok, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def run_ok_failed(spark, d):
    return progress.progress(_log(spark, d), "run").select("run", F.col("completed").alias("ok"), "failed")


@query("clone_stats", "SELECT user_id AS target, count(*) AS listed, count(*) FILTER (event_type = 'purchase') AS cloned, count(*) FILTER (event_type = 'signup') AS skipped, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1")
def clone_stats(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "cloned").when(F.col("event_type") == "signup", "skipped").when(F.col("event_type") == "error", "failed")
    return targets.clone_stats(table(spark, d, "events").select(F.col("user_id").alias("target"), kind.alias("outcome")))


def _log(spark, d) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    line = F.when(kind == "purchase", F.concat(F.lit("[1/1] OK r/"), n, F.lit(": 1"))).when(kind == "error", F.concat(F.lit("FAIL r/"), n, F.lit(": x"))).when(kind == "signup", F.concat(F.lit("Extracting "), n, F.lit(" repos")))
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.coalesce(line, F.lit("...")).alias("line"))


@query(
    "progress_fold",
    """
    WITH g AS (
        SELECT user_id AS run, coalesce(arg_max(event_id, event_id) FILTER (event_type = 'signup'), 0) AS total, count(*) FILTER (event_type = 'purchase') AS completed,
            count(*) FILTER (event_type = 'error') AS failed, coalesce('r/' || arg_max(event_id, event_id) FILTER (event_type IN ('purchase', 'error')), '') AS current
        FROM events GROUP BY 1)
    SELECT run, CAST(total AS INTEGER) AS total, completed, failed, current, completed + failed AS done,
        CAST(CASE WHEN total > 0 THEN trunc((completed + failed)::DOUBLE / total * 100) ELSE 0 END AS INTEGER) AS percent FROM g""",
)
def progress_fold(spark, d):
    return progress.progress(_log(spark, d), "run")


def _events(spark, d) -> DataFrame:
    """Events of runs: a view names the summary, a click is a run's object, a sale above 250 ends it with its code."""
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    made = F.concat(F.lit('{"run_dir": "/out/'), n, F.lit('", "ok": '), F.length(n).cast("string"), F.lit("}"))
    line = F.when(kind == "view", F.concat(F.lit("Done. summary=/out/"), n, F.lit("/summary.csv"))).when((kind == "click") & (F.col("value") > 100), made)
    ends = (kind == "purchase") & (F.col("value") > 250)
    code = F.when(ends, F.when(F.col("value") > 300, 0).otherwise(1))
    rows = _log(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("seq"), line.alias("more"), ends.alias("ends"), code.alias("returncode")), "seq")
    return rows.select(F.col("run").cast("string").alias("run"), "seq", F.when(~F.col("ends"), F.coalesce("more", "line")).alias("line"), "returncode")


@query(
    "run_state",
    """
    WITH e AS (
        SELECT user_id AS run, event_id AS i, event_type AS k, value, event_type = 'purchase' AND value > 250 AS ends, event_type = 'click' AND value > 100 AS made FROM events),
    g AS (
        SELECT run, count(*) FILTER (k = 'purchase' AND NOT ends) AS completed, count(*) FILTER (k = 'error') AS failed,
            coalesce(max(i) FILTER (k = 'signup'), 0)::INTEGER AS total, max(i) FILTER (k IN ('purchase', 'error') AND NOT ends) AS c,
            max(i) FILTER (k = 'view') AS s, max(i) FILTER (made) AS m, arg_max(CASE WHEN value > 300 THEN 0 ELSE 1 END, i) FILTER (ends) AS code
        FROM e GROUP BY run)
    SELECT run::VARCHAR AS run, CASE WHEN code = 0 THEN 'completed' WHEN code IS NULL THEN 'running' ELSE 'failed' END AS phase, code AS returncode, total, completed, failed,
        CASE WHEN total > 0 THEN trunc((completed + failed)::DOUBLE / total * 100) ELSE 0 END::INTEGER AS percent, coalesce('r/' || c, '') AS current,
        '/out/' || s || '/summary.csv' AS summary_path, '/out/' || coalesce(m, s) AS run_dir, length(m::VARCHAR) AS repos_ok
    FROM g""",
)
def run_state(spark, d):
    states = progress.run_state(_events(spark, d))
    return states.select("run", "phase", "returncode", "total", "completed", "failed", "percent", "current", "summary_path", "run_dir", "repos_ok")


@query("log_tail", "SELECT run, seq FROM (SELECT user_id AS run, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 3")
def log_tail(spark, d):
    return progress.log_tail(_log(spark, d), 3, "run").select("run", "seq")


_FILES = """
    f AS (
        SELECT 'NATION_' || source[4:] AS repo, doc_id, n_chars, text, lang,
            CASE lang WHEN 'de' THEN 'tests/test_' || doc_id || '.py' WHEN 'fr' THEN '.github/workflows/' || doc_id || '.yml' WHEN 'es' THEN 'lib/' || doc_id || '.go' ELSE 'src/' || doc_id || '.py' END AS path
        FROM documents)"""


def _files(spark, d) -> DataFrame:
    """Documents as files: German ones are tests, French ones run them, Spanish ones are a library."""
    n, lang = F.col("doc_id").cast("string"), F.col("lang")
    path = (
        F.when(lang == "de", F.concat(F.lit("tests/test_"), n, F.lit(".py"))).when(lang == "fr", F.concat(F.lit(".github/workflows/"), n, F.lit(".yml")))
        .when(lang == "es", F.concat(F.lit("lib/"), n, F.lit(".go"))).otherwise(F.concat(F.lit("src/"), n, F.lit(".py")))
    )
    return table(spark, d, "documents").select(
        F.concat(F.lit("NATION_"), F.substring("source", F.lit(4), F.length("source"))).alias("repo"), path.alias("path"),
        F.col("n_chars").alias("bytes"), S.line_count(F.col("text")).alias("lines"), F.col("text").alias("sample"), F.col("doc_id"),
    )


@query(
    "detectors",
    f"""
    WITH {_FILES}, l AS (SELECT repo, path, lang, {_LINES} AS n FROM f)
    SELECT repo, bool_or(lang = 'de') AS has_tests, bool_or(lang = 'fr') AS has_ci_cd, bool_or(lang = 'es') AS has_library_code, false AS has_test_runner,
        CASE WHEN sum(n) FILTER (lang IN ('en', 'es')) > 0
            THEN CAST(printf('%.1f', 100.0::DOUBLE * coalesce(sum(n) FILTER (lang = 'de'), 0) / sum(n) FILTER (lang IN ('en', 'es'))) AS DOUBLE) END AS test_source_loc_pct
    FROM l GROUP BY repo""",
)
def detectors(spark, d):
    return trees.tree_facts(_files(spark, d)).select("repo", "has_tests", "has_ci_cd", "has_library_code", "has_test_runner", "test_source_loc_pct")


@query(
    "test_path_predicate",
    """
    WITH p AS (SELECT page_id, lower(replace(replace(url, '/de/', '/Tests/'), '/fr/', '/src/test_')) AS p FROM pages)
    SELECT page_id, len(list_filter(string_split(p, '/'), lambda x: x IN ('test', 'tests', 'spec', 'specs', '__tests__'))) > 0
        OR starts_with(string_split(p, '/')[-1], 'test_') AS strict,
        len(list_filter(string_split(p, '/')[:-2], lambda x: contains(x, 'test') OR contains(x, 'spec'))) > 0 OR starts_with(string_split(p, '/')[-1], 'test_') AS loose
    FROM p""",
)
def test_path_predicate(spark, d):
    path = F.replace(F.replace(F.col("url"), F.lit("/de/"), F.lit("/Tests/")), F.lit("/fr/"), F.lit("/src/test_"))
    return table(spark, d, "pages").select("page_id", P.is_test_path(path).alias("strict"), P.shows_tests(path).alias("loose"))


@query("bot_login", "SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN true WHEN coalesce(role, '') = '' THEN false ELSE contains(lower(role), 'bot') END AS is_bot FROM conversations")
def bot_login(spark, d):
    kind = F.when(F.col("role") == "assistant", "Bot")
    return table(spark, d, "conversations").select("conv_id", "turn", P.is_bot_login(F.col("role"), kind).alias("is_bot"))


@query("slug", "SELECT page_id, regexp_replace(replace(url, '/', '__'), '[^\\w.\\-]+', '_', 'g') AS slug FROM pages")
def slug(spark, d):
    return table(spark, d, "pages").select("page_id", S.repo_slug(F.col("url")).alias("slug"))


@query(
    "path_split",
    """
    WITH p AS (SELECT page_id, string_split(url, '/') AS s FROM pages),
    q AS (SELECT page_id, array_to_string(s[4:], '/') AS path, s[4:] AS s FROM p)
    SELECT page_id, CASE WHEN path = '' THEN 'root' WHEN len(s) >= 2 THEN s[1] ELSE 'root' END AS org, CASE WHEN path = '' THEN 'root' WHEN len(s) >= 2 THEN path ELSE s[1] END AS full_name FROM q""",
)
def path_split(spark, d):
    parts = F.split("url", "/")
    path = F.array_join(F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))), "/")
    rows = table(spark, d, "pages").select("page_id", S.org_of_path(F.lit("root"), path).alias("t"))
    return rows.select("page_id", "t.org", "t.full_name")


@query(
    "period_label",
    """
    WITH g AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 3 > 0 THEN min(year(o_orderdate)) END AS a, CASE WHEN o_custkey % 5 > 0 THEN max(year(o_orderdate)) END AS b FROM orders GROUP BY 1)
    SELECT k, CASE WHEN a IS NULL AND b IS NULL THEN '' WHEN a IS NULL THEN CAST(b AS VARCHAR) WHEN b IS NULL OR a = b THEN CAST(a AS VARCHAR)
        ELSE CAST(a AS VARCHAR) || '–' || CAST(b AS VARCHAR) END AS label FROM g""",
)
def period_label(spark, d):
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.min(F.year("o_orderdate")).alias("a"), F.max(F.year("o_orderdate")).alias("b"))
    return g.select("k", S.period_label(F.when(F.col("k") % 3 > 0, F.col("a")), F.when(F.col("k") % 5 > 0, F.col("b"))).alias("label"))


@query("squash_title", "SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS pr_number, trim(p_name) AS title FROM part")
def squash_title(spark, d):
    subject = F.concat("p_name", F.lit(" (#"), F.col("p_size"), F.lit(")"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), S.merge_marker(subject, F.lit("")).alias("m")).select("k", "m.pr_number", "m.title")


@query("mask_credentials", "SELECT page_id, replace(url, '://', '://***@') AS masked FROM pages")
def mask_credentials(spark, d):
    address = F.replace(F.col("url"), F.lit("://"), F.lit("://oauth2:abc123@"))
    return table(spark, d, "pages").select("page_id", S.mask_credentials(address).alias("masked"))


@query("json_prop", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, coalesce(CAST(json_extract(props, '$.k') AS VARCHAR) NOT IN ('""', '0', 'false', 'null', '[]', '{}'), false) AS truthy FROM events")
def json_prop(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), S.json_truthy(F.col("props"), "k").alias("truthy"))


@query(
    "dedupe_first",
    """
    SELECT full_name, branch FROM (SELECT c_name AS full_name, b AS branch, row_number() OVER (PARTITION BY c_name ORDER BY b, c_custkey) AS n FROM (
        SELECT c_name, c_custkey, 0 AS b FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_name, c_custkey, 1 FROM customer WHERE c_nationkey < 15)) WHERE n = 1""",
)
def dedupe_first(spark, d):
    rows = table(spark, d, "customer").select(F.lit("local").alias("platform"), F.col("c_name").alias("full_name"), F.col("c_custkey").alias("pos"), "c_acctbal", "c_nationkey")
    return targets.union_targets(rows.where("c_acctbal > 0"), rows.where("c_nationkey < 15")).select("full_name", "branch")


@query("selector_union", "SELECT upper(n_name) AS selector FROM nation UNION SELECT r_name FROM region WHERE lower(r_name) NOT IN (SELECT lower(n_name) FROM nation)")
def selector_union(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("pos"), F.upper("n_name").alias("selector"))
    low = n.select("pos", F.lower("selector").alias("selector"))
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("pos"), F.concat(F.lit(" "), F.col("r_name")).alias("selector"))
    return targets.merge_selectors(n, low, r).select("selector")


@query("selector_semi", "SELECT r_name || '/' || n_name AS full_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 4 = 0")
def selector_semi(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    wanted = n.where("n_nationkey % 4 = 0").select(F.upper("n_name").alias("selector"))
    return targets.select_targets(n.select(F.lit("local").alias("platform"), F.concat("r_name", F.lit("/"), "n_name").alias("full_name")), wanted).select("full_name")


_PATHS = "SELECT r_name AS id FROM region WHERE r_regionkey < 3 UNION SELECT r_name || '/' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name || 'x' FROM region"


@query("prefix_anti", f"WITH g AS ({_PATHS}) SELECT id FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.id <> g.id AND starts_with(g.id, o.id || '/'))")
def prefix_anti(spark, d):
    r = table(spark, d, "region")
    n = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat("r_name", F.lit("/"), "n_name").alias("id"))
    return targets.top_level(r.where("r_regionkey < 3").select(F.col("r_name").alias("id")).union(n).union(r.select(F.concat("r_name", F.lit("x")).alias("id"))))


@query("skip_existing", "SELECT o_orderkey AS target FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def skip_existing(spark, d):
    present = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("target"))
    return targets.missing_targets(table(spark, d, "orders").select(F.col("o_orderkey").alias("target")), present, "target")


@query("unclassified", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unclassified(spark, d):
    return targets.missing_targets(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("member_count", "SELECT n_name AS repo, count(s_suppkey) AS members FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def member_count(spark, d):
    n = table(spark, d, "nation")
    blank = [F.lit("").alias(c) for c in ("repo_created_at", "primary_language", "default_branch")]
    repos = n.select(F.col("n_name").alias("full_name"), *blank, F.lit(0).alias("size_kb"))
    people = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("repo"), F.col("s_name").alias("login"))
    return platforms.facts(repos, people, repos.select(F.col("full_name").alias("repo"), F.lit(0).alias("merged"))).select("repo", F.col("contributor_count").alias("members"))


@query(
    "mr_enrichment",
    """
    WITH n AS (SELECT conv_id AS iid, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY 1),
    c AS (SELECT item_id AS iid, count(*) AS n FROM benchmark GROUP BY 1)
    SELECT d.doc_id AS iid, coalesce('quality ' || quality, 'merged') AS state, contains(source, 'bot') AS author_is_bot, coalesce(n.n, 0) AS notes,
        coalesce(roles, '') AS roles, coalesce(c.n, 0) AS changes
    FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN n ON n.iid = d.doc_id LEFT JOIN c ON c.iid = d.doc_id""",
)
def mr_enrichment(spark, d):
    person = F.struct(F.col("source").alias("username")).alias("author")
    requests = table(spark, d, "documents").select(F.col("doc_id").alias("iid"), F.lit("merged").alias("state"), person)
    detail = table(spark, d, "labels").select(F.col("doc_id").alias("iid"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("state"), F.lit(None).cast("struct<username:string>").alias("author"))
    notes = table(spark, d, "conversations").select(F.col("conv_id").alias("iid"), F.col("turn").alias("seq"), F.col("role").alias("note"))
    changes = table(spark, d, "benchmark").select(F.col("item_id").alias("iid"), F.col("text").alias("change"))
    rows = history.enrich_requests(requests, detail, notes, changes)
    return rows.select("iid", "state", "author_is_bot", F.size("notes").cast("long").alias("notes"), F.array_join("notes", ",").alias("roles"), F.size("changes").cast("long").alias("changes"))


_SUMMARY = f"""
    WITH {_FILES.strip()},
    c AS (
        SELECT n_name AS repo, o_custkey AS author, c_mktsegment = '{BOT}' AS bot, o_orderstatus AS status, strftime(o_orderdate, '%Y-%m-%d') AS day,
            row_number() OVER (PARTITION BY n_name ORDER BY o_orderkey DESC) AS log_pos
        FROM {_COMMITS}),
    g AS (
        SELECT repo, count(*) AS total_commits, arg_max(day, log_pos) AS first_commit, arg_min(day, log_pos) AS last_commit_date, count(DISTINCT author) AS contributor_count,
            count(DISTINCT author) FILTER (status = 'F') AS merged_prs
        FROM c GROUP BY repo),
    t AS (SELECT repo, count(*) AS total_files, bool_or(lang = 'de') AS has_tests, CAST(round_even(sum(n_chars) / 1024, 0) AS BIGINT) AS size_kb FROM f GROUP BY repo),
    l AS (SELECT n_name AS repo, sum(p_size)::BIGINT AS loc FROM part JOIN nation ON n_nationkey = p_size GROUP BY 1),
    e AS (SELECT n_name AS repo, 'overdrawn: ' || min(c_custkey) AS error FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal < -900 GROUP BY 1)
    SELECT r_name AS org, n_name AS repo, coalesce(merged_prs, 0) AS merged_prs, total_commits, first_commit, last_commit_date, contributor_count, coalesce(loc, 0) AS loc,
        CASE WHEN error IS NULL THEN size_kb END AS size_kb, CASE WHEN error IS NULL THEN coalesce(total_files, 0) ELSE 0 END AS total_files,
        error IS NULL AND coalesce(has_tests, false) AS has_tests, error
    FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN g ON g.repo = n_name LEFT JOIN t ON t.repo = n_name LEFT JOIN l ON l.repo = n_name LEFT JOIN e ON e.repo = n_name"""


def _summary(spark, d) -> DataFrame:
    """The summary of all tables: a status F is a squash of its author's change, parts are lines of the repository that
    their size numbers, and an overdrawn account fails its repository's file tree."""
    from . import summary

    nation = table(spark, d, "nation")
    w = Window.partitionBy("n_name").orderBy(F.desc("o_orderkey"))
    subject = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Work (#"), F.col("o_custkey").cast("string"), F.lit(")"))).otherwise(F.lit("Work"))
    commits = _commits(spark, d).select(
        F.col("n_name").alias("repo"), F.row_number().over(w).alias("log_pos"), F.col("o_orderkey").cast("string").alias("sha"), F.col("c_name").alias("author_name"),
        F.col("c_custkey").cast("string").alias("author_email"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("author_date"), subject.alias("subject"), F.lit("").alias("body"),
    )
    lines = table(spark, d, "part").join(F.broadcast(nation), F.col("p_size") == F.col("n_nationkey")).select(F.col("n_name").alias("repo"), F.col("p_type").alias("language"), F.col("p_size").cast("long").alias("code"))
    owing = table(spark, d, "customer").where("c_acctbal < -900").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    errors = owing.groupBy(F.col("n_name").alias("repo")).agg(F.concat(F.lit("overdrawn: "), F.min("c_custkey").cast("string")).alias("error")).withColumn("stage", F.lit(summary.TREE))
    targets_ = _repos(spark, d).withColumnRenamed("repo", "full_name")
    none = spark.createDataFrame([], "full_name string, map_pos int, language string, value double")
    return summary.summary(targets_, commits, _files(spark, d), none, lines, F.lit("2000-01-01").cast("timestamp"), errors)


_SUMMARY_COLUMNS = "org repo merged_prs total_commits first_commit last_commit_date contributor_count loc size_kb total_files has_tests error".split()


@query("summary_row", _SUMMARY)
def summary_row(spark, d):
    return _summary(spark, d).select(*_SUMMARY_COLUMNS)


@query("failures", f"SELECT org, repo, error FROM ({_SUMMARY}) WHERE length(error) > 0")
def failures(spark, d):
    from . import summary

    return summary.failures(_summary(spark, d))


@query("outcome_counts", f"SELECT count(*) AS repos, count(*) FILTER (error IS NULL) AS ok, count(*) FILTER (length(error) > 0) AS failed FROM ({_SUMMARY})")
def outcome_counts(spark, d):
    from . import summary

    return summary.outcome_counts(_summary(spark, d))


@query("summary_top", f"SELECT org, repo, total_commits FROM ({_SUMMARY}) ORDER BY org, repo LIMIT 10")
def summary_top(spark, d):
    return _summary(spark, d).orderBy("org", "repo").limit(10).select("org", "repo", "total_commits")


@query("distinct_repos", "SELECT DISTINCT n_name AS repo FROM nation ORDER BY 1")
def distinct_repos(spark, d):
    return table(spark, d, "nation").select(F.col("n_name").alias("repo")).distinct().orderBy("repo")


@query("redact_map", "SELECT c_custkey AS k, c_name AS name, CAST(NULL AS VARCHAR) AS token, CAST(1 AS INTEGER) AS left_over FROM customer")
def redact_map(spark, d):
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("token"), F.col("c_mktsegment"), F.lit("command"), F.lit("x"))
    safe = S.redact_map(m, ("token",))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), safe["name"].alias("name"), safe["token"].alias("token"), F.size(safe).alias("left_over"))


@query("redact_arguments", "SELECT c_custkey AS k, 'run --token *** --org ' || c_mktsegment AS safe FROM customer")
def redact_arguments(spark, d):
    arguments = F.array(F.lit("run"), F.lit("--token"), F.col("c_name"), F.lit("--org"), F.col("c_mktsegment"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array_join(S.redact_arguments(arguments, ("--token",)), " ").alias("safe"))


@query("llm_normalise", "SELECT doc_id, CASE WHEN quality = 1 THEN 'library_sdk' ELSE 'other' END AS repo_type FROM labels")
def llm_normalise(spark, d):
    raw = F.when(F.col("quality") == 1, " Library_SDK ").otherwise("nonsense")
    return table(spark, d, "labels").select("doc_id", S.normalised_type(raw, classify.TYPES).alias("repo_type"))


@query(
    "evidence_sample",
    f"""
    WITH {_FILES.strip()},
    s AS (
        SELECT repo, path, text, row_number() OVER (PARTITION BY repo ORDER BY ['1' || string_split(path, '/')[1], '0' || string_split(path, '/')[2]]) AS n
        FROM f WHERE lang IN ('en', 'es') AND n_chars <= 250000 AND length(text) > 0)
    SELECT repo, path, left(text, 1500) AS content FROM s WHERE n <= 4""",
)
def evidence_sample(spark, d):
    rows = trees.evidence(_files(spark, d)).select("repo", F.explode("source_excerpts").alias("x"))
    return rows.select("repo", "x.path", "x.content")


@query(
    "evidence_paths",
    f"""
    WITH {_FILES.strip()},
    p AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY string_split(path, '/')[:-2], string_split(path, '/')[-1]) AS n FROM f),
    q AS (SELECT repo, string_agg(path, ' ' ORDER BY n) AS file_paths FROM p WHERE n <= 250 GROUP BY repo)
    SELECT n_name AS repo, file_paths, n_regionkey AS loc, true AS has_tests FROM q JOIN nation ON n_name = repo""",
)
def evidence_paths(spark, d):
    facts = table(spark, d, "nation").select(
        F.col("n_name").alias("repo"), F.lit("o").alias("org"), F.lit("").alias("primary_language"), F.lit("").alias("languages_breakdown"),
        F.col("n_regionkey").alias("loc"), F.lit(1).alias("total_commits"), F.lit(True).alias("has_tests"),
    )
    rows = trees.with_repository(trees.evidence(_files(spark, d)), facts)
    return rows.where("repository is not null").select("repo", F.array_join("file_paths", " ").alias("file_paths"), "repository.loc", "repository.has_tests")

_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query(
    "api_addresses",
    f"""
    SELECT page_id, 'https://' || {_HOST} || '/api/v4' AS gitlab, CASE WHEN {_HOST} = 'github.com' THEN 'https://api.github.com' ELSE 'https://' || {_HOST} || '/api/v3' END AS github,
        CASE WHEN {_HOST} = 'github.com' THEN 'https://api.github.com/graphql' ELSE 'https://' || {_HOST} || '/api/graphql' END AS graphql,
        replace(url_encode(url), '+', '%20') AS encoded, starts_with(url, 'http://' || {_HOST} || '/') OR url = 'http://' || {_HOST} AS under
    FROM pages""",
)
def api_addresses(spark, d):
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return table(spark, d, "pages").select(
        "page_id", S.gitlab_api(F.concat(F.lit(" "), host, F.lit("/"))).alias("gitlab"), S.github_api(host).alias("github"), S.github_graphql(host).alias("graphql"),
        S.percent_encoded(F.col("url")).alias("encoded"), S.is_under(F.concat(F.lit("http://"), host), F.col("url")).alias("under"),
    )


@query(
    "selector_lines",
    """
    WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents)
    SELECT doc_id, len(s) AS n, coalesce(s[1], '') AS first, coalesce(s[-1], '') AS last FROM l""",
)
def selector_lines(spark, d):
    rows = table(spark, d, "documents").select("doc_id", S.selectors(F.col("text")).alias("s"))
    at = lambda k: F.coalesce(F.try_element_at("s", F.lit(k)), F.lit(""))
    return rows.select("doc_id", F.array_size("s").cast("long").alias("n"), at(1).alias("first"), at(-1).alias("last"))


@query("settings", "SELECT c_name AS key, c_mktsegment || '=' || c_custkey AS value FROM customer WHERE c_acctbal > 0")
def settings(spark, d):
    """Customers as lines of a configuration file; those without money are comments."""
    line = F.concat(F.when(F.col("c_acctbal") > 0, "  ").otherwise("# "), "c_name", F.lit(" = "), "c_mktsegment", F.lit("="), F.col("c_custkey").cast("string"), F.lit(" "))
    return targets.config(table(spark, d, "customer").select(line.alias("value")))


@query(
    "loc_breakdown",
    """
    WITH g AS (SELECT p_brand AS repo, p_type AS language, sum(p_size - 1) AS n FROM part GROUP BY ALL HAVING sum(p_size - 1) <> 0),
    t AS (SELECT *, sum(n) OVER (PARTITION BY repo) AS total FROM g)
    SELECT b.repo, coalesce(string_agg(language || ':' || printf('%.1f', 100.0::DOUBLE * n / total) || '%', '; ' ORDER BY n DESC, language), '') AS languages,
        coalesce(arg_min(language, (-n, language)), '') AS primary_language
    FROM (SELECT DISTINCT p_brand AS repo FROM part) b LEFT JOIN t ON t.repo = b.repo GROUP BY b.repo""",
)
def loc_breakdown(spark, d):
    lines = table(spark, d, "part").select(F.col("p_brand").alias("repo"), F.col("p_type").alias("language"), (F.col("p_size") - 1).cast("long").alias("code"))
    counted = trees.lines_by_language(lines).select(F.col("repo").alias("full_name"), F.lit(0).alias("map_pos"), "language", F.col("code").cast("double").alias("value"))
    shares = trees.language_shares(counted, by_name=True)
    return shares.select(F.col("full_name").alias("repo"), F.col("languages_breakdown").alias("languages"), "primary_language")


@query(
    "merged_changes",
    f"""
    WITH c AS (
        SELECT n_name AS repo, o_custkey::VARCHAR AS pr_number, o_orderstatus AS s, strftime(o_orderdate, '%Y-%m-%d') AS merged_at, c_name AS merged_by_name, o_orderkey::VARCHAR AS merge_commit, o_orderkey AS k
        FROM {_COMMITS}),
    r AS (SELECT *, row_number() OVER (PARTITION BY repo, pr_number ORDER BY s <> 'O' DESC, CASE WHEN s <> 'O' THEN -k ELSE k END) AS n FROM c)
    SELECT repo, pr_number, CASE WHEN s = 'O' THEN 'squash' ELSE 'merge-commit' END AS method, CASE s WHEN 'O' THEN '' WHEN 'F' THEN 'a/b' ELSE 'topic' END AS source_branch,
        CASE s WHEN 'O' THEN 'Work' WHEN 'F' THEN 'Told at ' || merged_at ELSE 'Merged in topic (pull request #' || pr_number || ')' END AS title, merged_at, merged_by_name, merge_commit
    FROM r WHERE n = 1""",
)
def merged_changes(spark, d):
    """A status O is a squash, an F the merge of a pull request with its title in the body, a P one of the other kind."""
    n, day = F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    status = F.col("o_orderstatus")
    subject = F.when(status == "O", F.concat(F.lit("Work (#"), n, F.lit(")"))).when(status == "F", F.concat(F.lit("Merge pull request #"), n, F.lit(" from a/b"))).otherwise(F.concat(F.lit("Merged in topic (pull request #"), n, F.lit(")")))
    commits = _commits(spark, d).select(
        F.col("n_name").alias("repo"), (-F.col("o_orderkey")).alias("log_pos"), F.col("o_orderkey").cast("string").alias("sha"), F.col("c_name").alias("author_name"),
        F.lit("").alias("author_email"), day.alias("author_date"), subject.alias("subject"), F.concat(F.lit("\n Told at "), day, F.lit("\nmore")).alias("body"),
    )
    return history.fold_merged(commits).select("repo", "pr_number", "method", "source_branch", "title", "merged_at", "merged_by_name", "merge_commit")


@query(
    "local_targets",
    """
    WITH p AS (SELECT page_id, array_to_string(string_split(url, '/')[4:], '/') AS path FROM pages),
    s AS (SELECT path, string_split(path, '/') AS s FROM p)
    SELECT 'local' AS platform, path, CASE WHEN path IN ('', '.') OR len(s) < 2 THEN 'root' ELSE s[1] END AS org,
        CASE WHEN path IN ('', '.') THEN 'root' WHEN len(s) < 2 THEN s[1] ELSE path END AS full_name
    FROM s""",
)
def local_targets(spark, d):
    parts = F.split("url", "/")
    paths = table(spark, d, "pages").select(F.array_join(F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))), "/").alias("path"))
    return targets.local_targets(paths, F.lit("root"))


@query("restored_runs", "SELECT user_id::VARCHAR AS run, CASE WHEN arg_max(value > 300, event_id) FILTER (event_type = 'purchase' AND value > 250) THEN 'completed' ELSE 'failed' END AS phase, false AS running FROM events GROUP BY 1")
def restored_runs(spark, d):
    return progress.restored(progress.run_state(_events(spark, d))).select("run", "phase", "running")


@query("classified", "SELECT 'NATION_' || source[4:] AS repo, '' AS codebase_description, 'unknown' AS industry_domain, '[]' AS vibe_code_signals, 'other' AS repo_type, NULL::VARCHAR AS llm_analysis_error FROM documents GROUP BY source")
def classified(spark, d):
    return classify.classify(trees.evidence(_files(spark, d)))
