"""Reading a run's folder: JSON documents, JSON lines, summaries, configuration, log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators.targets import config
from ..schemas import LOG_LINES, MERGED_MRS, MERGED_PRS

PATH = "_metadata.file_path"


def _repo(level: int):
    """The folder `level` steps above a file, which names its repository."""
    return F.element_at(F.split(F.col(PATH), "/"), -1 - level).alias("repo")


def targets(spark: SparkSession, path: str) -> DataFrame:
    """Targets of a JSON list, with their position in it."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<platform:string,org:string,full_name:string>>").alias("t"))
    return rows.select(F.posexplode("t").alias("seq", "t")).select(F.col("seq").cast("long").alias("seq"), "t.*")


def merged_prs(spark: SparkSession, path: str) -> DataFrame:
    """Merged pull requests of JSON files."""
    return with_flags(spark.read.schema(MERGED_PRS).json(path, multiLine=True))


def with_flags(rows: DataFrame) -> DataFrame:
    """Merged pull requests with whether a bot wrote each and whether any of its lists was cut off."""
    more = F.coalesce(F.col("files.pageInfo.hasNextPage") | F.col("comments.pageInfo.hasNextPage") | F.col("reviews.pageInfo.hasNextPage"), F.lit(False))
    return rows.withColumn("author_is_bot", P.is_bot_login(F.col("author.login"), F.col("author.__typename"))).withColumn("has_more", more)


def merged_mrs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(MERGED_MRS).json(path, multiLine=True)
    return rows.withColumn("author_is_bot", P.is_bot_login(F.col("author.username"), F.lit(None).cast("string")))


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Commits of JSON-lines files, one folder for each repository."""
    fields = "sha string, author_name string, author_email string, author_date string, subject string, is_bot boolean, files array<struct<path:string,additions:long,deletions:long>>, additions long, deletions long"
    return spark.read.schema(fields).json(path).select(_repo(1), "*")


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """Lines of code by language, from a line counter's JSON: a list of objects with Name and Code."""
    rows = spark.read.schema("Name string, Code long").json(path, multiLine=True)
    return rows.select(_repo(1), F.col("Name").alias("language"), F.col("Code").alias("code"))


def summary(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A summary CSV as text columns; with `rows`, so many of them and a flag whether there were more."""
    table = spark.read.csv(path, header=True, escape='"', multiLine=True)
    if rows is None:
        return table
    first = table.limit(rows + 1).withColumn("__n", F.monotonically_increasing_id())  # one task's, so in the file's order
    more = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))) > rows
    return first.withColumn("truncated", more).orderBy("__n").limit(rows).drop("__n")


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a configuration file. Values may be secret: never write this out."""
    return config(spark.read.text(path))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A log's lines in order."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    return rows.select(F.col("seq").cast("long").alias("seq"), "line").to(spark.createDataFrame([], LOG_LINES).schema)
