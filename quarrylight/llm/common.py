"""What the operators share: the scratch folder of the cluster, written tables, fit samples."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Only where that setting is missing in a local session, as in tests, a temporary folder is made; on a cluster a
    missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quarrylight-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return "file://" + _own[app]


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/quarrylight-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = path or new_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that `written` made, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, fold: Column, per_class: int, max_chars: int, total_chars: int | None = None) -> DataFrame:
    """Rows (text, y) to fit a classifier on: at most `per_class` of each class among labels where `fold` holds.

    With `total_chars`, the texts of a class have half as many characters in all at most: those that go beyond it in the
    order of the hashes are left out.

    The rows are those whose ids have the smallest hashes, so the choice is random but repeatable. Texts of more
    than `max_chars` characters are not fitted on. The sample of labels is bounded by `2 * per_class` rows, hence
    its broadcast. A label whose rows contradict one another or is null is left out.
    """
    sure = (
        labels.where(F.col(label).isin(0, 1) & fold)
        .groupBy("doc_id")
        .agg(F.min(label).alias("y"), F.max(label).alias("y2"))
        .where("y = y2")
        .select("doc_id", "y", F.xxhash64("doc_id").alias("h"))
    )
    picked = sure.where("y = 1").orderBy("h", "doc_id").limit(per_class).unionByName(sure.where("y = 0").orderBy("h", "doc_id").limit(per_class))
    texts = docs.select("doc_id", "text").where(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(picked), "doc_id")
    if total_chars:
        upto = F.sum(F.length("text").cast("long")).over(Window.partitionBy("y").orderBy("h", "doc_id"))
        rows = rows.withColumn("upto", upto).where(F.col("upto") <= total_chars // 2)
    return rows.select("text", "y")
