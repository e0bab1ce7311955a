"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, with one row per distinct text ever added: the digest and the
id that stays. A batch is reduced to one row per digest (partial aggregation, so a huge group of copies never
meets in one task), anti-joined with the index by sort-merge on the bucketing, and what is new is appended. A table of
documents is added in batches of ascending id, so the smallest id of a text is the one that the index holds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import new_path, written

#: Batches that a table is added in.
BATCHES = 3
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def digest_of(text: Column) -> Column:
    """SHA-256 of the normalised text, as 32 bytes."""
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """The persistent index: a bucketed, sorted table (digest, keep_id).

    `buckets` is fixed when the index is made; a later batch is shuffled to the same number, the index itself never.
    Give `table` and `path` to keep an index over sessions; a new one is made otherwise. Size it at about one
    bucket per 256 MB of digests (40 bytes each) that the corpus will ever hold.
    """

    def __init__(self, spark: SparkSession, table: str | None = None, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.table = table or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or new_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def attach(self, id_type: str = "bigint") -> None:
        """Make the index at `path` known to this session: an empty one, or one that an earlier session wrote."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id {id_type}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def forget(self) -> None:
        """Take the index out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        """Append rows (digest, keep_id), whose digests must be new, one file per bucket."""
        (
            rows.select("digest", "keep_id")
            .repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.table)
        )


def add_batch(digests: DataFrame, index: DigestIndex) -> None:
    """Add (id, digest) rows to the index: of a digest that it lacks, the smallest id of the batch (null if all are).

    Adding the same batch again changes nothing, so a job that failed after the append can simply be run anew.
    """
    batch = digests.groupBy("digest").agg(F.min("id").alias("keep_id"))
    index.append(written(batch.join(index.read().select("digest").hint("merge"), "digest", "left_anti"), "fresh"))


def add_in_order(digests: DataFrame, index: DigestIndex, batches: int) -> None:
    """Add (id, digest) rows in batches of about equal size by ascending id, null ids last.

    Ids that aren't numbers, and a single batch, are added at once.
    """
    kind = digests.schema["id"].dataType
    index.attach(kind.simpleString())
    cuts: list = []
    if batches > 1 and isinstance(kind, NumericType):
        shares = [k / batches for k in range(1, batches)]
        cuts = sorted(set(digests.agg(F.percentile_approx("id", shares)).first()[0] or []))
    for low, high in zip([None, *cuts], [*cuts, None]):
        above = F.lit(True) if low is None else (F.col("id") > low) | F.col("id").isNull()
        below = F.lit(True) if high is None else F.col("id") <= high
        add_batch(digests.where(above & below), index)


def find_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    `keep_id` is what the index holds: of a text that it knew before, the id kept then; of a new one, the smallest id.
    `group_size` counts the rows of `docs`. Without an `index`, a new one is made for this call.

    Nulls: a null text equals an empty one; a null id is smaller than none, so it stays only if its whole group has
    null ids. Rows that repeat id and text all count in `group_size` and carry the same `kept`. An empty table gives
    none. Other columns are not read, whatever their names.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    digests = written(docs.select(F.col(id_col).alias("id"), digest_of(F.col(text_col)).alias("digest")), "digests")
    add_in_order(digests, index, batches)
    sizes = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    entries = written(sizes.join(index.read().hint("merge"), "digest"), "entries")
    if own:
        index.forget()
    return digests.join(entries.hint("merge"), "digest").select(
        F.col("id").alias(id_col),
        F.col("keep_id").cast(digests.schema["id"].dataType).alias("keep_id"),
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """The rows of `docs` that stay, one per text: that of the smallest id, if its text is new to the index.

    Of rows that repeat the id and the text, one stays. All columns of `docs` are returned. One shuffle: the row
    that stays is chosen by partial aggregation before it, so a group of copies is not gathered.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    order = F.struct(F.col(f"r.{id_col}").isNull(), F.col(f"r.{id_col}"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("r")).withColumn("digest", digest_of(F.col(f"r.{text_col}")))
    first = written(rows.groupBy("digest").agg(F.min_by("r", order).alias("r")), "first")
    add_in_order(first.select(F.col(f"r.{id_col}").alias("id"), "digest"), index, batches)
    entries = index.read()
    if own:  # the rows themselves are not written a second time
        entries = written(entries, "entries")
        index.forget()
    return first.join(entries.hint("merge"), "digest").where(F.col(f"r.{id_col}").eqNullSafe(F.col("keep_id"))).select("r.*")
