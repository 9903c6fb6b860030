"""Exact deduplication against a persistent digest index, bucketed and sorted by digest."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.llm.common import delete, join_groups, materialise, release, shared_dir


def text_digest(text: Column) -> Column:
    """SHA-256, in lower-case hex, of the text with each run of ASCII white space as one space; null is empty."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)


class DigestIndex:
    """Two tables, bucketed and sorted by digest: the index, a row per digest, and its repeats.

    Their files lie in ``folder``, which driver and executors share: that of ``spark.checkpoint.dir`` by default.

    A batch is reduced to one row per digest before anything is shuffled, then left-anti joined with the index by
    sort-merge; as the index is bucketed and sorted, only the batch moves. What is new is appended, so later batches
    see it. Of digests that are known, the batch's smallest id and number of rows are appended to the repeats, so that
    totals hold over all batches.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int | None = None, folder: str | None = None):
        self.spark, self.table, self.folder = spark, table, (folder or shared_dir(spark)).rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _read(self, table: str) -> DataFrame | None:
        return self.spark.table(table) if self.spark.catalog.tableExists(table) else None

    def _append(self, groups: DataFrame, table: str) -> None:
        groups.repartition(self.buckets, "digest").write.bucketBy(self.buckets, "digest").sortBy("digest").mode("append").option("path", f"{self.folder}/{table}").saveAsTable(table)

    def read(self) -> DataFrame | None:
        """The index: (digest, keep_id, group_size) as the batch left them that brought the digest."""
        return self._read(self.table)

    def add(self, rows: DataFrame, digest: str = "digest", doc_id: str = "doc_id") -> None:
        """Append the digests of ``rows`` that the index lacks, each with its smallest id and its number of rows."""
        groups = rows.groupBy(F.col(digest).alias("digest")).agg(F.min(doc_id).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        known = self.read()
        if known is None:
            return self._append(groups, self.table)
        groups = materialise(groups, "batch")
        known = known.select("digest").hint("merge")
        fresh = materialise(groups.join(known, "digest", "left_anti"), "fresh")  # written before the table it was read from grows
        self._append(groups.join(known, "digest", "left_semi"), f"{self.table}_repeats")
        self._append(fresh, self.table)
        release(groups)
        release(fresh)

    def totals(self) -> DataFrame:
        """(digest, keep_id, group_size) over all batches: the smallest id and the number of rows."""
        repeats = self._read(f"{self.table}_repeats")
        if repeats is None:
            return self.read()
        later = repeats.groupBy("digest").agg(F.min("keep_id").alias("later_id"), F.sum("group_size").alias("later"))
        every = self.read().join(later.hint("merge"), "digest", "left")  # both sides bucketed alike: nothing moves
        return every.select("digest", F.least("keep_id", "later_id").alias("keep_id"), (F.col("group_size") + F.coalesce("later", F.lit(0))).alias("group_size"))

    def drop(self) -> None:
        for table in (self.table, f"{self.table}_repeats"):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete(self.spark, f"{self.folder}/{table}")


def exact_groups(docs: DataFrame, table: str | None = None, row_key: str | None = None, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are those with one digest; the row with the smallest doc_id stays. Null and empty texts are equal, and
    so are texts that differ in the kind or number of white-space characters between words. Null ids never win over
    others; a group of null ids alone has keep_id null and is kept. Rows that repeat an id and its text share one
    verdict. Other columns of ``docs`` are not read. An empty table gives an empty result.

    The documents go into the index in ``batches`` parts, dealt by a hash of the id: the first is indexed, each later
    one is anti-joined with what is there and its new digests are appended. ``table`` names a lasting index, to which
    these documents are added: keep_id and group_size then count those of earlier calls as well. Without it an index
    is made for this call and dropped. ``row_key`` names a column that the result then has too.
    """
    own = [row_key] if row_key else []
    rows = materialise(docs.select("doc_id", *own, text_digest(F.col("text")).alias("text_sha256")), "digests")
    index = DigestIndex(docs.sparkSession, table or f"digest_index_{uuid.uuid4().hex}")
    try:
        for i in range(batches):
            index.add(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i), "text_sha256")
        groups = materialise(index.totals().withColumnRenamed("digest", "text_sha256"), "groups")
    finally:
        if not table:
            index.drop()
    out = join_groups(rows, groups, "text_sha256", "group_size")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *own)
