"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. New documents are
reduced to one row per digest, a sort-merge anti-join with the index keeps the
digests it does not hold yet, and those are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.llm.common import UPPER, discard, documents, join_hot, keep_decided, materialise
from moodframe.session import scratch_dir

# Digests in a bucket, about 64 bytes each, that an index is laid out for.
ROWS_PER_BUCKET = 2_000_000
MIN_BUCKETS = 8


def normalised(text: str) -> Column:
    """A-Z lower-cased, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower())


def digest_of(text: str) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


class DigestIndex:
    """A digest table at ``path``, created at first use.

    Rows are ``(digest binary, keep_id bigint, batch string)``: the document
    that stays for each digest and the batch that brought it. The number of
    buckets follows from the rows expected and is read back from the folder
    name. An index that outgrows its buckets is written anew into more of them;
    of several folders the one with the most buckets that is complete counts.
    """

    def __init__(self, spark: SparkSession, path: str, expected_rows: int = 0):
        self.spark = spark
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        folders = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
        found = [(fs.exists(p.suffix("/_SUCCESS")), int(p.getName().removeprefix("buckets-")))
                 for p in folders if p.getName().startswith("buckets-")]
        self.path = path.rstrip("/")
        self._open(max(found)[1] if found else max(MIN_BUCKETS, expected_rows // ROWS_PER_BUCKET))

    def _open(self, buckets: int) -> None:
        self.buckets, self.location = buckets, f"{self.path}/buckets-{buckets}"
        self.table = "digest_index_" + uuid.uuid5(uuid.NAMESPACE_URL, self.location).hex
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) "
                       f"USING PARQUET CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
                       f"LOCATION '{self.location}'")

    def close(self) -> None:
        """Take the index out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def grow(self, rows_per_bucket: int | None = None) -> None:
        """Write the index into more buckets if one holds over twice the rows
        it is laid out for. The old folder goes when the new one is complete."""
        most = rows_per_bucket or ROWS_PER_BUCKET
        held = self.rows().count()
        if held <= 2 * most * self.buckets:
            return
        old, rows = (self.table, self.location), self.rows()
        self._open(max(2 * self.buckets, held // most))
        rows.repartition(self.buckets, "digest").write.insertInto(self.table, overwrite=True)
        self.spark.catalog.refreshTable(self.table)
        self.spark.sql(f"DROP TABLE {old[0]}")
        discard(self.spark, old[1])

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` whose digest the index does not hold."""
        return groups.join(self.rows().hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame) -> None:
        """Append digests the index does not hold, one file per bucket."""
        (fresh.select("digest", "keep_id", "batch").repartition(self.buckets, "digest")
         .write.insertInto(self.table))
        self.spark.catalog.refreshTable(self.table)


def exact_dedup(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text",
                batch: str | None = None) -> DataFrame:
    """Decide for every row of ``docs`` whether it stays, and append the new
    digests to ``index``.

    ``batch`` names the batch; without a name it is made from the batch's ids
    and digests. A batch that is run again under its name, after a failure or
    by a retry, gives the same result: digests that it appended itself are its
    own, those that are missing are appended now.

    Returns one row per row of ``docs``: ``doc_id``, ``keep_id`` (the id that stays for this text; an id of an earlier batch if
    the index held the text already), ``group_size`` (rows of this batch with
    the text), ``kept`` and ``text_sha256``.

    Cases: a null text equals the empty one. Of equal texts in a batch the
    largest ``doc_id`` stays, a null id is smaller than any other, and of rows
    that repeat the same id one stays. An empty table gives an empty result.
    Columns of ``docs`` besides those named are not looked at, so their names
    cannot clash.
    """
    spark = docs.sparkSession
    rows, rows_at = materialise(
        docs.select(F.col(doc_id).alias("id"), digest_of(text).alias("digest"),
                    F.monotonically_increasing_id().alias("row")), "dedup-rows")
    # partial aggregation leaves one row per digest and task before the shuffle
    groups = rows.groupBy("digest").agg(F.max(F.struct("id", "row")).alias("best"),
                                        F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), "group_size")
    groups, groups_at = materialise(groups, "dedup-groups")
    if batch is None:
        mark = F.xxhash64("digest", "keep_id", "group_size").cast("decimal(38,0)")
        made = groups.agg(F.count(F.lit(1)).alias("n"), F.sum(mark).alias("sum")).first()
        batch = f"{made.n}-{made.sum}"
    index.append(index.unseen(groups.withColumn("batch", F.lit(batch))))
    known = index.rows().select("digest", F.col("keep_id").alias("known_id"), F.col("batch").alias("known_in"))
    decided, _ = materialise(
        groups.join(known.hint("merge"), "digest")
        .select("digest", F.col("known_id").alias("keep_id"), "group_size",
                F.when(F.col("known_in") == batch, F.col("keep_row")).alias("keep_row")), "dedup-decided")
    discard(spark, groups_at)
    matched = join_hot(rows, decided, ["digest"], "group_size", rows.count())
    return matched.select(F.col("id").alias("doc_id"), "keep_id", "group_size",
                          F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
                          F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, index: DigestIndex, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    decided = exact_dedup(docs, index, doc_id, text).select("doc_id", "text_sha256", "kept")
    return keep_decided(docs, doc_id, [F.lower(F.hex(digest_of(text)))], decided, "kept")


def fresh_index(spark: SparkSession, docs: DataFrame) -> DigestIndex:
    """An empty index below the checkpoint folder, laid out for ``docs``."""
    return DigestIndex(spark, scratch_dir(spark, "digest-index"), docs.count())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a fresh index."""
    docs = documents(spark, sf_dir)
    index = fresh_index(spark, docs)
    out = exact_dedup(docs, index)  # reads tables of its own, no longer the index
    index.close()
    return out


ORACLE_SQL = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM n JOIN g USING (text_sha256)
"""
