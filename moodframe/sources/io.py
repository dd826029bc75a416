"""Sources and sinks (A1, A2, A5): header CSV with quoted multi-line cells,
and Parquet as the default format. Schemas are explicit, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSTS_SCHEMA = "doc_id bigint, type string, lang string, posts string, n_chars bigint"
ENRICHED_SCHEMA = ("doc_id bigint, type string, lang string, posts string, n_chars bigint, "
                   "cleaned_posts string, emotion string, emoji string")

# Written for a null, so that it is not read as an empty text; a text of just
# this character cannot be told from it.
CSV_NULL = "\u0000"
# The same on both sides: nothing is trimmed, and every cell is quoted.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": CSV_NULL,
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
# Rows in a CSV file: a file whose cells hold newlines is one task's work.
CSV_FILE_ROWS = 100_000


# Column that holds the text of a row that does not fit its schema.
BAD_ROW = "_bad_row"


def read_csv(spark: SparkSession, path: str | list[str], schema: str, quarantine: str | None = None) -> DataFrame:
    """Header CSV whose text cells may hold commas, quotes, newlines and blanks.

    A row that does not fit the schema (a broken number, too few or too many
    cells) ends the read. With ``quarantine`` it goes there instead, as Parquet
    with its text, its file and the cells that could be read, and the other rows are returned."""
    reader = spark.read.options(**CSV_OPTIONS, multiLine="true", emptyValue="")
    if quarantine is None:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    rows = (reader.schema(f"{schema}, {BAD_ROW} string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD_ROW).csv(path))
    bad = F.col(BAD_ROW).isNotNull()
    rows.where(bad).select("*", F.col("_metadata.file_path").alias("_file")).write.mode("overwrite").parquet(quarantine)
    # whether a row fits shows only when all its cells are read, also for a count
    whole = F.length(F.concat_ws("", *[c for c in rows.columns if c != BAD_ROW])) >= 0
    return rows.where(~bad & whole).drop(BAD_ROW)


def read_posts_csv(spark: SparkSession, path: str | list[str], schema: str = POSTS_SCHEMA,
                   quarantine: str | None = None) -> DataFrame:
    """A1: posts from header CSV."""
    return read_csv(spark, path, schema, quarantine)


def write_csv(df: DataFrame, path: str, rows_per_file: int = CSV_FILE_ROWS) -> None:
    """A2 (CSV): header, quotes doubled, blanks and empty strings kept, nulls
    marked, at most ``rows_per_file`` rows a file."""
    (df.write.mode("overwrite").options(**CSV_OPTIONS, quoteAll="true", emptyValue="", maxRecordsPerFile=rows_per_file)
     .csv(path))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A2 (Parquet, default): optional ``partitionBy`` for class-pruned reads."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def preview_head(df: DataFrame, cols: list[str], order_col: str, n: int = 5) -> DataFrame:
    """A5: first ``n`` rows by an explicit order key (a top-k, not a scan)."""
    return df.select(*cols).orderBy(order_col).limit(n)


def table_checksum(df: DataFrame, cols: list[str]) -> DataFrame:
    """Row count and an order-free checksum (sum of a 30-bit md5 slice per row)."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("∅")) for c in cols])
    part = F.conv(F.substring(F.md5(key), 1, 7), 16, 10).cast("bigint")
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                  F.sum(part).cast("bigint").alias("checksum"))
