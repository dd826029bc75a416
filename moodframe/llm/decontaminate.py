"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents long, so Jaccard similarity says nothing;
what counts is the share of an item's shingles that a document contains. Items
are partitioned by shingle count into powers of two. Every item of a class
gets a bottom-k MinHash signature, its k smallest shingle hashes, where k
follows from the class: a document that holds the share ``threshold`` of an
item lacks at most ``(1 - threshold) * size`` of its shingles, so with
``k = floor((1 - threshold) * largest size of the class) + 1`` at least one
signature hash is among the document's. The candidates are therefore complete,
and each is verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodframe.llm.common import documents, materialise

SHINGLE = 5
THRESHOLD = 0.8
# A signature row is a hash and an item number; this many take about 64 MB. An
# item's joined shingles are up to n times its text.
BROADCAST_ROWS = 2_000_000
BROADCAST_BYTES = 64 << 20


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingles(w: str, n: int, make) -> Column:
    """``make`` over each window of ``n`` words; shorter texts have none."""
    last = F.size(w) - F.lit(n)
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
                          lambda i: make([F.get(F.col(w), i + k) for k in range(n)]))
    return F.array_distinct(F.when(last >= 0, windows).otherwise(F.array().cast(windows_type(make))))


def _by_length(w: str, lengths: list[int], n: int, make) -> Column:
    """An item's shingles: of fewer than ``n`` words, the whole sequence is one."""
    out = F.when(F.size(w) >= n, _shingles(w, n, make))
    for m in lengths:
        out = out.when(F.size(w) == m, _shingles(w, m, make))
    return out


def _all_lengths(w: str, lengths: list[int], n: int, make) -> Column:
    """A document's shingles of ``n`` words and of the short items' lengths."""
    return F.concat(*[_shingles(w, m, make) for m in [n, *lengths]])


def windows_type(make) -> str:
    return "array<bigint>" if make is _hashed else "array<string>"


def _hashed(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def _joined(parts: list[Column]) -> Column:
    return F.concat_ws(" ", *parts)


def item_signatures(items: DataFrame, threshold: float, n: int, short: list[int] = []) -> DataFrame:
    """(item_no, hash): the bottom-k signature of every item; ``short`` lists
    the lengths below ``n`` that items have."""
    sized = (items.withColumn("hashes", F.array_sort(_by_length("words", short, n, _hashed)))
             .withColumn("size_class", F.floor(F.log2(F.size("hashes")))))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    k = (F.floor(F.lit(1 - threshold) * largest + F.lit(1e-9)) + 1).cast("int")
    return sized.select("item_no", F.explode(F.slice("hashes", F.lit(1), k)).alias("hash"))


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text",
                 threshold: float = THRESHOLD, n: int = SHINGLE) -> DataFrame:
    """Pairs of a document and a test item of whose distinct ``n``-word
    shingles the document contains at least ``threshold``.

    Returns ``doc_id, text_key, item_id, item_shingles, shared_shingles,
    containment``; ``text_key`` is the hash of the text that was matched, so
    that pairs can be joined back to rows whose id is null or repeated.

    Cases: words are lower-cased runs of letters and digits. Null, empty and
    wordless texts match nothing; an item of fewer than ``n`` words is one
    shingle, all its words in a row, and is found wherever they stand so. A repeated row gives its pairs once, equal
    items under several ids give a pair for each id. Null ids are kept as they
    are. Empty tables give an empty result; other columns are not looked at.
    """
    table, _ = materialise(
        items.select(F.col(item_id).alias("item_id"), words(F.col(item_text)).alias("words"))
        .where(F.size("words") > 0).distinct()
        .withColumn("item_no", F.monotonically_increasing_id()), "benchmark-items")
    # at most n - 1 numbers
    short = sorted(r.m for r in table.where(F.size("words") < n).select(F.size("words").alias("m")).distinct().collect())
    signatures, _ = materialise(item_signatures(table, threshold, n, short), "benchmark-signatures")
    small = signatures.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    length = table.agg(F.sum(F.octet_length(F.concat_ws(" ", "words"))).alias("bytes")).first().bytes
    small_texts = small and (length or 0) * n <= BROADCAST_BYTES
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"),
                        F.col(text).alias("text"))
    hashed = (keyed.select("doc_id", "text_key", words(F.col("text")).alias("words"))
              .select("doc_id", "text_key", F.explode(_all_lengths("words", short, n, _hashed)).alias("hash")))
    found, _ = materialise(
        hashed.join(F.broadcast(signatures) if small else signatures, "hash")
        .select("doc_id", "text_key", "item_no").distinct(), "benchmark-candidates")
    at = keyed.alias("d").join(
        found.alias("f"), F.col("d.text_key").eqNullSafe(F.col("f.text_key"))
        & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")))
    # rows that repeat an id and text meet here with the same pair
    at = at.select("d.doc_id", "d.text_key", words(F.col("d.text")).alias("words"), "f.item_no")
    at = at.select("doc_id", "text_key", "item_no", _all_lengths("words", short, n, _joined).alias("has"))
    wanted = table.select("item_no", "item_id", _by_length("words", short, n, _joined).alias("wants"))
    out = at.join(F.broadcast(wanted) if small_texts else wanted, "item_no").select(
        "doc_id", "text_key", "item_id", "item_no", F.size("wants").cast("long").alias("item_shingles"),
        F.size(F.array_intersect("has", "wants")).cast("long").alias("shared_shingles"))
    out = out.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))
    return (out.where(F.col("containment") >= F.lit(threshold))
            .dropDuplicates(["doc_id", "text_key", "item_no"]).drop("item_no"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = contaminated(documents(spark, sf_dir), benchmark(spark, sf_dir))
    return pairs.select("doc_id", "item_id", "item_shingles", "shared_shingles", "containment")


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark),
lens AS (SELECT DISTINCT least(5, len(w)) AS m FROM iw WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, text, array_to_string(w[i : i + m - 1], ' ') AS s
       FROM (SELECT doc_id, text, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, lens)),
its AS (SELECT DISTINCT item_id, w AS iw, array_to_string(w[i : i + m - 1], ' ') AS s
       FROM (SELECT item_id, w, least(5, len(w)) AS m, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM iw)),
sz AS (SELECT item_id, iw, count(*) AS item_shingles FROM its GROUP BY ALL),
hit AS (SELECT doc_id, text, item_id, iw, count(*) AS shared_shingles FROM ds JOIN its USING (s) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles / item_shingles AS containment
FROM hit JOIN sz USING (item_id, iw) WHERE shared_shingles / item_shingles >= 0.8
"""
