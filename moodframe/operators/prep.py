"""Token-level preparation (B9, B11) and label / split / feature preparation
(E1-E7)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodframe.functions import text as T
from moodframe.functions.hashing import md5int
from moodframe.operators.keyed import global_index, join_frequent
from moodframe.session import cut_lineage, local_table


def lemmatize(df: DataFrame, lemma_df: DataFrame, key_col: str, tokens_col: str,
              out_col: str = "lemmas", in_row: bool = False) -> DataFrame:
    """Dictionary lemmatizer, unknown tokens unchanged, order kept. A form
    listed twice has its smallest lemma.

    The exploded tokens are joined with the dictionary, of any size, and
    re-collected in order. ``in_row`` ships the dictionary as one map instead and
    nothing is shuffled; its look-ups cost more the more forms there are, so it
    is for small ones. Rows with no tokens come back with an empty array, and
    rows that repeat a key each for itself, in either case equally.
    """
    lem = (lemma_df.where(F.col("form").isNotNull()).groupBy("form").agg(F.min("lemma").alias("lemma"))
           .where(F.col("lemma").isNotNull()))
    if in_row:
        entries = lem.select(F.map_from_entries(F.collect_list(F.struct("form", "lemma")))).scalar()
        known = df.select(key_col, tokens_col).withColumn("_lemmas", entries)
        return known.select(key_col, F.transform(
            F.coalesce(tokens_col, F.array().cast("array<string>")),
            lambda t: F.coalesce(F.try_element_at(F.col("_lemmas"), t), t)).alias(out_col))
    # rows of the same key and tokens have the same lemmas
    counted = df.groupBy(key_col, tokens_col).agg(F.count(F.lit(1)).alias("_n"))
    exploded = counted.select(key_col, F.sha2(F.to_json(F.struct(F.col(tokens_col).alias("t"))), 256).alias("_row"), "_n",
                              F.posexplode_outer(tokens_col).alias("pos", "form"))
    tok = F.coalesce(F.col("lemma"), F.col("form"))
    item = F.when(F.col("pos").isNotNull(), F.struct(F.col("pos"), tok.alias("tok")))
    grouped = (exploded.join(lem, "form", "left").groupBy(key_col, "_row", "_n")
               .agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["tok"]).alias(out_col)))
    return (grouped.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
            .select(key_col, out_col))


def readme_clean(df: DataFrame, lemma_df: DataFrame, stop_words: list[str], key_col: str,
                 text_col: str, out_col: str = "cleaned", in_row: bool = False) -> DataFrame:
    """Lower -> a-z only -> split -> stop words out -> lemmas -> join."""
    toks = df.select(key_col, T.remove_stopwords(
        T.tokenize_words(T.normalize_lower(text_col)), stop_words).alias("_t"))
    lem = lemmatize(toks, lemma_df, key_col, "_t", "_lem", in_row)
    return lem.select(key_col, T.rejoin_tokens("_lem").alias(out_col))


# ------------------------------------------------------------------ E1 / E2
def fit_codes(df: DataFrame, col: str) -> DataFrame:
    """E1 (fit): ``(value, code)`` with 0-based codes of the sorted distinct
    non-null values. The window runs over the distinct values only."""
    vals = df.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    return vals.select("value", (F.row_number().over(Window.orderBy("value")) - 1)
                       .cast("bigint").alias("code"))


def encode_labels(df: DataFrame, codes: dict[str, DataFrame], prefix: str = "label_") -> DataFrame:
    """E1 (apply): ``label_<col>`` code for each column, by a join to the saved
    code table (unknown values -> null)."""
    out = df
    for col, table in codes.items():
        t = table.select(F.col("value").alias(col),
                                            F.col("code").alias(f"{prefix}{col}"))
        out = out.join(t, col, "left")
    return out


def decode_labels(df: DataFrame, code_col: str, codes: DataFrame, out_col: str) -> DataFrame:
    """Code -> label through the saved code table."""
    t = codes.select(F.col("code").alias(code_col), F.col("value").alias(out_col))
    return df.join(t, code_col, "left")


# ------------------------------------------------------------------ E3 / E4
# Hash buckets used to find the split threshold: the boundary bucket holds
# about n / SPLIT_BUCKETS distinct units.
SPLIT_BUCKETS = 1 << 16


def _lex_le(cols: list[str], vals: list, types: dict[str, str]):
    """``(cols...) <= (vals...)`` in lexicographic order, null-safe on equality."""
    if not cols:
        return F.lit(True)
    c, v = F.col(cols[0]), F.lit(vals[0]).cast(types[cols[0]])
    return (c < v) | (c.eqNullSafe(v) & _lex_le(cols[1:], vals[1:], types))


def _bucket_counts(units: DataFrame, hash_col: str, buckets: int):
    width = (1 << 60) // buckets + 1
    b = units.withColumn("_bkt", F.expr(f"`{hash_col}` div {width}"))
    counts = sorted((r["_bkt"], r["n"]) for r in
                    b.groupBy("_bkt").agg(F.count(F.lit(1)).alias("n")).collect())
    return b, counts


def rank_threshold(units: DataFrame, hash_col: str, tie_cols: list[str], k,
                   buckets: int = SPLIT_BUCKETS):
    """The ``k``-th smallest ``(hash_col, *tie_cols)`` of ``units`` (1-based)
    as a Row, or None when ``k <= 0``; ``k`` may be a function of the unit
    count ``n``. Returns ``(row, n)``.

    Per-bucket counts (at most ``buckets`` rows, one job; they also give
    ``n``) locate the bucket that holds rank ``k``; only that bucket is
    ranked, after collapsing equal keys, so a key repeated in a third of the
    rows is one row there.
    """
    b, counts = _bucket_counts(units, hash_col, buckets)
    n = sum(c for _, c in counts)
    k = k(n) if callable(k) else k
    if k <= 0 or k > n:
        return None, n
    off = 0
    for bkt, c in counts:
        if off + c >= k:
            break
        off += c
    order = [hash_col, *tie_cols]
    cum = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    row = (b.where(F.col("_bkt") == bkt).groupBy(*order).agg(F.count(F.lit(1)).alias("_c"))
           .withColumn("_cum", F.sum("_c").over(cum)).where(F.col("_cum") >= k - off)
           .orderBy(*order).select(*order).first())
    return row, n


def train_val_split(df: DataFrame, key_cols: list[str], val_frac: float = 0.2,
                    seed: int = 42, group_cols: list[str] | None = None,
                    split_col: str = "split") -> DataFrame:
    """Exact seeded split, ``ceil(val_frac * n)`` validation rows (or
    groups): the rows with the smallest ``(md5int(seed, key), key)``.
    Keys (or groups) are expected to be unique units.

    With ``group_cols`` all rows of a group land on one side (no copies of a
    text on both sides). Reproducible from the key alone, unlike
    ``randomSplit``. Only the unit keys are aggregated to find the rank
    threshold; the split itself is a narrow column, so the table (and its
    text) is never shuffled.
    """
    unit = group_cols or key_cols
    h = md5int(F.lit("split"), *unit, seed=seed)
    units = df.select(*unit).distinct() if group_cols else df.select(*unit)
    t, _ = rank_threshold(units.withColumn("_h", h), "_h", unit,
                          lambda n: math.ceil(val_frac * n))
    if t is None:
        return df.withColumn(split_col, F.lit("train"))
    types = dict(df.select(*unit).dtypes)
    types["_h"] = "bigint"
    is_val = _lex_le(["_h", *unit], [t[c] for c in ["_h", *unit]], types)
    return (df.withColumn("_h", h)
            .withColumn(split_col, F.when(is_val, F.lit("val")).otherwise(F.lit("train")))
            .drop("_h"))


def _text_digest(text_col: str):
    return F.sha2(F.col(text_col).cast("binary"), 256)


def split_leakage(split_df: DataFrame, text_col: str, split_col: str = "split") -> DataFrame:
    """Validation rows, and those whose text also occurs in training. Texts
    are counted by digest on each side before anything is joined, so neither a
    text nor many rows of one text are shuffled. A null text is no copy."""
    digests = split_df.groupBy(_text_digest(text_col).alias("_digest")).agg(
        F.sum((F.col(split_col) == "train").cast("long")).alias("_train"),
        F.sum((F.col(split_col) == "val").cast("long")).alias("_val"))
    leaked = F.col("_digest").isNotNull() & (F.col("_train") > 0)
    return digests.agg(F.coalesce(F.sum("_val"), F.lit(0)).cast("bigint").alias("n_val"),
                       F.coalesce(F.sum(F.when(leaked, F.col("_val"))), F.lit(0)).cast("bigint").alias("n_leaked"))


def leaked_rows(split_df: DataFrame, text_col: str, split_col: str = "split") -> DataFrame:
    """E4 rows: validation rows with a copy in training. Rows meet the training
    side's digests, one row each; a text that very many validation rows share
    meets its digest where the rows are."""
    digest = _text_digest(text_col)
    val = split_df.where(F.col(split_col) == "val").withColumn("_digest", digest)
    counts = split_df.groupBy(digest.alias("_digest")).agg(
        F.sum((F.col(split_col) == "train").cast("long")).alias("_train"), F.sum((F.col(split_col) == "val").cast("long")).alias("_n"))
    held = cut_lineage(counts.where(F.col("_digest").isNotNull() & (F.col("_train") > 0) & (F.col("_n") > 0))
                       .select("_digest", F.lit(True).alias("_leaked"), "_n"))
    return join_frequent(val, held, "_digest", "_n", "_digest").where("_leaked").select(*split_df.columns)


# ------------------------------------------------------------------ E5 - E7
# Special tokens and their ids, sequence length.
SPECIALS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]"]
PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 1, 2, 3
MAX_LEN = 512


def word_tokens(text_col: str):
    """Feature tokens: lower-cased words of a cleaned text."""
    return F.filter(F.split(F.lower(F.col(text_col)), " "), lambda x: x != "")


def build_vocabulary(df: DataFrame, text_col: str, min_count: int = 1,
                     size: int | None = None) -> DataFrame:
    """E5: ``(token, token_id, n)``: specials first, then the tokens with
    ``n >= min_count`` by (n desc, token). All tokens by default; with
    ``size`` only the first ones up to ``size`` ids (a top-k).

    Ids follow from a range partitioning by count and token: no window spans
    more than a partition, also where most tokens are seen once.
    """
    spark = df.sparkSession
    counts = (df.select(F.explode(word_tokens(text_col)).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
              .where(F.col("n") >= min_count))
    specials = local_table(spark, [(t, i, 0) for i, t in enumerate(SPECIALS)],
                                     "token string, token_id bigint, n bigint")
    if size is not None:
        counts = counts.orderBy(F.desc("n"), F.asc("token")).limit(size - len(SPECIALS))
    ranked = global_index(counts, [F.desc("n"), F.asc("token")], "_rank").select(
        "token", (F.col("_rank") + len(SPECIALS)).cast("bigint").alias("token_id"), "n")
    return specials.unionByName(ranked)


def encode_tokens(df: DataFrame, key_col: str, text_col: str, vocab: DataFrame,
                  max_len: int = MAX_LEN) -> DataFrame:
    """``input_ids`` (``[CLS]`` + first ``max_len-2`` ids + ``[SEP]``, padded
    with ``[PAD]`` to ``max_len``) and ``attention_mask`` (1 real, 0 pad).

    Truncation happens before the vocabulary join, so at most ``max_len-2``
    tokens per row are joined and re-collected. Tokens that the vocabulary counts
    as frequent are looked up where they are.
    """
    toks = (df.select(key_col, F.posexplode_outer(word_tokens(text_col)).alias("pos", "token"))
            .where(F.col("pos").isNull() | (F.col("pos") < max_len - 2)))
    v = cut_lineage(vocab.select("token", "token_id", "n"))
    item = F.when(F.col("pos").isNotNull(), F.struct(
        "pos", F.coalesce(F.col("token_id"), F.lit(UNK_ID).cast("bigint")).alias("id")))
    ids = (join_frequent(toks, v, "token", "n", key_col).groupBy(key_col)
           .agg(F.array_sort(F.collect_list(item)).alias("_l")))
    real = F.concat(F.array(F.lit(CLS_ID).cast("bigint")), F.transform("_l", lambda x: x["id"]),
                    F.array(F.lit(SEP_ID).cast("bigint")))
    n_pad = F.lit(max_len) - F.size("_real")
    return (ids.withColumn("_real", real)
            .select(key_col,
                    F.concat("_real", F.array_repeat(F.lit(PAD_ID).cast("bigint"), n_pad))
                    .alias("input_ids"),
                    F.concat(F.array_repeat(F.lit(1).cast("bigint"), F.size("_real")),
                             F.array_repeat(F.lit(0).cast("bigint"), n_pad))
                    .alias("attention_mask")))


def training_rows(encoded: DataFrame, labelled: DataFrame, key_col: str,
                  label_cols: list[str]) -> DataFrame:
    """Feature + codes per row (both splits)."""
    return encoded.join(labelled.select(key_col, "split", *label_cols), key_col)
