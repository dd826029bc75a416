"""Training and inference.

The reference fine-tunes one text encoder with three heads and a summed
cross-entropy. With fixed text features the summed loss separates per head,
so each head is trained on its own: a multinomial naive Bayes expressed as
DataFrame aggregates (one plan for all heads), and an optional
``pyspark.ml`` logistic regression per head.

Naive Bayes scores use only the (document, token) pairs that match a
``(class, token)`` parameter:
``score = ln prior_c + sum_t cnt_t * (ln(n_tc + a) - ln a) - len_d * (ln(N_c + a V) - ln a)``
which equals the usual add-``a`` smoothed sum over all in-vocabulary tokens,
so unmatched pairs are never materialised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodframe.operators.keyed import join_frequent
from moodframe.operators.prep import word_tokens
from moodframe.session import cut_lineage, publish_folder, stored

# Numbers of the weights that a Python worker holds, those of the most frequent
# tokens; other tokens are joined. And the words that it weighs at once.
HELD_WEIGHTS = 1 << 22
WORDS_AT_ONCE = 100_000
# Bytes of text whose words a Python worker counts at once, and the pairs of a
# token and its labels that it adds up before they go on.
COUNTED_BYTES = 16 << 20
COUNTED_PAIRS = 1 << 20
# Tasks of a step that adds up gradients, for each core.
TASKS_A_CORE = 3
# Decimals of the score used for the argmax (ties -> smallest class).
SCORE_DECIMALS = 6
LOSS_FLOOR = 1e-15


def feature_tokens(text_col: str, ngram: int = 1) -> Column:
    """Unigrams, plus adjacent word pairs when ``ngram == 2``."""
    uni = word_tokens(text_col)
    if ngram == 1:
        return uni
    n = F.size(uni)
    bi = F.when(n > 1, F.zip_with(F.slice(uni, 1, n - 1), F.slice(uni, 2, n - 1),
                                  lambda a, b: F.concat_ws(" ", a, b))) \
        .otherwise(F.array().cast("array<string>"))
    return F.concat(uni, bi)


def _stack_heads(df: DataFrame, head_cols: list[str], *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(h).alias("head"), F.col(h).cast("string").alias("class"))
                      for h in head_cols])
    return (df.select(*keep, F.inline(pairs))
            .where(F.col("class").isNotNull()))


@dataclass
class NaiveBayesModel:
    """Parameter tables of a multi-head multinomial naive Bayes."""

    class_params: DataFrame   # head, class, n_docs, n_tokens, log_prior, log_denom
    token_params: DataFrame   # head, class, token, lw
    vocab: DataFrame          # token
    alpha: float
    ngram: int
    _dense: tuple | None = field(default=None, repr=False, compare=False)
    _classes: list | None = field(default=None, repr=False, compare=False)
    _counts: "NaiveBayesCounts | None" = field(default=None, repr=False, compare=False)
    _held: dict = field(default_factory=dict, repr=False, compare=False)

    def classes(self) -> list:
        """``(head, class, log_prior, log_denom)`` rows in (head, class)
        order: model metadata, one row per class."""
        if self._classes is None:
            self._classes = (self.class_params.select("head", "class", "log_prior", "log_denom")
                             .orderBy("head", "class").collect())
        return self._classes

    def dense_weights(self) -> tuple[list, DataFrame]:
        """``(classes, table)``: the ``(head, class, log_prior, log_denom)``
        rows in (head, class) order (model metadata, one per class) and one
        row per vocabulary token with the weights of all those classes
        (``w[i]``, zero where class ``i`` never saw the token) and how often
        training saw it (``seen``). Built once per model and checkpointed."""
        if self._dense is None and self._counts is not None:
            ln = _ln(float(self.alpha))
            weights = F.transform("n", lambda n: F.when(n > 0, F.log(n + F.lit(float(self.alpha))) - F.lit(ln)).otherwise(F.lit(0.0)))
            self._dense = (self.classes(), self._counts.by_token().select("token", weights.alias("w"), "seen"))
        if self._dense is None:
            classes = self.classes()
            slot = F.create_map(*[x for i, r in enumerate(classes)
                                  for x in (F.lit(f"{r['head']}\x1f{r['class']}"), F.lit(i))])
            keyed = self.token_params.select(
                "token", F.element_at(slot, F.concat_ws("\x1f", "head", "class")).alias("k"), "lw")
            # a weight is ln(n + alpha) - ln(alpha), so the counts come back from it
            seen = F.lit(float(self.alpha)) * (F.exp("lw") - 1)
            dense = (self.vocab.join(keyed, "token", "left")
                     .groupBy("token").agg(F.coalesce(F.sum(seen), F.lit(0.0)).alias("seen"),
                                           *[F.sum(F.when(F.col("k") == i, F.col("lw"))).alias(f"w{i}")
                                             for i in range(len(classes))]))
            table = cut_lineage(dense.select("token", F.array(
                *[F.coalesce(F.col(f"w{i}"), F.lit(0.0)) for i in range(len(classes))]).alias("w"), "seen"))
            self._dense = (classes, table)
        return self._dense

    def held_weights(self, slots: list[int]) -> tuple:
        """``(shared, others)``: a broadcast of the most frequent tokens and their
        weights for the classes ``slots``, at most ``HELD_WEIGHTS`` numbers, and
        the table of the other tokens, None where there are none."""
        key = tuple(slots)
        if key not in self._held:
            table = self.dense_weights()[1]
            size = F.floor(F.log2(F.col("seen") + 1) * 8).cast("int")
            sizes = sorted((tuple(r) for r in table.groupBy(size.alias("size")).count().collect()), reverse=True)
            bound, room = None, HELD_WEIGHTS // max(1, len(slots))
            for at, n in sizes:
                if n > room:
                    break
                bound, room = at, room - n
            own = slots == list(range(len(self.classes())))
            weights = (F.col("w") if own else F.array(*[F.col("w")[i] for i in slots])).cast("array<double>")
            often = table.where(size >= bound if bound is not None else F.lit(False)).select("token", weights.alias("w")).toArrow()
            values = often["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(often.num_rows, len(slots))
            shared = table.sparkSession.sparkContext.broadcast((often["token"].combine_chunks(), values))
            others = None if not sizes or bound == sizes[-1][0] else (
                table.where(size < bound) if bound is not None else table).select("token", weights.alias("w"))
            self._held[key] = shared, others
        return self._held[key]

    def save(self, path: str, codes: dict[str, DataFrame] | None = None) -> str:
        """A3: write the model as a new version below ``path`` and return the
        version's folder: the parameter tables as Parquet, the label code tables
        that belong to the model, and a manifest with each table's rows and
        checksum.

        The version is written to a staging folder and published by one rename.
        A save that ends half-way leaves the versions before as they are, and
        of two saves at a time both get a number of their own."""
        spark = self.class_params.sparkSession
        tables = {"class_params": self.class_params, "token_params": self.token_params, "vocab": self.vocab,
                  **{f"codes/{c}": t for c, t in (codes or {}).items()}}

        def write(folder: str) -> None:
            entries = []
            for name, table in tables.items():
                table.write.parquet(f"{folder}/{name}")
                entries.append((name, *_checksum(spark.read.parquet(f"{folder}/{name}"))))
            meta = spark.createDataFrame(
                [(float(self.alpha), int(self.ngram), sorted(codes or {}), entries)],
                "alpha double, ngram int, codes array<string>, tables array<struct<name: string, rows: bigint, checksum: string>>")
            meta.write.parquet(f"{folder}/meta")

        while True:
            version = f"{path}/versions/v{max(saved_versions(spark, path), default=0) + 1:06d}"
            if publish_folder(spark, version, write):
                return version

    @classmethod
    def load(cls, spark, path: str, version: int | None = None) -> "NaiveBayesModel":
        """A4: read a version back, by default the newest; its tables must be
        those of its manifest."""
        folder = version_folder(spark, path, version)
        meta = spark.read.parquet(f"{folder}/meta").first()
        for t in meta["tables"]:
            if _checksum(spark.read.parquet(f"{folder}/{t['name']}")) != (t["rows"], t["checksum"]):
                raise ValueError(f"{folder}/{t['name']} is not the table that was saved")
        return cls(spark.read.parquet(f"{folder}/class_params"), spark.read.parquet(f"{folder}/token_params"),
                   spark.read.parquet(f"{folder}/vocab"), meta["alpha"], meta["ngram"])


def _checksum(table: DataFrame) -> tuple[int, str]:
    """Rows, and the sum of the rows' hashes."""
    r = table.agg(F.count(F.lit(1)).alias("n"),
                  F.coalesce(F.sum(F.xxhash64(*table.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("h")).first()
    return r.n, r.h


def saved_versions(spark, path: str) -> list[int]:
    """The numbers of the published versions of a model."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[1:]) for n in names if n.startswith("v"))


def version_folder(spark, path: str, version: int | None = None) -> str:
    found = saved_versions(spark, path)
    if not found or version is not None and version not in found:
        raise FileNotFoundError(f"no {'model' if version is None else f'version {version}'} in {path}")
    return f"{path}/versions/v{version or found[-1]:06d}"


def load_codes(spark, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """A4: the label code tables saved with a model."""
    folder = version_folder(spark, path, version)
    cols = spark.read.parquet(f"{folder}/meta").first()["codes"]
    return {col: spark.read.parquet(f"{folder}/codes/{col}") for col in cols}


@dataclass
class NaiveBayesCounts:
    """What one pass over the training text counts; parameters for any
    smoothing ``alpha`` follow from it."""

    class_counts: DataFrame   # head, class, n_docs, n_tokens
    words: DataFrame          # token, n (of all of ``slots``), seen
    slots: list[tuple]        # (head, class)
    v_size: int
    ngram: int
    base: DataFrame           # token, heads..., n: a plan over the training text, for inspection

    @property
    def vocab(self) -> DataFrame:
        return self.words.select("token")

    @property
    def token_counts(self) -> DataFrame:
        """``head, class, token, n`` of the tokens that a class has."""
        names = F.array(*[F.struct(F.lit(h).alias("head"), F.lit(c).alias("class")) for h, c in self.slots])
        at = self.words.select("token", F.posexplode("n").alias("_k", "n")).where(F.col("n") > 0)
        named = F.get(names, F.col("_k")) if self.slots else F.lit(None).cast("struct<head: string, class: string>")
        return at.select(named.alias("_s"), "token", "n").select("_s.head", "_s.class", "token", "n")

    def by_token(self) -> DataFrame:
        """``token, n, seen``: a token's counts of all classes in (head, class)
        order, and their sum, as they are stored."""
        classes = self.class_counts.select("head", "class").orderBy("head", "class").collect()
        own = [self.slots.index((r["head"], r["class"])) for r in classes]
        n = F.col("n") if own == list(range(len(self.slots))) else F.array(*[F.col("n")[i] for i in own]).cast("array<bigint>")
        return self.words.select("token", n.alias("n"), "seen")

    def model(self, alpha: float = 1.0) -> NaiveBayesModel:
        per_head = Window.partitionBy("head")
        class_params = (
            self.class_counts
            .withColumn("log_prior", F.log(F.col("n_docs") / F.sum("n_docs").over(per_head)))
            .withColumn("log_denom", F.log(F.col("n_tokens") + F.lit(alpha * self.v_size))
                        - F.lit(float(_ln(alpha)))))
        token_params = self.token_counts.select(
            "head", "class", "token",
            (F.log(F.col("n") + F.lit(float(alpha))) - F.lit(_ln(alpha))).alias("lw"))
        return NaiveBayesModel(class_params, token_params, self.vocab, alpha, self.ngram, _counts=self)


def _label_codes(batch: pa.RecordBatch, labels: dict[str, list[str]], known: dict[tuple, int]) -> np.ndarray:
    """Each row's combination of labels, as its number in ``known``, which gets
    those that are new: for every head the label's place, -1 for a null."""
    codes = np.zeros(batch.num_rows, np.int64)
    places = []
    for k, (head, values) in enumerate(labels.items()):
        own = pc.index_in(batch.column(k), value_set=pa.array(values, pa.string()))
        if own.null_count != batch.column(k).null_count:
            raise ValueError(f"{head} has labels that are not among those given: {values}")
        places.append(pc.fill_null(own, -1).to_numpy(zero_copy_only=False))
        codes = codes * (len(values) + 1) + places[-1] + 1
        _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    if not labels:
        first = np.zeros(min(1, batch.num_rows), np.int64)
    ids = [known.setdefault(tuple(int(p[i]) for p in places), len(known)) for i in first]
    return np.array(ids, np.int64)[codes]


def _merged_counts(parts: list[tuple], width: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The counts of ``parts`` (each the distinct tokens, and for the pairs the
    token's place, the combination below ``width`` and the count) as one, with
    equal pairs added up, in the order of the places."""
    tokens = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
    place, starts = tokens.indices.to_numpy().astype(np.int64), np.cumsum([0, *[len(p[0]) for p in parts]])
    pairs = np.concatenate([place[at + p[1]] * width + p[2] for at, p in zip(starts, parts)])
    n = np.concatenate([p[3] for p in parts])
    if len(parts) > 1:
        order = np.argsort(pairs, kind="stable")
        pairs = pairs[order]
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else np.zeros(0, np.int64)
        pairs, n = pairs[first], np.add.reduceat(n[order], first) if len(first) else n
    return tokens.dictionary, pairs // width, pairs % width, n


def _text_slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in runs of about ``COUNTED_BYTES``, each with its first place."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + COUNTED_BYTES, side="right")))
        yield a, texts.slice(a, b - a)
        a = b


def _known_labels(df: DataFrame, head_cols: list[str]) -> dict[str, list[str]]:
    """The labels that each head has, a model's metadata."""
    seen = df.select(*head_cols).agg(*[F.collect_set(F.col(h).cast("string")).alias(h) for h in head_cols]).first() if head_cols else {}
    return {h: sorted(seen[h]) for h in head_cols}


def _word_counts(train: DataFrame, text_col: str, head_cols: list[str], ngram: int,
                 labels: dict[str, list[str]] | None = None, joint: bool = False) -> DataFrame:
    """``token, n``: counts of the tokens of :func:`feature_tokens` for the labels
    of all heads in order, or with ``joint`` a row for each combination of a
    document's labels, ``token, heads..., n``. A null token has the number of
    documents, an empty one, never a word, that of the tokens. A token comes
    once for about ``COUNTED_PAIRS`` pairs of it and a combination in a task."""
    known_labels = labels if labels is not None else _known_labels(train, head_cols)
    known_labels = {h: list(known_labels[h]) for h in head_cols}
    rows = train.select(*[F.col(h).cast("string").alias(h) for h in head_cols], F.lower(F.col(text_col)).alias("_text"))
    heads, values = len(head_cols), [pa.array(v, pa.string()) for v in known_labels.values()]
    slots = sum(len(v) for v in values)
    schema = StructType([*StructType.fromDDL("token string").fields, *(rows.schema.fields[:-1] if joint else []),
                         *StructType.fromDDL("n bigint" if joint else "n array<bigint>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, int] = {}
        docs, words_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts, waiting = [], 0

        def rows_of(tokens: pa.Array, place: np.ndarray, own: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of pairs in the order of the tokens' places."""
            labels_of = np.array(list(known), np.int64).reshape(len(known), heads)
            if joint:
                named = [v.take(pa.array(labels_of[own, k], mask=labels_of[own, k] < 0)) for k, v in enumerate(values)]
                yield pa.RecordBatch.from_arrays([tokens.take(pa.array(place)), *named, pa.array(n.astype(np.int64))], schema.names)
                return
            some = max(1, COUNTED_PAIRS // max(1, slots))
            for a in range(0, len(tokens), some):
                own_tokens, at = tokens[a:a + some], slice(*np.searchsorted(place, [a, a + some]))
                counts = np.zeros(len(own_tokens) * slots, np.int64)
                first = 0
                for k, v in enumerate(values):
                    label = labels_of[own[at], k]
                    has = label >= 0
                    cells = (place[at][has] - a) * slots + first + label[has]
                    counts += np.bincount(cells, n[at][has], len(counts)).astype(np.int64)
                    first += len(v)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own_tokens) + 1) * slots, pa.int32()), pa.array(counts))
                yield pa.RecordBatch.from_arrays([own_tokens, lists], schema.names)

        for batch in batches:
            codes = _label_codes(batch, known_labels, known)
            docs, words_of = (np.r_[x, np.zeros(len(known) - len(x), np.int64)] for x in (docs, words_of))
            docs += np.bincount(codes, minlength=len(known))
            for start, texts in _text_slices(batch.column(heads)):
                for words, at in _text_parts(texts, ngram):
                    own = codes[start + at]
                    words_of += np.bincount(own, minlength=len(known))
                    words = words.dictionary_encode()
                    pairs, n = np.unique(words.indices.to_numpy().astype(np.int64) * len(known) + own, return_counts=True)
                    if len(pairs):
                        parts.append((words.dictionary, pairs // len(known), pairs % len(known), n))
                    waiting += len(pairs)
                    if waiting >= COUNTED_PAIRS:
                        yield from rows_of(*_merged_counts(parts, len(known)))
                        parts, waiting = [], 0
        if parts:
            yield from rows_of(*_merged_counts(parts, len(known)))
        for token, n in ((None, docs), ("", words_of)):
            if len(n):
                yield from rows_of(pa.array([token], pa.string()), np.zeros(len(n), np.int64), np.arange(len(n)), n)

    return rows.mapInArrow(run, schema)


def count_naive_bayes(train: DataFrame, key_col: str, text_col: str, head_cols: list[str],
                      ngram: int = 1, labels: dict[str, list[str]] | None = None) -> NaiveBayesCounts:
    """F1 (a), counting: one plan for all heads; the counts are materialised
    in the checkpoint folder, so scoring never re-reads the training text.

    The training text is counted where it is, some megabytes at a time, into a
    token's counts for every class of every head, so a token in a third of all
    documents is few rows a task. The rows meet by token, once. Per-head token
    counts and the vocabulary are read from their sums, the class table from
    two of them, which carry the numbers of documents and of tokens.

    ``labels`` may name the labels that each head can have, in any order; a
    label that is not there ends the job. Without it a pass over the heads
    finds them first, which costs much where they follow from the text.
    """
    labels = {h: sorted(set(labels[h])) for h in head_cols} if labels is not None else _known_labels(train, head_cols)
    slots = [(h, c) for h, values in labels.items() for c in values]
    sums = [F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(len(slots))]
    rows = _word_counts(train, text_col, head_cols, ngram, labels).repartition("token").groupBy("token").agg(*(sums or [F.lit(0)]))
    by_token = stored(rows.select("token", F.array(*[F.col(f"n{i}") for i in range(len(slots))]).cast("array<bigint>").alias("n"))
                      .withColumn("seen", F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)))
    words = by_token.where(F.col("token") != "")
    totals = by_token.where(F.col("token").isNull() | (F.col("token") == "")).select(
        F.col("token").isNull().alias("_docs"), F.posexplode("n").alias("_k", "n"))
    n_docs, n_tokens = (F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint") for c in (F.col("_docs"), ~F.col("_docs")))
    head, name = (F.get(F.array(*[F.lit(s[j]) for s in slots]), F.col("_k")) if slots else F.lit(None).cast("string") for j in (0, 1))
    class_counts = cut_lineage(totals.groupBy("_k").agg(n_docs.alias("n_docs"), n_tokens.alias("n_tokens")).where(F.col("n_docs") > 0)
                               .select(head.alias("head"), name.alias("class"), "n_docs", "n_tokens"))
    joint = _word_counts(train, text_col, head_cols, ngram, labels, joint=True)
    base = (joint.where(F.col("token").isNull() | (F.col("token") != "")).repartition("token")
            .groupBy("token", *head_cols).agg(F.sum("n").alias("n")))
    return NaiveBayesCounts(class_counts, words, slots, words.count(), ngram, base)


def train_naive_bayes(train: DataFrame, key_col: str, text_col: str, head_cols: list[str],
                      alpha: float = 1.0, ngram: int = 1, labels: dict[str, list[str]] | None = None) -> NaiveBayesModel:
    """F1 (a): count, then take the parameters for ``alpha``."""
    return count_naive_bayes(train, key_col, text_col, head_cols, ngram, labels).model(alpha)


def _ln(x: float) -> float:
    import math
    return math.log(x)


def document_tokens(df: DataFrame, key_col: str, text_col: str, ngram: int = 1) -> DataFrame:
    """``(key, token, cnt)``; a document without tokens has one null token."""
    return (df.select(key_col, F.explode_outer(feature_tokens(text_col, ngram)).alias("token"))
            .groupBy(key_col, "token").agg(F.count(F.lit(1)).alias("cnt")))


def naive_bayes_scores(df: DataFrame, key_col: str, text_col: str, model: NaiveBayesModel,
                       heads: list[str] | None = None, dense: bool = True,
                       counts: DataFrame | None = None) -> DataFrame:
    """``(key, head, class, score)`` for every class of every head.

    ``dense`` adds up, where the texts are, the weights of the frequent tokens
    for all classes (zeros where a class never saw the token); only other words
    are joined with one row per vocabulary token, and one aggregate per
    document follows. For heads of very many classes ``dense=False`` joins with
    one row per (class, token) instead; the scores are equal. ``counts`` may
    bring the token counts (:func:`document_tokens`), which are joined.
    The class table (number of classes rows) is model metadata.
    """
    classes = model.classes()
    picked = [(i, r) for i, r in enumerate(classes) if heads is None or r["head"] in heads]
    if not picked:
        key = df.schema[key_col]
        return df.sparkSession.createDataFrame(
            [], StructType([key]).add("head", "string").add("class", "string").add("score", "double"))
    slots = [i for i, _ in picked]
    if not dense:
        tc = counts if counts is not None else document_tokens(df, key_col, text_col, model.ngram)
        return _sparse_scores(tc, key_col, model, [r for _, r in picked])
    docs = _counted_sums(counts, key_col, model, slots) if counts is not None else _class_sums(df, key_col, text_col, model, slots)
    per_class = F.array(*[F.struct(
        F.lit(r["head"]).alias("head"), F.lit(r["class"]).alias("class"),
        (F.lit(float(r["log_prior"])) - F.coalesce(F.col("len"), F.lit(0)) * F.lit(float(r["log_denom"]))
         + F.coalesce(F.col(f"s{i}"), F.lit(0.0))).alias("score"))
        for i, r in picked])
    return docs.select(key_col, F.inline(per_class))


def _counted_sums(tc: DataFrame, key_col: str, model: NaiveBayesModel, slots: list[int]) -> DataFrame:
    """:func:`_class_sums` of token counts. A left join: a document without
    any vocabulary token keeps its row (length 0, null sums). Tokens that were
    frequent in training are not shuffled by token."""
    return (join_frequent(tc, model.dense_weights()[1], "token", "seen", key_col)
            .groupBy(key_col).agg(F.sum(F.when(F.col("w").isNotNull(), F.col("cnt"))).alias("len"),
                                  *[F.sum(F.col("cnt") * F.col("w")[i]).alias(f"s{i}") for i in slots]))


def _text_parts(texts: pa.Array, ngram: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The tokens of :func:`feature_tokens` from lower-cased texts, each with its
    text's place, in the order of the texts: words, then pairs of words."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
    words, rows = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    words, rows = words.filter(full), rows[full.to_numpy(zero_copy_only=False)]
    yield words, rows
    if ngram > 1 and len(words) > 1:
        same = rows[:-1] == rows[1:]
        yield pc.binary_join_element_wise(words[:-1], words[1:], " ").filter(pa.array(same)), rows[:-1][same]


def _class_sums(df: DataFrame, key_col: str, text_col: str, model: NaiveBayesModel, slots: list[int]) -> DataFrame:
    """``key, len, s<i>``: the in-vocabulary words of each document and the sum
    of their weights for the classes ``slots``. Frequent tokens are weighed
    where the text is, one row a text; only the others are shuffled, and one
    aggregate adds up the rows of a key. A document without any vocabulary
    token keeps its row."""
    shared, others = model.held_weights(slots)
    ngram, width, joins = model.ngram, len(slots), others is not None
    rows = df.select(key_col, F.lower(F.col(text_col)).alias("_text"))
    schema = StructType([rows.schema[key_col], *StructType.fromDDL("_len bigint, _sums array<double>, _rare array<string>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = shared.value
        for batch in batches:
            for words, at in _text_parts(batch.column(1), ngram):
                places = pc.index_in(words, value_set=known)
                found = places.is_valid().to_numpy(zero_copy_only=False)
                place, row = places.filter(pa.array(found)).to_numpy(), at[found]
                sums = np.zeros((batch.num_rows, width))
                for a in range(0, len(row), WORDS_AT_ONCE):
                    own = row[a:a + WORDS_AT_ONCE]
                    starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    sums[own[starts]] += np.add.reduceat(weights[place[a:a + WORDS_AT_ONCE]], starts)
                rare = words.filter(pa.array(~found)) if joins else words[:0]
                ends = np.cumsum(np.r_[0, np.bincount(at[~found], minlength=batch.num_rows)]) if joins else np.zeros(batch.num_rows + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.bincount(row, minlength=batch.num_rows).astype(np.int64)),
                     pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), width).cast(pa.list_(pa.float64())),
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), rare)], schema.names)

    met = rows.mapInArrow(run, schema)
    parts = met.select(key_col, "_len", "_sums")
    if joins:
        met = stored(met)  # numbers and the other words, not the text
        rare = met.select(key_col, F.explode("_rare").alias("token")).join(others, "token")
        parts = met.select(key_col, "_len", "_sums").unionByName(
            rare.select(key_col, F.lit(1).cast("bigint").alias("_len"), F.col("w").alias("_sums")))
    return parts.groupBy(key_col).agg(F.sum("_len").alias("len"), *[F.sum(F.col("_sums")[k]).alias(f"s{i}") for k, i in enumerate(slots)])


def naive_bayes_sums(df: DataFrame, key_col: str, text_col: str, model: NaiveBayesModel, heads: list[str]) -> DataFrame:
    """``key, len, sums``: what each text adds to its document's scores, one
    value for each class of ``heads`` in the model's order. Texts of a document
    may be scored one by one: a class' score is its prior, plus the sums, minus
    ``len`` times its ``log_denom``."""
    slots = [i for i, r in enumerate(model.classes()) if r["head"] in heads]
    sums = _class_sums(df, key_col, text_col, model, slots)
    return sums.select(key_col, F.coalesce("len", F.lit(0)).alias("len"),
                       F.array(*[F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i in slots]).cast("array<double>").alias("sums"))


def _sparse_scores(tc: DataFrame, key_col: str, model: NaiveBayesModel, class_rows: list) -> DataFrame:
    """Join counts to ``(class, token)`` weights directly."""
    heads = sorted({r["head"] for r in class_rows})
    lens = (tc.join(model.vocab.withColumn("_in", F.lit(1)), "token", "left")
            .groupBy(key_col).agg(F.sum(F.coalesce(F.col("_in"), F.lit(0)) * F.col("cnt"))
                                  .alias("len")))
    class_arr = F.array(*[F.struct(F.lit(c["head"]).alias("head"), F.lit(c["class"]).alias("class"),
                                   F.lit(float(c["log_prior"])).alias("log_prior"),
                                   F.lit(float(c["log_denom"])).alias("log_denom"))
                          for c in class_rows])
    base = (lens.select(key_col, "len", F.inline(class_arr))
            .select(key_col, "head", "class",
                    (F.col("log_prior") - F.col("len") * F.col("log_denom")).alias("s")))
    matched = (tc.join(model.token_params.where(F.col("head").isin(heads)), "token")
               .groupBy(key_col, "head", "class")
               .agg(F.sum(F.col("cnt") * F.col("lw")).alias("s")))
    return (base.unionByName(matched)
            .groupBy(key_col, "head", "class").agg(F.sum("s").alias("score")))


def argmax_rows(scores: DataFrame, group_cols: list[str], class_col: str = "class",
                score_col: str = "score", out_col: str = "pred",
                decimals: int = SCORE_DECIMALS) -> DataFrame:
    """F5 on rows: best score per group, ties to the smallest class."""
    order = F.struct(-F.round(score_col, decimals), F.col(class_col))
    return scores.groupBy(*group_cols).agg(F.min_by(F.col(class_col), order).alias(out_col))


def argmax_array(arr: Column | str) -> Column:
    """F5 on arrays: 0-based index of the first maximum."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return (F.array_position(a, F.array_max(a)) - 1).cast("bigint")


def class_probabilities(scores: DataFrame, key_col: str) -> DataFrame:
    """Softmax of the scores inside ``(key, head)`` (groups of #classes rows)."""
    w = Window.partitionBy(key_col, "head")
    mx = F.max("score").over(w)
    e = F.exp(F.col("score") - mx)
    return scores.withColumn("prob", e / F.sum(e).over(w))


def joint_loss(scores: DataFrame, truth: DataFrame, key_col: str, head_cols: list[str]) -> DataFrame:
    """mean cross-entropy per head and their sum (``head = 'sum'``), over
    all rows of the truth: a row whose class the model does not know has the
    floor's probability."""
    probs = class_probabilities(scores, key_col)
    t = _stack_heads(truth, head_cols, key_col)
    prob = F.greatest(F.coalesce("prob", F.lit(0.0)), F.lit(LOSS_FLOOR))
    per_head = (t.join(probs, [key_col, "head", "class"], "left")
                .groupBy("head").agg(F.avg(-F.log(prob)).alias("loss")))
    total = per_head.agg(F.sum("loss").alias("loss")).select(F.lit("sum").alias("head"), "loss")
    return per_head.unionByName(total)


def select_best_candidate(losses: DataFrame, candidate_col: str, loss_col: str = "loss") -> DataFrame:
    """flag the candidate with the lowest validation loss (ties -> the
    smallest candidate value)."""
    best = losses.agg(F.min_by(F.col(candidate_col), F.struct(loss_col, candidate_col)).alias("_b"))
    return losses.join(best, F.col(candidate_col) == F.col("_b"), "left") \
        .select(*losses.columns, F.col("_b").isNotNull().alias("is_best"))


def wide_predictions(preds: DataFrame, key_col: str, heads: list[str], prefix: str = "pred_") -> DataFrame:
    """One row per key with a ``<prefix><head>`` column for each head."""
    return preds.groupBy(key_col).agg(*[F.max(F.when(F.col("head") == h, F.col("pred"))).alias(f"{prefix}{h}")
                                        for h in heads])


def results_table(truth: DataFrame, preds: DataFrame, key_col: str, heads: list[str]) -> DataFrame:
    """G1: decoded truth and prediction of each head, one row per key."""
    true = truth.select(key_col, *[F.col(h).alias(f"true_{h}") for h in heads])
    return true.join(wide_predictions(preds, key_col, heads), key_col).select(
        key_col, *[c for h in heads for c in (f"true_{h}", f"pred_{h}")])


def predict_table(table: DataFrame, model: NaiveBayesModel, head: str, key_col: str, text_col: str,
                  out_col: str) -> DataFrame:
    """the table's rows with the predicted class of one head, null where
    the key is null. Only key and text take part in the scoring."""
    scores = naive_bayes_scores(table.select(key_col, text_col), key_col, text_col, model, heads=[head])
    return table.drop(text_col).join(argmax_rows(scores, [key_col], out_col=out_col), key_col, "left")


def look_up_codes(preds: DataFrame, codes: dict[str, DataFrame], defaults: dict[str, str], key_col: str) -> DataFrame:
    """F8: each head's prediction through the saved code tables and back, the
    head's default where a code or label is unknown."""
    from moodframe.operators.prep import decode_labels, encode_labels

    heads = list(codes)
    out = encode_labels(wide_predictions(preds, key_col, heads, prefix=""), codes, prefix="code_")
    out = out.select(key_col, *[f"code_{h}" for h in heads])
    for h in heads:
        out = decode_labels(out, f"code_{h}", codes[h], h).withColumn(h, F.coalesce(F.col(h), F.lit(defaults[h])))
    return out.select(key_col, *heads)


# --------------------------------------------------------------- vectors
def _mean_vector(vec_col: str) -> Column:
    """The element-wise mean of array vectors, one aggregate per group."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vec_col).cast("array<double>"))))


def class_centroids(vectors: DataFrame, vec_col: str, label_col: str,
                    decimals: int = 6) -> DataFrame:
    """Linear head parameters from class centroids: ``w`` = element-wise mean
    (rounded), ``b = -1/2 w.w`` (a nearest-centroid rule as a linear layer)."""
    w = (vectors.groupBy(label_col).agg(_mean_vector(vec_col).alias("_m"))
         .select(label_col, F.transform("_m", lambda m: F.round(m, decimals)).alias("w")))
    return w.withColumn("b", -0.5 * F.aggregate("w", F.lit(0.0), lambda acc, x: acc + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def linear_head_logits(vectors: DataFrame, key_col: str, vec_col: str,
                       head: DataFrame, label_col: str) -> DataFrame:
    """``logits`` array (classes in label order) of ``w.x + b``.

    The head, model parameters of (#classes x dim) values, reaches the rows as
    one scalar subquery; nothing is collected."""
    params = head.select(F.array_sort(F.collect_list(F.struct(
        F.col(label_col).alias("label"), "w", F.col("b").cast("double").alias("b"))))).scalar()
    return vectors.select(key_col, vec_col, params.alias("_head")).select(
        key_col, F.transform("_head", lambda p: dot(F.col(vec_col), p["w"]) + p["b"]).alias("logits"),
        F.transform("_head", lambda p: p["label"]).alias("labels"))


def sequence_pooling(vectors: DataFrame, seq_col: str, pos_col: str, vec_col: str) -> DataFrame:
    """per sequence, the vector at the first position, at the last
    position, and the element-wise mean."""
    ends = vectors.groupBy(seq_col).agg(
        F.min_by(F.struct(pos_col, vec_col), F.col(pos_col)).alias("first"),
        F.max_by(F.struct(pos_col, vec_col), F.col(pos_col)).alias("last"))
    mean = vectors.groupBy(seq_col).agg(_mean_vector(vec_col).alias("mean"))
    return ends.join(mean, seq_col)


def compare_models(metric_tables: dict[str, DataFrame]) -> DataFrame:
    """union of per-model metric tables ``(head, accuracy, macro_f1)``,
    ranked by macro F1 within each head."""
    parts = [t.select(F.lit(name).alias("model"), "*") for name, t in metric_tables.items()]
    u = reduce(DataFrame.unionByName, parts)
    return u.withColumn("rank", F.rank().over(
        Window.partitionBy("head").orderBy(F.desc("macro_f1"))).cast("bigint"))


def train_logistic_heads(train: DataFrame, text_col: str, head_cols: list[str],
                         num_features: int = 1 << 14, max_iter: int = 20):
    """F1 (b): ``pyspark.ml`` pipelines (tokens -> HashingTF -> IDF ->
    multinomial LogisticRegression), one per head. The tokens are taken once,
    for all heads."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, StringIndexer

    base = train.select(*head_cols, word_tokens(text_col).alias("_tokens"))
    hashed = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features).transform(base)
    hashed = stored(hashed.select(*head_cols, "_tf"))  # term counts, not the text
    # a task's gradient has the model's size: no more tasks than keep the cores busy
    tasks = TASKS_A_CORE * train.sparkSession.sparkContext.defaultParallelism
    hashed = hashed.coalesce(tasks) if hashed.rdd.getNumPartitions() > tasks else hashed
    models = {}
    for h in head_cols:
        pipe = Pipeline(stages=[
            StringIndexer(inputCol=h, outputCol=f"_y_{h}", stringOrderType="alphabetAsc",
                          handleInvalid="keep"),
            IDF(inputCol="_tf", outputCol="_x"),
            LogisticRegression(featuresCol="_x", labelCol=f"_y_{h}", family="multinomial",
                               maxIter=max_iter, predictionCol=f"_p_{h}",
                               probabilityCol=f"_prob_{h}", rawPredictionCol=f"_raw_{h}"),
        ])
        models[h] = pipe.fit(hashed.where(F.col(h).isNotNull()))
    return models


def predict_logistic_heads(df: DataFrame, key_col: str, text_col: str, models: dict,
                           num_features: int = 1 << 14) -> DataFrame:
    """``(key, head, pred)`` of logistic heads, as :func:`argmax_rows` gives
    for naive Bayes; the heads' truth columns need not be there."""
    from pyspark.ml.feature import HashingTF

    base = df.select(key_col, word_tokens(text_col).alias("_tokens"))
    hashed = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features).transform(base).select(key_col, "_tf")
    hashed = stored(hashed)  # read by every head
    parts = []
    for h, m in models.items():
        index, idf, lr = m.stages
        names = F.array(*[F.lit(x) for x in index.labels])
        out = lr.transform(idf.transform(hashed))
        parts.append(out.select(key_col, F.lit(h).alias("head"), F.get(names, F.col(f"_p_{h}").cast("int")).alias("pred")))
    return reduce(DataFrame.unionByName, parts)


def save_logistic_heads(models: dict, path: str) -> None:
    """A3 for logistic heads: one pipeline folder per head."""
    for h, m in models.items():
        m.write().overwrite().save(f"{path}/logistic/{h}")


def load_logistic_heads(path: str, heads: list[str]) -> dict:
    """A4 for logistic heads."""
    from pyspark.ml import PipelineModel
    return {h: PipelineModel.load(f"{path}/logistic/{h}") for h in heads}
