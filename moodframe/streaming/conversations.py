"""Live conversation summaries with Structured Streaming.

Two queries. The first reads landed turns and scores each new turn once: its
emotion, and what its words add to the logarithms of the personality classes
(naive Bayes is a sum over words). A micro-batch is written to a staging folder
and published by one rename, so a repeated one changes nothing.

The second keeps, with ``transformWithState``, what a conversation's turns add
up to: a map state with the sums of each turn number, and one value with the
totals. Turns may arrive in any order. A turn before the cut adds its sums; an
exit turn that arrives late takes the turns from it on out again; turns after
the cut are dropped, as the cut only moves earlier. Texts are not state. In a
live query a timer clears a conversation that has been idle, and the state has a
time to live; a run over what has landed ends and has no use for either. Each update emits totals only; the final summary is a projection of the
latest ones, and the transcript is joined from the published turns.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from moodframe.functions.text import clean_text, emotion_to_emoji
from moodframe.operators.conversation import EXIT_WORDS, conversation_turns, is_exit
from moodframe.operators.models import SCORE_DECIMALS, NaiveBayesModel, naive_bayes_sums
from moodframe.operators.scoring import enrich_posts
from moodframe.session import cut_lineage, make_folder, publish_folder, scratch_dir

HEAD = "type"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# What a turn brings to the state (its text stays outside).
SCORED = "conv_id bigint, turn bigint, leaves boolean, emotion string, words bigint, sums array<double>"
PUBLISHED = SCORED + ", role string, text string"
_SUMS = "n bigint, words bigint, sums array<double>, emotions array<string>, counts array<bigint>"
TOTALS = ("n_seen bigint, cut bigint, n_kept bigint, words bigint, sums array<double>, emotions array<string>, "
          "counts array<bigint>, first_turns array<bigint>")
OUTPUT = "conv_id bigint, n_updates bigint, " + TOTALS


class ConversationTotals(StatefulProcessor):
    """Totals of one conversation."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # turns without a number have a key of their own
        self.turns = handle.getMapState("turns", "turn bigint, unnumbered boolean", _SUMS, self.idle_ms)
        self.totals = handle.getValueState("totals", "n_updates bigint, " + TOTALS, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if self.totals.exists():
            n_updates, n_seen, cut, n_kept, words, sums, emotions, counts, firsts = self.totals.get()
            total = _Sums(n_kept, words, list(sums), {e: [n, t] for e, n, t in zip(emotions, counts, firsts)})
        else:
            n_updates, n_seen, cut, total = 0, 0, None, _Sums()
        new: dict[tuple, _Sums] = {}
        before = cut
        for row in rows:
            n_seen += 1
            if row.leaves and row.turn is not None:
                cut = row.turn if cut is None else min(cut, row.turn)
            own = new.setdefault((row.turn or 0, row.turn is None), _Sums())
            own.add(1, row.words, row.sums, {row.emotion: [1, row.turn]} if row.emotion is not None else {})
        kept = {k: s for k, s in new.items() if cut is None or not k[1] and k[0] < cut}
        for k, own in kept.items():
            if self.turns.containsKey(k):
                have = _Sums.of(k, self.turns.getValue(k))
                have.merge(own)
                self.turns.updateValue(k, have.row())
            else:
                self.turns.updateValue(k, own.row())
            total.merge(own)
        if cut != before:
            # turns from the cut on go; sums are taken anew from those that stay
            gone = [k for k in map(tuple, self.turns.keys()) if k[1] or k[0] >= cut]
            for k in gone:
                self.turns.removeKey(k)
            if gone:
                total = _Sums()
                for k, value in sorted((tuple(k), v) for k, v in self.turns.iterator()):
                    total.merge(_Sums.of(k, value))
        n_updates += 1
        totals = (n_seen, cut, total.n, total.words, total.sums, list(total.emotions), [n for n, _ in total.emotions.values()],
                  [t for _, t in total.emotions.values()])
        self.totals.update((n_updates, *totals))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield Row(**dict(zip(_OUTPUT_NAMES, (key[0], n_updates, *totals))))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.turns.clear()
        self.totals.clear()
        return iter(())

    def close(self) -> None:
        pass


_OUTPUT_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


class _Sums:
    """Sums over turns: rows, words, per class, and for each emotion its count
    and first turn."""

    def __init__(self, n: int = 0, words: int = 0, sums: list | None = None, emotions: dict | None = None):
        self.n, self.words, self.sums, self.emotions = n, words, sums or [], emotions or {}

    @classmethod
    def of(cls, key: tuple, value) -> "_Sums":
        n, words, sums, emotions, counts = value
        turn = None if key[1] else key[0]
        return cls(n, words, list(sums), {e: [c, turn] for e, c in zip(emotions, counts)})

    def row(self) -> tuple:
        return self.n, self.words, self.sums, list(self.emotions), [n for n, _ in self.emotions.values()]

    def add(self, n: int, words: int, sums: list, emotions: dict) -> None:
        self.n += n
        self.words += words or 0
        if sums:
            self.sums = [a + b for a, b in zip(self.sums, sums)] if self.sums else list(sums)
        for e, (count, turn) in emotions.items():
            have = self.emotions.setdefault(e, [0, None])
            have[0] += count
            if turn is not None:
                have[1] = turn if have[1] is None else min(have[1], turn)

    def merge(self, other: "_Sums") -> None:
        self.add(other.n, other.words, other.sums, other.emotions)


def scored_turns(turns: DataFrame, scorer, nb_model: NaiveBayesModel, words: list[str] = EXIT_WORDS,
                 word_boundary: bool = False) -> DataFrame:
    """Every turn with what it adds to its conversation (``PUBLISHED``)."""
    rows = conversation_turns(turns).select("conv_id", "turn", "role", "text")
    rows = cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))
    emotions = enrich_posts(rows, scorer, ["_row"], "text").select("_row", "emotion")
    sums = naive_bayes_sums(rows.select("_row", clean_text("text").alias("_clean")), "_row", "_clean", nb_model, [HEAD])
    return rows.join(emotions, "_row", "left").join(sums, "_row", "left").select(
        "conv_id", "turn", is_exit(words=words, word_boundary=word_boundary).alias("leaves"), "emotion",
        F.coalesce("len", F.lit(0)).cast("bigint").alias("words"), "sums", "role", "text")


def conversation_totals(scored: DataFrame, idle_ms: int | None) -> DataFrame:
    """The stateful part as a streaming DataFrame (update mode) of ``OUTPUT``
    rows. After ``idle_ms`` without a turn a conversation's state goes; later
    turns begin a new one. A query with timers runs micro-batches for ever, also
    under ``availableNow``; pass None for one that is to end."""
    return scored.groupBy("conv_id").transformWithState(
        ConversationTotals(idle_ms), OUTPUT, outputMode="Update", timeMode="None" if idle_ms is None else "ProcessingTime")


def summaries(totals: DataFrame, nb_model: NaiveBayesModel) -> DataFrame:
    """H11 of the totals: personality from the class sums, the most frequent
    emotion (ties to the one seen first) and its emoji. A conversation without
    kept turns has neither."""
    picked = [r for r in nb_model.classes() if r["head"] == HEAD]
    scores = [F.struct(-F.round(F.lit(float(r["log_prior"])) - F.col("words") * F.lit(float(r["log_denom"]))
                                + F.coalesce(F.get("sums", F.lit(i)), F.lit(0.0)), SCORE_DECIMALS).alias("down"),
                       F.lit(r["class"]).alias("class")) for i, r in enumerate(picked)]
    personality = F.when(F.col("n_kept") > 0, F.array_min(F.array(*scores))["class"]) if scores else F.lit(None).cast("string")
    seen = F.transform(F.arrays_zip("emotions", "counts", "first_turns"),
                       lambda e: F.struct((-e["counts"]).alias("down"), e["first_turns"].alias("first"), e["emotions"].alias("emotion")))
    out = totals.select("conv_id", "n_seen", F.col("cut").isNotNull().alias("ended"), "n_kept", "cut",
                        personality.alias("personality"), F.array_min(seen)["emotion"].alias("dominant_emotion"))
    return out.withColumn("emoji", F.when(F.col("dominant_emotion").isNotNull(), emotion_to_emoji("dominant_emotion")))


def with_text(summary: DataFrame, published: DataFrame) -> DataFrame:
    """The kept turns' texts joined in turn order, from the published turns."""
    cuts = summary.select(F.col("conv_id").alias("_conv"), F.col("cut").alias("_cut"))
    kept = published.join(cuts, F.col("conv_id").eqNullSafe(F.col("_conv"))).where(
        F.col("_cut").isNull() | (F.col("turn") < F.col("_cut")))
    in_order = F.array_sort(F.collect_list(F.struct("turn", "text")))
    texts = kept.groupBy("_conv").agg(F.array_join(F.transform(in_order, lambda t: t["text"]), " ").alias("text"))
    return (summary.join(texts, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
            .select("conv_id", "n_seen", "ended", "n_kept", F.coalesce("text", F.lit("")).alias("text"),
                    "personality", "dominant_emotion", "emoji"))


def write_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch to its own folder, replacing an earlier attempt."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def publish_batch(rows: DataFrame, batch_id: int, path: str) -> None:
    """Write a micro-batch to a staging folder and publish it by a rename, once:
    a later attempt finds the folder there and leaves it."""
    publish_folder(rows.sparkSession, f"{path}/turns/batch_id={batch_id}", lambda at: rows.write.parquet(at))


def latest_totals(updates: DataFrame) -> DataFrame:
    """A conversation's totals: those of its latest update."""
    cols = [c for c in updates.columns if c not in ("conv_id", "batch_id")]
    best = updates.groupBy("conv_id").agg(F.max_by(F.struct(*cols), F.struct("batch_id", "n_updates")).alias("s"))
    return best.select("conv_id", *[F.col(f"s.{c}").alias(c) for c in cols])


def run_conversation_stream(spark: SparkSession, source_dir: str, schema: str, scorer, nb_model: NaiveBayesModel,
                            work_dir: str | None = None, files_per_batch: int = 1, batches_per_update: int | None = None) -> DataFrame:
    """Run both queries over a file source with ``Trigger.AvailableNow`` and
    return the final summary per conversation. ``batches_per_update`` published
    files go into one update of the state (default: all there are).

    The state lives in RocksDB, which the second query is started with; the
    session's own setting is put back."""
    work_dir = work_dir or scratch_dir(spark, "conversation-stream")
    for folder in ("turns", "updates"):  # there may be nothing to write into them
        make_folder(spark, f"{work_dir}/{folder}")
    landed = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source_dir)
    (landed.writeStream.foreachBatch(lambda batch, n: publish_batch(scored_turns(batch, scorer, nb_model), n, work_dir))
     .option("checkpointLocation", f"{work_dir}/checkpoint-turns").trigger(availableNow=True).start().awaitTermination())

    reader = spark.readStream.schema(SCORED)
    if batches_per_update:
        reader = reader.option("maxFilesPerTrigger", batches_per_update)
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name)
    spark.conf.set(name, STATE_STORE)
    try:
        (conversation_totals(reader.parquet(f"{work_dir}/turns"), None).writeStream.outputMode("update")
         .foreachBatch(lambda batch, n: write_batch(batch, n, f"{work_dir}/updates"))
         .option("checkpointLocation", f"{work_dir}/checkpoint-totals").trigger(availableNow=True).start().awaitTermination())
    finally:
        spark.conf.set(name, own)
    updates = spark.read.schema(OUTPUT + ", batch_id bigint").parquet(f"{work_dir}/updates")
    published = spark.read.schema(PUBLISHED).parquet(f"{work_dir}/turns")
    return with_text(summaries(latest_totals(updates), nb_model), published)
