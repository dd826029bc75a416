"""The live conversation state: the processor against sums over the kept turns,
and a query whose timer clears an idle conversation."""

from __future__ import annotations

import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from moodframe.operators import conversation as H
from moodframe.operators import models as M
from moodframe.operators import scoring as S
from moodframe.session import scratch_dir
from moodframe.sources import fixtures as fx
from moodframe.streaming import conversations as ST

CONV = "conv_id bigint, turn bigint, role string, text string"


class Values:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Maps(dict):
    containsKey = dict.__contains__
    getValue = dict.__getitem__
    updateValue = dict.__setitem__
    removeKey = dict.__delitem__

    def iterator(self):
        return iter(list(self.items()))

    def keys(self):
        return iter(list(dict.keys(self)))


def processor(idle_ms=None):
    p = ST.ConversationTotals(idle_ms)
    timers = []
    p.init(SimpleNamespace(getMapState=lambda *a: Maps(), getValueState=lambda *a: Values(), listTimers=lambda: iter(timers),
                           registerTimer=timers.append, deleteTimer=timers.remove))
    return p, timers


def plain(rows):
    """Totals of all rows seen, from the rows themselves."""
    exits = [r.turn for r in rows if r.leaves and r.turn is not None]
    cut = min(exits, default=None)
    kept = [r for r in rows if cut is None or r.turn is not None and r.turn < cut]
    emotions = {}
    for r in kept:
        if r.emotion is not None:
            emotions.setdefault(r.emotion, []).append(r.turn)
    return (len(rows), cut, len(kept), sum(r.words for r in kept),
            [pytest.approx(sum(r.sums[k] for r in kept), abs=1e-9) for k in range(2)] if kept else [],
            {e: (len(t), min((x for x in t if x is not None), default=None)) for e, t in emotions.items()})


@pytest.mark.parametrize("seed", range(30))
def test_totals_equal_sums_over_kept_turns(seed):
    rng = random.Random(seed)
    p, _ = processor()
    seen = []
    for _ in range(rng.randrange(1, 8)):
        new = [SimpleNamespace(turn=rng.choice([None, *range(12)]), leaves=rng.random() < 0.08, emotion=rng.choice([None, "joy", "fear"]),
                               words=rng.randrange(5), sums=[rng.random(), rng.random()]) for _ in range(rng.randrange(1, 6))]
        seen += new
        (out,) = p.handleInputRows((7,), iter(new), None)
        got = (out.n_seen, out.cut, out.n_kept, out.words, out.sums,
               {e: (n, t) for e, n, t in zip(out.emotions, out.counts, out.first_turns)})
        assert got == plain(seen)
        # only turns before the cut are held
        assert all(out.cut is None or not k[1] and k[0] < out.cut for k in p.turns.keys())


def test_a_timer_replaces_the_one_before_and_clears():
    p, timers = processor(1000)
    now = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 5)
    row = SimpleNamespace(turn=1, leaves=False, emotion="joy", words=2, sums=[1.0])
    list(p.handleInputRows((1,), iter([row]), now))
    now = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 50)
    list(p.handleInputRows((1,), iter([row]), now))
    assert timers == [1050] and len(p.turns) == 1
    assert list(p.handleExpiredTimer((1,), now, None)) == []
    assert not p.totals.exists() and not p.turns


@pytest.fixture(scope="module")
def nb(spark):
    train = spark.createDataFrame([(1, "and la", "INTJ"), (2, "der is", "ENFP")], "doc_id bigint, t string, type string")
    return M.train_naive_bayes(train, "doc_id", "t", ["type"])


def test_a_late_exit_takes_later_turns_out(spark, nb):
    scorer = S.LexiconScorer(fx.lexicon(spark))
    landings = [[(1, 4, "user", "is is der"), (2, 0, "user", "and la")], [(1, 1, "user", "and la"), (1, 2, "assistant", "la and la")],
                [(1, 3, "user", "bye now"), (2, 1, "user", "is")]]
    src, work = scratch_dir(spark, "late-exit"), scratch_dir(spark, "late-exit")
    for rows in landings:
        spark.createDataFrame(rows, CONV).coalesce(1).write.mode("append").parquet(src)
    got = {r.conv_id: r for r in ST.run_conversation_stream(spark, src, CONV, scorer, nb, work_dir=work, batches_per_update=1).collect()}
    every = spark.createDataFrame([r for rows in landings for r in rows], CONV)
    want = {r.conv_id: r for r in H.conversation_summary(H.conversation_cut(H.conversation_turns(every)), scorer, nb).collect()}
    for c in (1, 2):
        assert (got[c].personality, got[c].dominant_emotion, got[c].emoji) == (want[c].personality, want[c].dominant_emotion, want[c].emoji)
    assert (got[1].n_seen, got[1].n_kept, got[1].ended, got[1].text) == (4, 2, True, "and la la and la")
    # an update has no text, and totals only
    updates = spark.read.parquet(f"{work}/updates")
    assert "text" not in updates.columns and updates.where("conv_id = 1").count() == 3


def test_nothing_has_landed(spark, nb):
    src = scratch_dir(spark, "no-turns")
    spark.createDataFrame([], CONV).write.parquet(src)
    assert ST.run_conversation_stream(spark, src, CONV, S.LexiconScorer(fx.lexicon(spark)), nb).collect() == []


def test_an_idle_conversation_begins_anew(spark):
    src, work = scratch_dir(spark, "idle"), scratch_dir(spark, "idle")
    def land(turn):
        row = [Row(conv_id=1, turn=turn, leaves=False, emotion="joy", words=1, sums=[1.0])]
        spark.createDataFrame(row, ST.SCORED).coalesce(1).write.mode("append").parquet(src)
    def latest():
        seen = spark.read.schema(ST.OUTPUT).parquet(f"{work}/updates").collect()
        return sorted((r.n_updates, r.n_seen) for r in seen)
    land(1)
    own = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ST.STATE_STORE)
    q = (ST.conversation_totals(spark.readStream.schema(ST.SCORED).parquet(src), 1500).writeStream.outputMode("update")
         .foreachBatch(lambda b, n: ST.write_batch(b, n, f"{work}/updates")).option("checkpointLocation", f"{work}/c").start())
    try:
        def wait(done, seconds=60):
            end = time.time() + seconds
            while time.time() < end:
                try:
                    if done():
                        return
                except Exception:  # no folder yet, or one being replaced
                    pass
                time.sleep(0.5)
            raise AssertionError(latest())
        wait(lambda: latest() == [(1, 1)])
        time.sleep(6)  # several micro-batches past the timer
        land(2)
        wait(lambda: latest() == [(1, 1), (1, 1)])
    finally:
        q.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", own)
