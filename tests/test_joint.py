"""joint heads. Gradients against finite differences, the distributed
sum against one matrix computation, falling loss, best epoch."""

from __future__ import annotations

import numpy as np
import pytest

from moodframe.operators import joint as J

HEADS = ["type", "mood"]
LABELS = {"type": ["A", "B", "C"], "mood": ["x", "y"]}


def small(seed=1, buckets=7, rank=3):
    return J.new_model(LABELS, J.JointSettings(buckets=buckets, rank=rank, seed=seed))


def rows_of(texts):
    ids = np.concatenate([np.array(t, dtype=np.int64) for t in texts]) if texts else np.zeros(0, dtype=np.int64)
    return ids, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def test_gradient_equals_finite_differences():
    model = small()
    ids, offsets = rows_of([[0, 1, 1, 5], [], [6], [2, 3]])
    codes, scale = [np.array([0, 2, -1, 1]), np.array([1, -1, 0, 0])], [0.5, 2.0]
    losses, gradient = J.loss_and_gradient(model, ids, offsets, codes, scale)
    flat = model.flat()
    for k in range(len(flat)):
        shifted = []
        for step in (1e-6, -1e-6):
            moved = flat.copy()
            moved[k] += step
            shifted.append(sum(s * x for s, x in zip(scale, J.loss_and_gradient(model.with_flat(moved, 0), ids, offsets, codes, scale)[0])))
        assert gradient[k] == pytest.approx((shifted[0] - shifted[1]) / 2e-6, abs=1e-6)


def posts(spark, n=240, seed=4):
    """Both heads depend on the same hidden topic, each text has words of it."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        topic = int(rng.integers(3))
        words = [f"t{topic}w{rng.integers(6)}" if rng.random() < 0.4 else f"noise{rng.integers(40)}" for _ in range(int(rng.integers(0, 15)))]
        rows.append((k, " ".join(words) or None, "ABC"[topic] if k % 11 else None, "xy"[topic == 1]))
    return spark.createDataFrame(rows, "id long, text string, type string, mood string").repartition(5)


def test_summed_gradient_and_losses_equal_one_computation(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "WORDS_AT_ONCE", 20)
    model = small(buckets=32, rank=4)
    rows = J.hashed_rows(posts(spark), "id", "text", LABELS, 32)
    local = rows.collect()
    ids, offsets = rows_of([r.words for r in local])
    codes = [np.array([r[f"y{i}"] for r in local]) for i in range(2)]
    losses, gradient = J.loss_and_gradient(model, ids, offsets, codes, [0.1, 0.2])
    assert np.allclose(J.summed_gradient(rows, model, [0.1, 0.2]), gradient, atol=1e-9)
    got = {r.head: r.loss for r in J.mean_losses(rows, model).collect()}
    want = [x / (c >= 0).sum() for x, c in zip(losses, codes)]
    assert got == {"type": pytest.approx(want[0]), "mood": pytest.approx(want[1]), "sum": pytest.approx(sum(want))}


def test_loss_falls_and_the_best_epoch_is_published(spark, tmp_path):
    df = posts(spark)
    train, held = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    settings = J.JointSettings(buckets=256, rank=6, epochs=6, batches=4, rate=0.2)
    model = J.train_joint_heads(train, held, "id", "text", HEADS, settings, str(tmp_path / "joint"))
    losses = {(r.epoch, r.head): r for r in model.losses.collect()}
    epochs = sorted({e for e, _ in losses})
    summed = [losses[e, "sum"].loss for e in epochs]
    assert losses[epochs[-1], "sum"].train_loss < 0.6 * losses[0, "sum"].train_loss
    assert model.epoch == epochs[int(np.argmin(summed))] and [e for e in epochs if losses[e, "sum"].is_best] == [model.epoch]
    assert all(losses[e, "sum"].loss == pytest.approx(losses[e, "type"].loss + losses[e, "mood"].loss) for e in epochs)
    # the published candidate is the model that predicts
    again = J.load_candidate(model, spark, str(tmp_path / "joint"), model.epoch)
    assert np.array_equal(again.flat(), model.flat())
    preds = {(r.id, r.head): r.pred for r in J.predict_joint(held, "id", "text", model).collect()}
    truth = [(r.id, h, r[h]) for r in held.where("text is not null").collect() for h in HEADS if r[h] is not None]
    assert np.mean([preds[i, h] == y for i, h, y in truth]) > 0.8
    assert len(preds) == 2 * held.count()


def test_patience_ends_training(spark):
    df = posts(spark, 40)
    settings = J.JointSettings(buckets=16, rank=2, epochs=9, batches=1, patience=1, rate=5.0)
    model = J.train_joint_heads(df, df.limit(10), "id", "text", HEADS, settings)
    assert model.losses.select("epoch").distinct().count() < 10


def test_without_training_rows(spark):
    df = posts(spark, 10)
    model = J.train_joint_heads(df.where("id < 0"), df, "id", "text", HEADS, J.JointSettings(buckets=16, rank=2, epochs=2))
    assert model.epoch == 0 and {r.pred for r in J.predict_joint(df, "id", "text", model).collect()} == {None}
