"""Document fingerprints against a walk in plain Python."""

from __future__ import annotations

import hashlib
import random
import statistics

import pytest

from moodframe.llm import fingerprints as fp


def plain_fingerprint(text: str) -> bytes:
    """The walk step by step, with the emitted class of every step."""
    bits = hashlib.shake_256(b"walk").digest(fp.PERIOD * fp.CLASSES // 8)
    emitted, at, j = [], 0, 0
    classes = fp.classes_of(text).tolist()
    while at < len(classes):
        c = classes[at]
        emitted.append(c)
        k = (j % fp.PERIOD) * fp.CLASSES + c
        at += bits[k // 8] >> (7 - k % 8) & 1
        j += 1
    return bytes(int(fp._symbols()[n % 256, emitted[s]]) for n, s in enumerate(fp._samples().tolist()) if s < len(emitted))


def texts(seed=1, n=120, most=3000):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäß", k=rng.randrange(1, 9))) for _ in range(300)]
    return [" ".join(rng.choices(words, k=rng.randrange(1, most // 5))) for _ in range(n)]


def test_equals_a_walk_step_by_step(monkeypatch):
    some = [*texts(), "", "x", "日本語" * 50, "\U0001f600\n" * 30, "a" * 9000]
    want = [plain_fingerprint(t) for t in some]
    assert fp.fingerprints(some) == want
    monkeypatch.setattr(fp, "POSITIONS_AT_ONCE", 64)
    monkeypatch.setattr(fp, "FEW_TEXTS", 10)
    monkeypatch.setattr(fp, "PLAIN_POSITIONS", 100)
    assert fp.fingerprints(some) == want


def test_whole_texts_count():
    """A change anywhere in a long text changes the embedding from there on;
    its share of the samples follows."""
    text = texts(2, 1, 400_000)[0]
    other = texts(3, 1, 400_000)[0]
    for share in (0.25, 0.5, 0.75):
        cut = int(len(text) * share)
        a, b = fp.fingerprints([text, text[:cut] + other[:len(text) - cut]])
        assert abs(fp.likeness(a, b) - (share + (1 - share) * 0.13)) < 0.12


def test_edits_keep_likeness_and_others_do_not():
    rng = random.Random(5)
    base = texts(6, 60)
    near = []
    for t in base:
        s = list(t)
        for _ in range(max(1, len(s) // 200)):  # insertions, deletions, substitutions
            k = rng.randrange(len(s))
            s[k:k + rng.randrange(2)] = rng.choices("xyz", k=rng.randrange(2))
        near.append("".join(s))
    a, b = fp.fingerprints(base), fp.fingerprints(near)
    kept = [fp.likeness(x, y) for x, y in zip(a, b)]
    far = [fp.likeness(x, y) for x, y in zip(a, a[1:])]
    assert statistics.median(kept) > 0.75 and statistics.median(far) < 0.25
    shared = [bool(fp.bands(x) & fp.bands(y)) for x, y in zip(a, b)]
    assert sum(shared) >= 0.9 * len(shared)
    assert sum(bool(fp.bands(x) & fp.bands(y)) for x, y in zip(a, a[1:])) <= 0.1 * len(a)


def test_likeness():
    assert fp.likeness(b"", b"") == 1.0
    assert fp.likeness(b"", b"\1") == 0.0
    a = fp.fingerprints([texts()[0]])[0]
    assert fp.likeness(a, a) == 1.0


def plain(rows):
    """(doc_id, text) rows with distinct ids."""
    rows = sorted(rows, key=lambda r: -r[0])
    for k, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        new = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        a, b, c = (plain_fingerprint(t) for t in (text, new, after))
        yield (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), fp.text_of(a), fp.text_of(b), fp.likeness(a, b), fp.likeness(a, c))


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("chars", [fp.CHARS_AT_ONCE, 500])
def test_query_equals_plain(spark, monkeypatch, chars):
    monkeypatch.setattr(fp, "CHARS_AT_ONCE", chars)
    some = [*texts(7, 80, 800), "", None, "x", "line\nfeed", "日本語" * 20, "same text", "same text"]
    ids = random.Random(8).sample(range(-100, 2 ** 60), len(some) - 1) + [2 ** 53 + 1]
    rows = list(zip(ids, some))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'a' as kind", "1 as part", "2 as id").repartition(5)
    got = fp.fingerprint_edits(df)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == sorted(plain(rows))


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert fp.fingerprint_edits(empty).collect() == []
    one = fp.fingerprint_edits(spark.createDataFrame([(1, "abcd")], "doc_id bigint, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0 and one.same_next
    rows = [(None, "null"), (None, None), (2 ** 53 + 1, "a b"), (5, "dup"), (5, "dup")]
    got = fp.fingerprint_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (False, 0), (True, 5), (True, 5), (True, 2 ** 53 + 1)]
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 1
