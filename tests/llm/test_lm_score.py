from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from moodframe.llm.common import documents
from moodframe.llm.lm_score import lm_scores, query

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class Trie:
    """The model by its definition, one symbol after the other."""

    def __init__(self, texts: list[bytes], order: int):
        self.order, self.counts = order, defaultdict(Counter)
        for context, symbol in (p for t in texts for p in self.positions(t)):
            for k in range(order + 1):
                self.counts[context[order - k:]][symbol] += 1

    def positions(self, text: bytes):
        data = bytes([0xFE]) * self.order + text + bytes([0xFF])
        for k in range(self.order, len(data)):
            yield data[k - self.order:k], data[k]

    def probability(self, context: bytes, symbol: int) -> float:
        p, ruled = 1.0, set()
        for k in range(self.order + 1):
            left = {s: n for s, n in self.counts.get(context[k:], {}).items() if s not in ruled}
            if left:
                total = 2 * sum(left.values())
                if symbol in left:
                    return p * (2 * left[symbol] - 1) / total
                p *= len(left) / total
                ruled |= set(left)
        return p / (255 - len(ruled))


def reference(rows, order):
    texts = [(t or "").encode().translate(LOWER) for _, t, _ in rows]
    model = Trie([t for t, r in zip(texts, rows) if not r[2]], order)
    counts: Counter = Counter()
    for t, r in zip(texts, rows):
        if not r[2]:
            counts.update([*t.split(), b""])
    n, v = sum(counts.values()), len(counts)
    for t, r in zip(texts, rows):
        words = [*t.split(), b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words)
        score = sum(math.log10(model.probability(c, s)) for c, s in model.positions(t))
        yield r[0], r[2], len(words), sum(counts[w] > 0 for w in words), n, base, score


EDGE = [(1, None, False), (2, "", True), (3, "Ab ab\x0bABC", False), (3, "Ab ab\x0bABC", False), (None, "zebra é\x00 日本", True),
        (5, "abracadabra " * 400, False), (6, "abracadabra Cadabra x", True), (7, " \n", False)]


@pytest.mark.parametrize("order,chunk", [(5, 1 << 20), (2, 3000), (3, 8)])
def test_scores_by_the_definition(spark, order, chunk):
    docs = spark.createDataFrame([(*r, "x", 1) for r in EDGE], "doc_id long, text string, held_out boolean, chunk string, n int")
    got = lm_scores(docs.repartition(2), order=order, chunk_bytes=chunk).collect()
    want = sorted(reference(EDGE, order), key=str)
    assert len(got) == len(EDGE)
    for g, w in zip(sorted((tuple(r) for r in got), key=str), want):
        assert g[:5] == w[:5] and np.allclose(g[5:], w[5:], atol=1e-9)


def test_probabilities_sum_to_one():
    model = Trie([b"abab", b"abc"], 3)
    for context in (b"\xfe\xfe\xfe", b"\xfeab", b"xyz", b"aba"):
        assert sum(model.probability(context, s) for s in range(256) if s != 0xFE) == pytest.approx(1)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ab", True)], "doc_id long, text string, held_out boolean")
    row = lm_scores(docs).first()
    assert (row.n_tokens, row.n_known, row.train_tokens) == (2, 0, 0)
    assert row.base_score == 0 and row.score == pytest.approx(-3 * math.log10(255))
    assert lm_scores(docs.where("doc_id > 1")).count() == 0


def test_held_out_texts_beat_the_base(spark):
    sf = "/root/testdata/sf0.1"
    rows = query(spark, sf).collect()
    texts = {r.doc_id: r.text for r in documents(spark, sf).select("doc_id", "text").collect()}
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    counts: Counter = Counter()
    for r in rows:
        if not r.held_out:
            counts.update([*texts[r.doc_id].encode().translate(LOWER).split(), b""])
    n, v = sum(counts.values()), len(counts)
    for r in rows[::50]:
        words = [*texts[r.doc_id].encode().translate(LOWER).split(), b""]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
