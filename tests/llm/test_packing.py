from __future__ import annotations

import itertools
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from moodframe.llm.packing import default_tokenizer, fullest, pack, plan_bins, query, word_ids

TEXT = st.text(st.sampled_from("ab'sSt éÉßñ́\x1c\xa0\t\n.,!<|>endoftext9０ İΣς日\x00"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_word_ids_equal_the_tokenizers(text):
    encode = word_ids(default_tokenizer())
    assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids + [0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9), st.integers(0, 40))
def test_fullest_is_the_best_subset_sum(lengths, room):
    counts = np.bincount(lengths, minlength=41)
    used = fullest(counts, room)
    best = max(sum(c) for k in range(len(lengths) + 1) for c in itertools.combinations(lengths, k) if sum(c) <= room)
    assert sum(used) == best and (np.bincount(used, minlength=41) <= counts).all()


def check_bins(rows, capacity=2048):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_plan_places_every_piece():
    rng = np.random.default_rng(5)
    counts = np.bincount(np.minimum(rng.geometric(0.004, 5000), 2048), minlength=2049)
    plan, bins = plan_bins(counts)
    total = (counts * np.arange(2049)).sum()
    assert -(-total // 2048) <= bins <= -(-total // 2048) + 1
    assert len(plan_bins(np.zeros(2049))[0]) == 0


def test_round_trip_over_a_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = query(spark, sf).collect()
    tokenizer, tokens = Tokenizer.from_file(default_tokenizer()), 0
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    for key, text in docs.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        tokens += len(ids)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[start:start + 2048], dtype="<u4")
            r = pieces.pop((key, piece))
            assert (r.start, r.length, r.ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
    assert not pieces
    assert check_bins(rows) <= -(-tokens // 2048) + 1


def test_edge_rows(spark):
    rows = [(1, None, 1), (1, "", 2), (None, "a b", 3), (2, "ab " * 9000, 4)] + [(3, "x y", 5)] * 40
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int")
    got = pack(docs.repartition(5), default_tokenizer()).collect()
    assert len(got) == 2 + 1 + 5 + 40
    check_bins(got)
    assert sorted(r.length for r in got if r.doc_id == 1) == [1, 1]
    assert sorted((r.start, r.length) for r in got if r.doc_id == 2) == [(k * 2048, 2048) for k in range(4)] + [(8192, 809)]
    assert pack(docs.where("doc_id > 5"), default_tokenizer()).count() == 0
