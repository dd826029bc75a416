from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from harness import compare, duck
from moodframe.llm import jaccard_join as J
from moodframe.llm.components import connected_components
from moodframe.llm.common import documents


def roots(n: int, links) -> list[int]:
    group = list(range(n))
    for a, b in links:
        group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    return group


def links_of(sets, percent):
    out = []
    for i in range(len(sets)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                out.append((j, i))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_tries_and_signatures_against_all_pairs(seed):
    rng = np.random.default_rng(seed)
    percent = (60, 80, 90)[seed % 3]
    base = [rng.integers(0, 2 ** 64, int(rng.integers(1, 200)), dtype=np.uint64) for _ in range(4)]
    sets = {}
    for _ in range(30):
        own = base[rng.integers(4)]
        kept = own[rng.random(len(own)) > rng.random() * 0.15]
        new = rng.integers(0, 2 ** 64, int(rng.integers(0, 2 + len(own) // 10)), dtype=np.uint64)
        own = np.unique(np.concatenate([kept, new]))
        if len(own):
            sets[own.tobytes()] = own
    sets = list(sets.values())
    links = links_of([set(s.tolist()) for s in sets], percent)
    got = J.links_within(np.arange(len(sets)), sets, np.arange(len(sets)), percent)
    assert len(got) < len(sets) and roots(len(sets), got) == roots(len(sets), links)
    frequent = np.unique(np.concatenate([b[:len(b) // 2] for b in base])) if seed % 2 else np.zeros(0, dtype=np.uint64)
    signer = J.Signer(percent, frequent)
    signs = [set(signer.signatures(s).tolist()) for s in sets]
    assert all(signs[a] & signs[b] for a, b in links)


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    edges += [tuple(map(int, e)) for e in 300 + rng.integers(0, 80, (60, 2))]
    want = roots(400, edges)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    assert got == {k: want[k] for k in {v for e in edges if e[0] != e[1] for v in e}}
    assert connected_components(spark.createDataFrame([], "x long, y long"), "x", "y").count() == 0


def base_text(k: int) -> list[str]:
    rng = np.random.default_rng(k)
    return [f"w{x}" for x in rng.integers(0, 5000, 120)]


def variants() -> list[tuple]:
    rng, rows = np.random.default_rng(9), []
    for k in range(6):
        for _ in range(12):
            words = base_text(k)
            for at in rng.integers(0, len(words), int(rng.integers(0, 5))):
                words[at] = f"x{rng.integers(10 ** 6)}"
            rows.append((" ".join(words) if rng.random() < 0.5 else "\t".join(words).upper()))
    rows += ["the shared line of five words and more " + t for t in rows[:20]]
    return [(k, t, "c", k) for k, t in enumerate(rows)] + [
        (1000, None, "c", 1), (1001, "", "c", 2), (1002, "\n \x0b", None, 3), (1003, "one two", "c", 4), (1004, "ONE\ttwo", "c", 5),
        (None, "one two", "c", 6), (None, "alone here", "c", 7), (1005, "one", "c", 8), (1005, "one", "c", 9),
        (1006, " ".join(f"y{i}" for i in range(30_000)), "c", 10), (1007, " ".join(f"y{i}" for i in range(29_900)), "c", 10)]


@pytest.mark.parametrize("block", [J.BLOCK_ELEMENTS, 700])
@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_rows_against_all_pairs(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(J, "BLOCK_ELEMENTS", block)
    rows = variants()
    docs = spark.createDataFrame(rows, "doc_id long, text string, size string, nth int").repartition(3)
    sets = []
    for _, text, *_ in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
        sets.append({tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))} if words else set())
    full = [k for k, s in enumerate(sets) if s]
    group = roots(len(rows), [(full[a], full[b]) for a, b in links_of([sets[k] for k in full], percent)])
    want = sorted(((r[0], len(sets[k]), min((rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None),
                                                   default=None)) for k, r in enumerate(rows)), key=str)
    got = J.jaccard_classes(docs, n=n, percent=percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert sum(r.first for r in got) == len(set(group))
    kept = J.one_of_each(docs, n=n, percent=percent)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(
        (min((rows[j][0] for j in range(len(rows)) if group[j] == g), key=lambda i: (i is None, i or 0)) for g in set(group)), key=str)


def test_frequent_ngrams_are_those_of_all_documents(spark):
    group = F.col("id") % 1000
    line = F.concat(*[F.concat(F.lit(f" {w}"), group) for w in ("common", "line", "here")])
    own = F.concat(*[F.concat(F.lit(f" {w}"), "id") for w in "uvw"])
    # 40 groups of 40 documents have a line of their own, 40 others have theirs in 39
    docs = spark.range(0, 40_000, 1, 5).select(F.concat(
        own, F.when((group < 40) | (group < 80) & (F.col("id") >= 1000), F.concat(line, line)).otherwise("")).alias("text"))
    lines = spark.range(40).select(F.concat(*[F.concat(F.lit(f" {w}"), "id") for w in ("common", "line", "here", "common", "line")]).alias("text"))
    want = {h % 2 ** 64 for r in lines.select(J.ngrams(F.col("text"), 3).alias("g")).collect() for h in r.g}
    got = J.frequent_ngrams(docs, "text", 3).tolist()
    assert len(want) == 120 and len(got) == 120 and set(got) == want and got == sorted(got)
    assert len(J.frequent_ngrams(docs.limit(0), "text", 3)) == 0


def test_empty_table(spark):
    assert J.jaccard_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_matches_its_twin(spark):
    sf = "/root/testdata/sf0.01"
    r = compare(spark, "op4_ngram_jaccard_join", sf, duck(sf))
    assert r["cols_match"] and r["hash_match"], r
