"""Merkle manifest against a plain tree walk."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from moodframe.llm import merkle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """Top node, and for every leaf the siblings left and right of each level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 3 * 3:k // 3 * 3 + 3]
            paths[i].append((run[:k % 3], run[k % 3 + 1:]))
            at[i] = k // 3
        nodes = [sha("".join(nodes[j:j + 3])) for j in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    """What the query returns for (doc_id, source, lang, n_chars, text) rows."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(((r[0] is not None, r[0] or 0, leaf(r)), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([k[2] for k, _ in sorted(groups[s], key=lambda g: g[0])]) for s in names]
    root, tops = tree([t[0] for t in trees])
    for name, (subroot, paths), top in zip(names, trees, tops):
        for (key, r), path in zip(sorted(groups[name], key=lambda g: g[0]), paths):
            now = key[2]
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in path + top:
                now = sha("".join([*left, now, *right]))
            siblings = "".join("".join(left + right) for left, right in path + top)
            yield r[0], key[2], subroot, root, sha(siblings), now, now == root


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(spark, rows, tmp_path, extra=""):
    path = f"{tmp_path}/{random.getrandbits(40)}"
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", extra)
    df.write.parquet(f"{path}/documents.parquet")
    return merkle.query(spark, path).select(*COLUMNS).collect()


def key(r):
    return (r[0] is not None, r[0] or 0, *r[1:])


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, None: 1}, {"a": 82, "b": 3, "": 1, None: 10, "é": 28, "z": 9, "B": 27, "c": 4},
                                   {f"s{k}": 1 + k % 2 for k in range(30)}])
def test_equals_plain_tree(spark, tmp_path, sizes):
    rng = random.Random(3)
    rows, ids = [], iter(rng.sample(range(-500, 10**6), sum(sizes.values())))
    for source, n in sizes.items():
        for _ in range(n):
            text = rng.choice([None, "", "a\nb", "\n", "words of it", "ü\n" * 5])
            rows.append((next(ids), source, rng.choice([None, "en"]), rng.choice([None, 7]), text))
    rng.shuffle(rows)
    got = run(spark, rows, tmp_path, "'x' as leaf")
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_null_ids_and_repeated_rows(spark, tmp_path):
    rows = [(None, "a", None, None, "x\n")] * 3 + [(5, "a", "en", 1, "t\n")] * 4 + [(2**53 + 1, None, None, None, None)]
    got = run(spark, rows, tmp_path)
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows), key=key)


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == []


def test_a_changed_leaf_or_sibling_is_found(spark, tmp_path):
    """The operator's own proofs: they lead from each leaf to the root, from
    any other digest elsewhere."""
    from pyspark.sql import functions as F
    rows = spark.range(40).select("id", F.expr("concat('s', id % 3)").alias("group"),
                                  F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("leaf"),
                                  F.lit(None).cast("int").alias("extra"))
    proved = merkle.manifest(rows)
    siblings, shape = F.col("siblings"), F.col("shape")
    other = F.concat(F.expr("substring(siblings, 1, 3)"), F.lit(b"\x00"), F.expr("substring(siblings, 5)"))
    got = proved.select((merkle.fold(F.col("leaf"), siblings, shape) == merkle.hex_text(F.col("root"))).alias("ok"),
                        (merkle.fold(F.col("subroot"), siblings, shape) == merkle.hex_text(F.col("root"))).alias("leaf_changed"),
                        (merkle.fold(F.col("leaf"), other, shape) == merkle.hex_text(F.col("root"))).alias("sibling_changed")).collect()
    assert len(got) == 40 and all(r.ok and not r.leaf_changed and not r.sibling_changed for r in got)
