"""The pipeline against plain Python, its stages one after the other."""

from __future__ import annotations

import os
import re
import shutil
import subprocess
import sys

from pyspark.sql import functions as F

import corpus_pipeline
from conftest import ROOT
from moodframe.llm import toxicity
from moodframe.llm.common import documents
from moodframe.llm.packing import default_tokenizer, word_ids

SF = "/root/testdata/sf0.01"


def shingles(text: str, pattern: str) -> set:
    words = re.findall(pattern, text.lower())
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows: dict[int, str], model, items: list[str]) -> dict[int, str]:
    rows = {k: t for k, t in rows.items() if model.score(*model.sentence_scores(t)) < 0.5}
    last: dict[str, int] = {}
    for k, t in rows.items():
        key = t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        last[key] = max(k, last.get(key, k))
    rows = {k: rows[k] for k in sorted(last.values())}
    sets, group = {k: shingles(t, r"[^\x20\x09-\x0D]+") for k, t in rows.items()}, {k: k for k in rows}
    where: dict = {}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)
    for k, s in sets.items():
        for other in {o for x in s for o in where[x] if o < k}:
            shared = len(s & sets[other])
            if 100 * shared >= 80 * (len(s) + len(sets[other]) - shared) and group[k] != group[other]:
                low, high = sorted((group[k], group[other]))
                group = {n: low if g == high else g for n, g in group.items()}
    rows = {k: t for k, t in rows.items() if group[k] == k}
    word = r"[^\W_]+"
    items = [s for s in (shingles(t, word) for t in items) if all(len(x) == 5 for x in s)]
    return {k: t for k, t in rows.items() if all(len(s & shingles(t, word)) < 0.8 * len(s) for s in items)}


def test_run_against_plain_python(spark):
    docs = documents(spark, SF)
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = expected(rows, toxicity.trained(spark, docs, SF), items)
    got = corpus_pipeline.run(spark, SF).collect()
    encode = word_ids(default_tokenizer())
    assert 0 < len(want) < len(rows)
    assert {(r.doc_id, r.start, r.length) for r in got} == {
        (k, at, min(2048, len(ids) - at)) for k, t in want.items() for ids in [encode(t)] for at in range(0, len(ids), 2048)}
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 2048) + 1


ROWS = [(1, None, "x", 0), (1, None, "x", 0), (2, "", None, 1), (None, "a b c d e f g", "x", 2), (3, "A b c d e f g", "x", 3),
        (4, "a b c d e f g h", "x", 4), (4, "a b c d e f g h", "x", 4), (5, "word " * 60_000, "x", 5)]


def test_stages_keep_columns_and_bear_edge_rows(spark):
    schema = "doc_id long, text string, score string, `a b` int"
    docs = spark.createDataFrame(ROWS, schema)
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.where("doc_id > 9"), docs.withColumn("kept", F.lit("k")).withColumn("first", F.lit(1))):
            out = stage(spark, table, SF)
            n = out.count()
            assert n == 0 if table.count() == 0 else n > 0, name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.schema.names == table.schema.names and out.dtypes == table.dtypes, name
    deduped = corpus_pipeline.drop_exact_copies(spark, docs, SF)
    assert sorted((r.doc_id, r.text) for r in deduped.collect() if r.text != "word " * 60_000) == [
        (2, ""), (3, "A b c d e f g"), (4, "a b c d e f g h")]
    near = corpus_pipeline.drop_near_copies(spark, docs, SF).collect()
    assert sorted(((r.doc_id, len(r.text or "")) for r in near), key=str) == sorted(
        [(1, 0), (1, 0), (2, 0), (3, 13), (4, 15), (5, 300_000)], key=str)


def test_stages_keep_values_of_any_type(spark):
    """Extra columns come back as they were: longs beyond 2**53 beside nulls,
    late timestamps, decimals, maps and binaries."""
    docs = spark.createDataFrame(ROWS[3:7], "doc_id long, text string, score string, n int").selectExpr(
        "if(doc_id is null, doc_id, doc_id + 9007199254740990) as doc_id", "text", "if(n = 3, null, 9007199254740993) as big", "timestamp'9999-12-31 23:59:59' as late",
        "date'0001-01-01' as early", "cast('12345678901234567890.123456789' as decimal(38, 9)) as exact", "map('a', 1, 'b', null) as m",
        "X'00FF' as bytes", "cast(null as array<struct<a: bigint>>) as nested", "cast('nan' as double) as broken", "timestamp_ntz'1700-01-01 00:00:00' as ntz")
    same = "to_json(struct(*)), hex(bytes)"
    before = {tuple(r) for r in docs.selectExpr(*same.split(", ")).collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        after = {tuple(r) for r in out.selectExpr(*same.split(", ")).collect()}
        assert after and after <= before, name


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 89 and not any(k.startswith('op') and k[2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env=dict(os.environ, PYTHONPATH=""))
    code = ("import __spark_entry__ as e; q = e.queries(); assert 'pipeline' in q and "
            "sorted(int(k[2:].split('_')[0]) for k in q if k[:2] == 'op' and k[2].isdigit()) == list(range(1, 14))")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
