"""The package must import and run in any session: without the Spark jars at
hand at import time, and without a configured checkpoint folder."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import ROOT

from moodframe.sources.fixtures import spark_stop_words


def test_stop_words_equal_sparks_default(spark):
    jvm = spark.sparkContext._jvm
    default = list(jvm.org.apache.spark.ml.feature.StopWordsRemover.loadDefaultStopWords("english"))
    assert spark_stop_words() == default


def test_import_reads_no_jar():
    code = ("import glob, zipfile\n"
            "glob.glob = lambda *a, **k: []\n"
            "import __spark_entry__ as e\n"
            "assert len(e.queries()) >= 89 and len(e.oracle_sql()) >= 88\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_runs_without_a_checkpoint_setting(tmp_path):
    code = ("from pyspark.sql import SparkSession\n"
            "import __spark_entry__ as e\n"
            "s = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')\n"
            "     .config('spark.sql.shuffle.partitions', '4').getOrCreate())\n"
            "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
            "assert e.entry(s).count() == 200\n")
    env = dict(os.environ, SPARK_CONF_DIR=str(tmp_path))
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=env, check=True, timeout=300)
