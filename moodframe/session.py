"""Session helpers: building a local session for tests/bench, the checkpoint
folder, and constant tables. Joins carry no broadcast hint: the planner and
AQE choose from the sizes they measure.

On a cluster the session comes from the launcher; nothing here overrides a
setting the cluster already made (``spark.checkpoint.dir`` in particular).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "moodframe") -> SparkSession:
    """A local session configured the way the library expects.

    AQE on (coalescing and skew-join splitting), UI off, Arrow on for the
    few pandas paths, UTC session time zone.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("MOODFRAME_DRIVER_MEM", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make the shared checkpoint folder known to the session and return it.

    ``spark.checkpoint.dir`` (or an already set checkpoint folder) always
    wins. Only a local master without either gets a fresh scratch folder; on a
    cluster that would be a machine-local folder, so it is an error there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if not current:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    master = sc.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="moodframe-ckpt-")
    sc.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder of this run below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def make_folder(spark: SparkSession, path: str) -> None:
    """An empty folder where there is none yet, on the path's file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)


def publish_folder(spark: SparkSession, path: str, write) -> bool:
    """Let ``write(folder)`` fill a staging folder beside ``path`` and publish
    it by one rename. Readers of ``path`` see all of it or nothing; where it is
    there already, it stays and nothing is written. Returns whether it was new."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        return False
    parent = target.getParent()
    staging = jvm.org.apache.hadoop.fs.Path(parent.getParent(), f"_staging-{uuid.uuid4().hex}")
    write(staging.toString())
    fs.mkdirs(parent)
    # a rename onto a folder that came meanwhile would move into it
    if fs.exists(target) or not fs.rename(staging, target):
        fs.delete(staging, True)
        return False
    return True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor
    loss, unlike a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once to a Parquet folder below the shared checkpoint
    folder. For large tables of counts that several steps read: smaller than a
    checkpoint, and a step reads only the columns that it needs."""
    path = scratch_dir(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small constant table as a SQL inline table (a JVM-side local
    relation with exact size statistics; no Python worker reads it).
    ``ddl`` is ``"name type, ..."`` with simple types."""
    fields = [f.strip().split(None, 1) for f in ddl.split(",")]
    names, types = [n for n, _ in fields], [t.strip() for _, t in fields]
    if not rows:
        return spark.createDataFrame([], ddl)

    def lit(v, t):
        if v is None:
            return f"CAST(NULL AS {t})"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"CAST({v!r} AS {t})"

    values = ", ".join("(" + ", ".join(lit(v, t) for v, t in zip(r, types)) + ")" for r in rows)
    cols = ", ".join(f"CAST(`{n}` AS {t}) AS `{n}`" for n, t in zip(names, types))
    return spark.sql(f"SELECT {cols} FROM VALUES {values} AS t({', '.join(f'`{n}`' for n in names)})")
