"""Portable seeded hash: equal in Spark, DuckDB and plain Python, and a
function of the key alone (so results never depend on partitioning)."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_SEED = 42


def md5int(*parts: Column | str, seed: int = DEFAULT_SEED) -> Column:
    """60-bit non-negative BIGINT from md5 of ``'seed|p1|p2|...'``."""
    cols = [F.lit(str(seed))] + [F.col(p) if isinstance(p, str) else p for p in parts]
    key = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def md5int_sql(*parts: str, seed: int = DEFAULT_SEED) -> str:
    """The DuckDB twin of :func:`md5int` for SQL expressions ``parts``."""
    inner = " || '|' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5({inner}), 1, 15)) AS BIGINT)"


def md5int_py(*parts, seed: int = DEFAULT_SEED) -> int:
    key = "|".join([str(seed)] + [str(p) for p in parts])
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16)
