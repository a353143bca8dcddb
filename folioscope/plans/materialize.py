"""Cutting lineage and checking sizes, safely on a cluster.

Everything written here goes to the shared folder that the cluster names in ``spark.checkpoint.dir``. Where that is unset,
one machine gets a private folder, which is removed at the end; a cluster gets an error, since tasks would write to their
own disks.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else on one machine a temporary one for this session."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        made = tempfile.mkdtemp(prefix="folioscope-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _FALLBACK[app] = f"file://{made}"
    return _FALLBACK[app]


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioscope-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_and_count(df: DataFrame, label: str, **what: Column) -> tuple[DataFrame, dict]:
    """:func:`materialize`, and the aggregates ``what`` of its rows, taken as they are written: no job of their own."""
    seen = Observation()
    out = materialize(df.observe(seen, *(c.alias(name) for name, c in what.items())), label)
    told = seen.get
    return out, {name: told.get(name) for name in what}


def broadcast_if_small(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, otherwise unchanged (a shuffle join).

    ``df`` should be materialized and narrow: it is counted here.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
