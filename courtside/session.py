"""Session helpers: a tuned builder and the staging of reused intermediates.

Long chains (possessions -> lineups -> stints -> ratings) reuse the same
intermediate several times. ``stage`` writes such a table once, as parquet,
under the cluster's shared checkpoint folder, so later steps read it back
column-pruned and lost executors never force the whole chain to be recomputed.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_ROOT: dict[str, str] = {}


def build_session(app: str = "courtside", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans are designed for (all overridable)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the one the cluster names.

    Only a local-mode session (tests) without that setting gets a folder of our
    own; a cluster without it is an error, since a machine-local folder would
    not be visible to the other executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOT:
        _OWN_ROOT[app] = tempfile.mkdtemp(prefix="courtside-")
    return _OWN_ROOT[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a reader on it."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/courtside/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def own_database(spark: SparkSession) -> str:
    """A database of this session whose tables lie in the shared folder."""
    name = f"courtside_{re.sub(r'[^A-Za-z0-9]', '_', spark.sparkContext.applicationId)}"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{checkpoint_root(spark).rstrip('/')}/{name}'")
    return name


def discard(*staged: DataFrame) -> None:
    """Delete the folders of tables that :func:`stage` returned, once nothing that is still to run reads them."""
    for df in staged:
        jvm, path = df.sparkSession._jvm, getattr(df, "_staged_at", None)
        if path is not None:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
            df._staged_at = None
