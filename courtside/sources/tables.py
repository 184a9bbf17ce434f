"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def read_seasons(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    """Season-partitioned parquet; only the wanted seasons are listed and read."""
    return spark.read.parquet(root).where(F.col("season").between(first, last))


def write_seasons(df: DataFrame, root: str) -> None:
    """Parquet partitioned by season, a season's rows spread over many writers."""
    spread = df.withColumn("_spread", F.pmod(F.xxhash64(*df.columns), F.lit(64)))
    spread.repartition("season", "_spread").drop("_spread").write.mode("overwrite").partitionBy(
        "season"
    ).parquet(root)


def read_sheet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """An exported spreadsheet (CSV with a header) with declared types."""
    return spark.read.csv(path, header=True, schema=schema)


def publish(df: DataFrame, name: str, sort_cols: Sequence[str], n: int | None = None) -> None:
    """Replace a table all-or-nothing, physically ordered, with fresh statistics.

    The ordered data is written completely to a staging table first; the old
    table keeps its name until then and is only dropped once the finished one
    has taken its place. A failed write leaves the old table and no staging table. Range partitioning on all sort columns keeps a frequent
    first column from filling one file. :func:`file_ranges` shows the order.
    """
    spark = df.sparkSession
    stage_name, old_name = f"{name}_stage", f"{name}_old"
    ordered = df.repartitionByRange(*([n] if n else []), *sort_cols).sortWithinPartitions(*sort_cols)
    spark.sql(f"DROP TABLE IF EXISTS {stage_name}")
    try:
        ordered.write.format("parquet").saveAsTable(stage_name)
    except Exception:
        spark.sql(f"DROP TABLE IF EXISTS {stage_name}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {old_name}")
    replaced = spark.catalog.tableExists(name)
    if replaced:
        spark.sql(f"ALTER TABLE {name} RENAME TO {old_name}")
    try:
        spark.sql(f"ALTER TABLE {stage_name} RENAME TO {name}")
    except Exception:
        if replaced:
            spark.sql(f"ALTER TABLE {old_name} RENAME TO {name}")
        raise
    spark.sql(f"DROP TABLE IF EXISTS {old_name}")
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")


def file_ranges(table: DataFrame, sort_cols: Sequence[str]) -> DataFrame:
    """Per file of a table that was read from files: ``path``, ``n_rows``, ``lowest`` and ``highest`` (structs of the sort columns)."""
    at = F.struct(*sort_cols)
    return table.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(at).alias("lowest"), F.max(at).alias("highest"))


def files_in_order(table: DataFrame, sort_cols: Sequence[str]) -> DataFrame:
    """One row: ``n_files`` and ``in_order``, whether the files' ranges meet at their edges at most, so that a filter on the
    first sort columns reads few of them. One row per file is ordered, whatever the rows."""
    along = Window.orderBy("lowest", "highest")
    gaps = file_ranges(table, sort_cols).withColumn("before", F.lag("highest").over(along))
    return gaps.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.bool_and(F.col("before").isNull() | (F.col("before") <= F.col("lowest"))), F.lit(True)).alias("in_order"))


def write_bucketed(df: DataFrame, name: str, buckets: int, keys: Sequence[str], sort_cols: Sequence[str] = ()) -> DataFrame:
    """Store a table in ``buckets`` files by the hash of ``keys`` (sorted by ``sort_cols`` inside) and return a reader on it.

    Joins, aggregates and windows by exactly these keys need no exchange. Rows are dealt by the bucket's hash before they are written, so
    every bucket is one file. Take keys of which no single value holds a large part of the rows.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, *keys).write.format("parquet").bucketBy(buckets, *keys)
    (writer.sortBy(*sort_cols) if sort_cols else writer).saveAsTable(name)
    return spark.table(name)


def publish_lineups(lineups: DataFrame) -> None:
    """The lineup table and its two dimensions."""
    from ..plans.lineups import lineup_dim, lineup_players

    publish(
        lineups, "lineups_lookup",
        ["game_id", "team_id", "quarter", "end_game_seconds_remaining", "player_id"],
    )
    table = lineups.sparkSession.table("lineups_lookup")
    publish(lineup_dim(table), "lineup_dim", ["lineup_hash"])
    publish(lineup_players(table), "lineup_players", ["lineup_hash", "player_id"])


def write_csv(df: DataFrame, path: str, order: Sequence) -> None:
    """Sorted CSV export with NULL as an empty cell."""
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")
