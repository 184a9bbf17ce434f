"""Mergeable summaries: distinct counts and quantiles per season, stored once and merged over any range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes of the sketches. Distinct counts err by about 1.04 / sqrt(2**LG_CONFIG) (0.8 %), normalised ranks by about 2.3 / QUANTILE_K**0.9 (0.9 %).
LG_CONFIG, QUANTILE_K = 14, 400


def season_sketches(df: DataFrame, keys: Sequence[str], distinct: str, value: str) -> DataFrame:
    """Per group: ``n`` rows, ``ids`` (a sketch of the distinct values of ``distinct``), ``values`` (one of the distribution of ``value``).

    A few kilobytes a group, built with partial aggregation. NULLs are left out of the sketches.
    """
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(distinct, F.lit(LG_CONFIG)).alias("ids"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(QUANTILE_K)).alias("values"))


def merged(sketches: DataFrame, keys: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """Stored sketches merged per ``keys``: n, n_distinct and the named quantiles, without the rows they were built from."""
    whole = sketches.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.hll_sketch_estimate(F.hll_union_agg("ids", F.lit(True))).alias("n_distinct"),
        F.kll_merge_agg_double("values", F.lit(QUANTILE_K)).alias("_values"))
    picked = [F.kll_sketch_get_quantile_double("_values", F.lit(float(p))).alias(name) for name, p in probs.items()]
    return whole.select(*keys, "n", "n_distinct", *picked)
