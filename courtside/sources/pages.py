"""Web pages to tables, over a table of already fetched pages.

Cell and link lists belong to one page, so they are cut up in place: no
shuffle, and a page's rows never leave its task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the markup that is read
LIST_CELL = r"<li>(?:<a [^>]*>)?([^<]*)(?:</a>)?</li>"
TABLE_CELL = r"(?s)<td[^>]*>(.*?)</td>"
LINK = r'href="([^"]*)"'


def cells_to_rows(
    pages: DataFrame, html: str, k: int, key: str, pattern: str = TABLE_CELL
) -> DataFrame:
    """All cells of a page laid out row by row in ``k`` columns v1..vk."""
    cells = pages.select(key, F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("_c"))
    n_rows = F.ceil(F.size("_c") / k).cast("int")
    rows = F.when(n_rows > 0, F.sequence(F.lit(0), n_rows - 1)).otherwise(F.array().cast("array<int>"))
    return cells.select(key, "_c", F.explode(rows).alias("row")).select(
        key, "row",
        *[F.get("_c", F.col("row") * k + i).alias(f"v{i + 1}") for i in range(k)],
    )


def links(
    pages: DataFrame, html: str, key: str, pattern: str = LINK, skip: int = 0,
    match: str | None = None,
) -> DataFrame:
    """Links of a page with their position, first ``skip`` dropped, filtered."""
    found = pages.select(
        key, F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).alias("pos", "link")
    ).where(F.col("pos") >= skip)
    return found if match is None else found.where(F.col("link").rlike(match))


def bind_lists(pages: DataFrame, html: str, key: str, patterns: dict[str, str]) -> DataFrame:
    """Parallel lists of one page bound by position."""
    lists = [
        F.regexp_extract_all(html, F.lit(p), F.lit(1)).alias(n) for n, p in patterns.items()
    ]
    zipped = pages.select(key, F.posexplode(F.arrays_zip(*lists)).alias("pos", "_z"))
    return zipped.select(key, "pos", *[F.col(f"_z.{n}").alias(n) for n in patterns])
