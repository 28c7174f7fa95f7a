"""Finding pages by title, and small choices of the user interface."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions.text import fold, folded


def matching(page: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, page_id, title) of pages whose title is a query's, without regard to case and accents.

    Both sides are joined by their folded text, so this is an equality join.
    """
    session.importable(page.sparkSession)
    a = page.withColumn("_k", folded("title"))
    b = queries.select("query", folded("query").alias("_q"))
    return a.join(b, F.col("_k") == F.col("_q")).select("query", "page_id", "title")


def suggest(page: DataFrame, query: str, most: int = 5) -> DataFrame:
    """The first ``most`` pages whose title begins with the query: equal titles, then short ones, then by title and id."""
    session.importable(page.sparkSession)
    q = F.lit(fold(query))
    found = page.withColumn("_k", folded("title")).where(F.startswith("_k", q)).withColumn("_far", F.when(F.col("_k") == q, 0).otherwise(1))
    return found.orderBy("_far", F.length("title"), "title", "page_id").limit(most).select("page_id", "title")


def first_match(page: DataFrame, query: str, most: int = 5) -> DataFrame:
    """The first suggestion that is the query, or nothing."""
    return suggest(page, query, most).where(folded("title") == fold(query)).orderBy("title", "page_id").limit(1)


def random_page(page: DataFrame, seed: int | None = None, namespace: int = 0) -> DataFrame:
    """A random page of a namespace; with a seed, always the same one, however the pages are dealt out."""
    order = F.rand() if seed is None else F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("page_id").cast("string")))
    return page.where(F.col("namespace") == namespace).select("page_id", "title").orderBy(order, "page_id").limit(1)


def default_language(databases: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """The first preferred language whose first two letters stand in a code, else the first code."""
    rank = F.lit(len(preferred))
    for i, wanted in reversed(list(enumerate(preferred))):
        rank = F.when(F.contains("language_code", F.lit(wanted[:2])), i).otherwise(rank)
    return databases.orderBy(rank, "language_code").limit(1).select("language_code")
