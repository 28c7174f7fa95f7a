"""From dump relations to a clean graph: titles to ids, redirect chains, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Namespaces that are broadcast; wikis have a few dozen.  Beyond, they are joined by a shuffle.
SPACES = 10_000


def _resolve(rows: DataFrame, page: DataFrame, namespace: str, title: str) -> DataFrame:
    """Add page_id of (namespace, title) and the reason why there is none."""
    spaces = cut(page.select(F.col("namespace").alias("_space")).distinct())
    if spaces.count() <= SPACES:  # most rows are of one namespace, which a shuffle would bring together
        spaces = F.broadcast(spaces)
    # pages are never broadcast: Spark would judge by their compressed files
    found = rows.join(page.select(F.col("namespace").alias("_n"), F.col("title").alias("_t"), "page_id").hint("merge"), (F.col(namespace) == F.col("_n")) & (F.col(title) == F.col("_t")), "left")
    found = found.drop("_n", "_t").join(spaces, F.col(namespace) == F.col("_space"), "left")
    reason = F.when(F.col("page_id").isNotNull(), None).when(F.col("_space").isNull(), "missing_target_namespace").otherwise("missing_target_title")
    return found.withColumn("reason", reason).drop("_space")


def redirect_reasons(redirect: DataFrame, page: DataFrame) -> DataFrame:
    """(source, target, reason): reason is null for redirects that are stored.

    Sources aren't looked up in ``page``; a redirect to itself is skipped here,
    before chains are followed.
    """
    found = _resolve(redirect, page, "rd_namespace", "rd_title").select(F.col("rd_from").alias("source"), F.col("page_id").alias("target"), "reason")
    return found.withColumn("reason", F.when(F.col("source") == F.col("target"), "self_redirect").otherwise(F.col("reason")))


def resolve_redirects(redirect: DataFrame, page: DataFrame) -> DataFrame:
    """(source, target) of the redirects with a target, as they stand."""
    return redirect_reasons(redirect, page).where("reason is null").select("source", "target").distinct()


def compress_redirects(redirects: DataFrame) -> DataFrame:
    """(source, target) with every source at its final page; what is on a cycle or leads into one is dropped.

    Pointer doubling: each round follows the pointers of the round before, so a
    chain of n takes log2(n) rounds.  Distances to a final page have no gaps, so
    once a round resolves nothing more, the rest is on or before cycles.
    """
    current = cut(redirects.select("source", "target"))
    left = None
    while True:
        successor = current.select(F.col("source").alias("_s"), F.col("target").alias("_t"))
        step = current.join(successor, F.col("target") == F.col("_s"), "left")
        open_ = step.where("_s is not null").count()
        if open_ == 0 or open_ == left:
            return step.where("_s is null").select("source", "target")
        left = open_
        current = cut(step.select("source", F.coalesce("_t", "target").alias("target")))


def linktarget_reasons(linktarget: DataFrame, page: DataFrame) -> DataFrame:
    """(linktarget_id, page_id, reason): reason is null for link targets with a page."""
    return _resolve(linktarget, page, "lt_namespace", "lt_title").select(F.col("lt_id").alias("linktarget_id"), "page_id", "reason")


def resolve_linktargets(linktarget: DataFrame, page: DataFrame) -> DataFrame:
    return linktarget_reasons(linktarget, page).where("reason is null").select("linktarget_id", "page_id").distinct()


def link_reasons(pagelinks: DataFrame, linktargets: DataFrame, redirects: DataFrame) -> DataFrame:
    """(source, target, reason) of every page link, both ends after redirects; self links are known only then.

    Sources aren't looked up in ``page``, and namespaces don't matter.
    """
    known = pagelinks.join(linktargets, F.col("pl_target_id") == F.col("linktarget_id"), "left")
    a = redirects.select(F.col("source").alias("_a"), F.col("target").alias("_at"))
    b = redirects.select(F.col("source").alias("_b"), F.col("target").alias("_bt"))
    ends = known.join(a, F.col("pl_from") == F.col("_a"), "left").join(b, F.col("page_id") == F.col("_b"), "left")
    out = ends.select(F.coalesce("_at", "pl_from").alias("source"), F.coalesce("_bt", "page_id").alias("target"))
    reason = F.when(F.col("target").isNull(), "missing_linktarget").when(F.col("source") == F.col("target"), "self_link")
    return out.withColumn("reason", reason)


def resolved_links(pagelinks: DataFrame, linktargets: DataFrame, redirects: DataFrame) -> DataFrame:
    """(source, target, n): each link with the number of rows that gave it."""
    kept = link_reasons(pagelinks, linktargets, redirects).where("target is not null and source <> target")
    return kept.groupBy("source", "target").agg(F.count("*").alias("n"))


def links(pagelinks: DataFrame, linktargets: DataFrame, redirects: DataFrame) -> DataFrame:
    """Distinct (source, target)."""
    return resolved_links(pagelinks, linktargets, redirects).select("source", "target")


def incoming(graph: DataFrame) -> DataFrame:
    """(target, sources): sorted distinct ids."""
    return graph.groupBy("target").agg(F.sort_array(F.collect_set("source")).alias("sources"))


def outgoing(graph: DataFrame) -> DataFrame:
    """(source, targets): sorted distinct ids."""
    return graph.groupBy("source").agg(F.sort_array(F.collect_set("target")).alias("targets"))


def violations(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys with more than one value; rows that repeat exactly are no violation."""
    return rows.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low < high").select(*keys)


def require_unique(rows: DataFrame, keys: list[str], value: str, what: str) -> None:
    bad = violations(rows, keys, value).limit(1).collect()
    if bad:
        raise ValueError(f"{what}: more than one {value} for {bad[0].asDict()}")


def require_rows(rows: DataFrame, what: str) -> int:
    """The number of rows; an empty table is an error, as a changed dump format would show like that."""
    n = rows.count()
    if not n:
        raise ValueError(f"{what} is empty; the dump's schema may have changed")
    return n
