"""The query catalogue: one query per operator, over the fixture graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import names
from ..functions.text import capitals, saturating_minus, upper
from ..operators import clean, paths, search, titles
from ..sources import dump, gzindex, store
from ..streaming import ingest
from . import fixtures
from .fixtures import Fixture

#: Languages that a user prefers, the first that there is.
PREFERRED = ("it-IT", "fr-CA", "ja")


def _ids(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


def page_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).page.groupBy(F.col("namespace").cast("long").alias("namespace")).agg(F.count("*").alias("n_titles"))


def page_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.violations(Fixture(spark, sf_dir).page, ["namespace", "title"], "page_id").agg(F.count("*").alias("violations"))


def redirect_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.violations(Fixture(spark, sf_dir).resolved, ["source"], "target").agg(F.count("*").alias("violations"))


def linktarget_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.violations(Fixture(spark, sf_dir).linktargets, ["linktarget_id"], "page_id").agg(F.count("*").alias("violations"))


def build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of redirects before and after compression, and of links before and after repeated ones are dropped."""
    fx = Fixture(spark, sf_dir)
    every = clean.link_reasons(fx.pagelinks, fx.linktargets, fx.redirects).where("reason is null")
    count = lambda df, name: df.agg(F.count("*").alias(name))
    sides = (("redirects", fx.resolved, fx.redirects), ("links", every, fx.links))
    rows = [count(a, "before").crossJoin(F.broadcast(count(b, "after"))).select(F.lit(kind).alias("kind"), "before", "after") for kind, a, b in sides]  # one row each
    return rows[0].unionByName(rows[1]).withColumn("dropped", saturating_minus(F.col("before"), F.col("after")))


def checksum_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    table = spark.sql(fixtures.SUMS.replace("FROM supplier", "FROM {supplier}"), supplier=supplier).orderBy("line").coalesce(1)
    path = session.shared_path(spark, "sums")
    table.select(F.concat_ws("  ", F.sha1("content"), "name")).write.text(path)
    return dump.checksums(spark, path)


def _escaped(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def dump_rows(fx: Fixture, relation: str) -> DataFrame:
    """The fixture's rows of a relation in the syntax of a dump."""
    text = lambda *parts: F.concat(F.lit("("), F.concat_ws(",", *(p.cast("string") for p in parts)), F.lit(")"))
    col, lit = F.col, F.lit
    if relation == "page":
        rest = (lit("0"), lit("1"), lit("0.5"), lit("'20240101000000'"), lit("NULL"), lit("7"), lit("9"), lit("'wikitext'"), lit("NULL"))
        return fx.page.select(text(col("page_id"), col("namespace"), _escaped(col("title")), *rest).alias("row"))
    if relation == "redirect":
        return fx.redirect.where("rd_title is not null").select(text(col("rd_from"), col("rd_namespace"), _escaped(col("rd_title")), lit("NULL"), lit("NULL")).alias("row"))
    if relation == "linktarget":
        return fx.linktarget.select(text(col("lt_id"), col("lt_namespace"), _escaped(col("lt_title"))).alias("row"))
    return fx.pagelinks.select(text(col("pl_from"), col("pl_from_namespace"), col("pl_target_id")).alias("row"))


# Rows that are no rows of their relation, or hold a number out of range.
BROKEN = {
    "page": ("(1,0,NoQuotes,0,1,0.5,'1',NULL,1,1,NULL,NULL)", "(4294967296,0,'big',0,1,0.5,'1',NULL,1,1,NULL,NULL)"),
    "redirect": ("(42,0,'Foo'bar',NULL,NULL)", "(4294967296,0,'big',NULL,NULL)"),
    "linktarget": ("(10,0,NoQuotes)", "(18446744073709551616,0,'big')"),
    "pagelinks": ("(11,22,-7)", "(4294967296,0,7)"),
}


def _dumped(spark: SparkSession, sf_dir: str, relation: str, packed: bool = True) -> DataFrame:
    """Parsed rows of the fixture's relation, written as dump lines and read again."""
    path = session.shared_path(spark, "dump")
    rows = dump_rows(Fixture(spark, sf_dir), relation).unionByName(spark.createDataFrame([(r,) for r in BROKEN[relation]], "row string"))
    lines = rows.select(F.concat(F.lit(f"INSERT INTO `{relation}` VALUES "), F.col("row"), F.lit(";")).alias("value"))
    lines.write.text(path, compression="gzip" if packed else "none")
    return dump.parse(dump.lines(spark, path), relation)


def _roundtrip(relation: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _dumped(spark, sf_dir, relation).where("not malformed").drop("malformed")
        return rows.select(*(F.col(c).cast("long").alias(c) if not c.endswith("title") else F.col(c) for c in rows.columns))

    query.__name__ = f"dump_roundtrip_{relation}"
    return query


def parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx, out = Fixture(spark, sf_dir), None
    for relation in BROKEN:
        parsed = _dumped(spark, sf_dir, relation)
        rows = parsed.where("not malformed").drop("malformed")
        reasons = {
            "page": lambda r: r.select(F.lit(None).cast("string").alias("reason")),
            "redirect": lambda r: clean.redirect_reasons(r, fx.page).select("reason"),
            "linktarget": lambda r: clean.linktarget_reasons(r, fx.page).select("reason"),
            "pagelinks": lambda r: clean.link_reasons(r, fx.linktargets, fx.redirects).select("reason"),
        }[relation](rows)
        stats = dump.statistics(parsed, relation, reasons)
        out = stats if out is None else out.unionByName(stats)
    return out.select("relation", "reason", "n", F.round("share", 9).alias("share"))


def redirect_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).resolved


def redirect_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixture(spark, sf_dir)
    return clean.redirect_reasons(fx.redirect, fx.page).groupBy(F.coalesce("reason", F.lit("stored")).alias("reason")).agg(F.count("*").alias("n"))


def redirect_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).redirects


def linktarget_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).linktargets.select(F.col("linktarget_id").cast("long").alias("linktarget_id"), "page_id")


def linktarget_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixture(spark, sf_dir)
    return clean.linktarget_reasons(fx.linktarget, fx.page).groupBy(F.coalesce("reason", F.lit("stored")).alias("reason")).agg(F.count("*").alias("n"))


def links_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixture(spark, sf_dir)
    return clean.resolved_links(fx.pagelinks, fx.linktargets, fx.redirects)


def link_skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixture(spark, sf_dir)
    return clean.link_reasons(fx.pagelinks, fx.linktargets, fx.redirects).groupBy(F.coalesce("reason", F.lit("stored")).alias("reason")).agg(F.count("*").alias("n"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).links


def incoming_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.incoming(Fixture(spark, sf_dir).links).select(F.col("target").alias("page_id"), F.size("sources").cast("long").alias("n"), _ids("sources").alias("ids"))


def outgoing_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.outgoing(Fixture(spark, sf_dir).links).select(F.col("source").alias("page_id"), F.size("targets").cast("long").alias("n"), _ids("targets").alias("ids"))


def _stored(spark: SparkSession, sf_dir: str) -> store.Database:
    """The fixture graph, written to a database, published and opened."""
    fx = Fixture(spark, sf_dir)
    folder, name = session.shared_path(spark, "db"), names.Metadata("en", "20240101")
    draft = store.draft_of(folder, name)
    store.write_redirects(fx.redirects, draft)
    store.write_links(fx.links, draft)
    return store.open_database(spark, store.publish(spark, folder, name))


def lookup_redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).redirect(Fixture(spark, sf_dir).ids).select("page_id", F.col("target").alias("value"))


def lookup_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).incoming_links(Fixture(spark, sf_dir).ids).select("page_id", _ids("sources").alias("value"))


def lookup_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).outgoing_links(Fixture(spark, sf_dir).ids).select("page_id", _ids("targets").alias("value"))


def indexed_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redirect and neighbours of every hundredth page, from the files that can hold them."""
    db, out = _stored(spark, sf_dir), None
    asked = Fixture(spark, sf_dir).page.where("page_id % 100 = 0").select("page_id")
    kinds = (("redirect", db.redirect(asked).select("page_id", F.col("target").cast("string").alias("value"))), ("incoming", db.incoming_links(asked).select("page_id", _ids("sources").alias("value"))), ("outgoing", db.outgoing_links(asked).select("page_id", _ids("targets").alias("value"))))
    for kind, found in kinds:
        found = found.select("page_id", F.lit(kind).alias("kind"), "value")
        out = found if out is None else out.unionByName(found)
    return out


def list_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's incoming list, counted over its parts; no part is longer than the bound."""
    rows = _stored(spark, sf_dir).incoming.select("target", F.size("sources").alias("size"))
    return rows.groupBy(F.col("target").alias("page_id")).agg(F.sum("size").cast("long").alias("n"), (F.max("size") <= store.PART).alias("bounded"))


def dump_split_pagelinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page links in one gzip file, which many tasks read."""
    path = session.shared_path(spark, "dump")
    rows = dump_rows(Fixture(spark, sf_dir), "pagelinks").unionByName(spark.createDataFrame([(r,) for r in BROKEN["pagelinks"]], "row string"))
    text = rows.select(F.concat(F.lit("INSERT INTO `pagelinks` VALUES "), F.col("row"), F.lit(";")).alias("value"))
    text.write.text(path, compression="gzip")
    file = gzindex.joined(spark, path, f"{session.shared_path(spark, 'file')}/pagelinks.sql.gz")
    found = dump.parse(gzindex.lines(spark, file, span=256 << 10), "pagelinks").where("not malformed")
    return found.select("pl_from", F.col("pl_target_id").cast("long").alias("pl_target_id"))


def _batched(spark: SparkSession, sf_dir: str) -> ingest.LinkFolder:
    """The fixture's links in five batches that overlap, out of order, some sent twice, merged halfway."""
    links, folder = Fixture(spark, sf_dir).links, ingest.LinkFolder(spark, session.shared_path(spark, "batches"), buckets=8)
    part = F.pmod(F.xxhash64("source", "target"), F.lit(5))
    for i in (3, 0, 4, 3, 1):
        folder.append(links.where((part == i) | (part == (i + 1) % 5)), i)
        if i == 4:
            folder.compact()
    folder.append(links.where((part == 0) | (part == 1)), 0)
    folder.append(links.where((part == 2) | (part == 3)), 2)
    return folder


def batched_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batched(spark, sf_dir).links()


def batched_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming lists of links that came in batches, merged on read."""
    parts = _batched(spark, sf_dir).lists("incoming")
    whole = parts.groupBy("target").agg(F.array_sort(F.flatten(F.collect_list("sources"))).alias("sources"))
    return whole.select(F.col("target").alias("page_id"), F.size("sources").cast("long").alias("n"), _ids("sources").alias("ids"))


def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.levels(Fixture(spark, sf_dir).links, 0).groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("n"))


def shortest_path_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).search.summary.withColumn("length", F.col("length").cast("long"))


def shortest_path_summary_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir, sparse=True).search.summary.withColumn("length", F.col("length").cast("long"))


def shortest_path_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).search.links


def shortest_path_summary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).search_all.summary.withColumn("length", F.col("length").cast("long"))


def shortest_path_links_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Fixture(spark, sf_dir).search_all.links


def shortest_path_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.adjacency(Fixture(spark, sf_dir).search).select("pair_id", "source", _ids("targets").alias("targets"))


def shortest_path_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.to_json(search.records(Fixture(spark, sf_dir).search, "en", "20240101"))


def _flat(found: DataFrame) -> DataFrame:
    return found.select("pair_id", F.col("rank").cast("long").alias("rank"), _ids("path").alias("path"))


def shortest_paths_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(paths.enumerate_paths(Fixture(spark, sf_dir).search, None))


def shortest_paths_first8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(paths.enumerate_paths(Fixture(spark, sf_dir).search))


def shortest_paths_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every path of every pair, each made from its number alone."""
    found = Fixture(spark, sf_dir).search
    every = found.summary.where("count > 0").select("pair_id", F.explode(F.sequence(F.lit(1).cast("long"), "count")).alias("rank"))
    return _flat(paths.numbered_paths(found, every))


def shortest_paths_middle_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle one of the paths of every pair, those of every hundredth page included."""
    found = Fixture(spark, sf_dir).search_all
    return _flat(paths.numbered_paths(found, found.summary.select("pair_id", F.expr("(count + 1) div 2").alias("rank"))))


def shortest_paths_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two paths of each pair at random."""
    return _flat(paths.sample_paths(Fixture(spark, sf_dir).search, 2, seed=7))


def shortest_paths_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixture(spark, sf_dir)
    return paths.with_titles(paths.enumerate_paths(fx.search), fx.page).select("pair_id", F.col("rank").cast("long").alias("rank"), F.col("position").cast("long").alias("position"), "page_id", "title")


def shortest_paths_page_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path as one answer: its pages with titles, in order."""
    fx = Fixture(spark, sf_dir)
    found = paths.titled_arrays(paths.with_titles(paths.enumerate_paths(fx.search), fx.page))
    shown = F.array_join(F.transform("pages", lambda p: F.concat_ws(":", p["id"].cast("string"), p["title"])), " > ")
    return found.select("pair_id", F.col("rank").cast("long").alias("rank"), shown.alias("pages"))


def pages_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.pages_to_fetch(paths.enumerate_paths(Fixture(spark, sf_dir).search)).select("pair_id", "page_id", F.col("first.rank").cast("long").alias("rank"), F.col("first.position").cast("long").alias("position"))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixture(spark, sf_dir)
    return paths.view_nodes(paths.with_titles(paths.enumerate_paths(fx.search), fx.page), fx.search.summary).withColumn("degree", F.col("degree").cast("long"))


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.view_edges(paths.enumerate_paths(Fixture(spark, sf_dir).search)).groupBy("pair_id", "source", "target").agg(F.count("*").alias("n"))


def path_summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Fixture(spark, sf_dir).search
    return paths.texts(found.summary, paths.enumerate_paths(found))


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.urls(Fixture(spark, sf_dir).page, "en")


def _html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


def title_fold_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against every title's upper-case form: equal but for case and accents."""
    session.importable(spark)
    page = _html_titles(spark, sf_dir)
    wanted = page.select(upper("title").alias("query")).distinct()
    return titles.matching(page, wanted).select("query", "page_id", "title")


def title_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.suggest(_html_titles(spark, sf_dir), "EN", 5)


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation"))
    return spark.sql(fixtures.NAMES.replace("FROM customer JOIN nation", "FROM {customer} JOIN {nation}"), customer=customer, nation=nation)


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("name", *names.database_parts(F.col("name")))


def title_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page whose title is the query's, here the least title in upper case, but for case and accents."""
    page = _html_titles(spark, sf_dir)
    least = page.where("title <> ''").agg(F.min("title").alias("title")).first()
    return titles.first_match(page, capitals(least.title or "EN"))


def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)


def dump_name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("name", *names.dump_parts(F.col("name")))


def catalog_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest(_names(spark, sf_dir))


def catalog_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.outdated(_names(spark, sf_dir), store.newest(_names(spark, sf_dir))).select("name")


def default_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.default_language(store.newest(_names(spark, sf_dir)), PREFERRED)


def link_sources_missing_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    fx = Fixture(spark, sf_dir)
    return fx.links.select(F.col("source").alias("page_id")).distinct().join(fx.page, "page_id", "left_anti").agg(F.count("*").alias("n"))


def random_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.random_page(Fixture(spark, sf_dir).page, seed=7).select("page_id")


def queries() -> dict:
    own = (
        page_index, page_key_check, *(_roundtrip(r) for r in BROKEN), parse_stats, redirect_resolve, redirect_skip_reasons, redirect_compress, linktarget_resolve,
        linktarget_skip_reasons, links_resolved, link_skip_reasons, links, incoming_adjacency, outgoing_adjacency, lookup_redirect, lookup_incoming, lookup_outgoing,
        shortest_path_summary_all, shortest_path_links_all, redirect_key_check, linktarget_key_check, build_counts, checksum_catalog, title_first_match, shortest_paths_page_arrays,
        bfs_levels, shortest_path_summary, shortest_path_summary_sparse, shortest_path_links, shortest_path_adjacency, shortest_path_json, shortest_paths_all,
        shortest_paths_first8, shortest_paths_numbered, shortest_paths_middle_all, shortest_paths_sample, shortest_paths_titled, pages_to_fetch, graph_nodes, graph_edges, path_summary_text, page_urls, title_fold_match, title_suggest,
        indexed_lookups, list_parts, dump_split_pagelinks, batched_links, batched_incoming, name_parse, dump_name_parse, catalog_newest, catalog_cleanup, default_language, link_sources_missing_page, random_page,
    )
    return {f.__name__: f for f in own}
