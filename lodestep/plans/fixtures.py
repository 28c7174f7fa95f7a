"""A page graph made of the standard tables: the four relations as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, search
from ..session import cut

PAGE = """
SELECT p_partkey AS page_id, p_size % 3 AS namespace,
       concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR(20))) AS title
FROM part
"""
REDIRECT = """
SELECT x.k AS rd_from, coalesce(t.namespace, 0) AS rd_namespace,
       CASE WHEN x.k % 100 = 95 THEN 'no_such_title' ELSE t.title END AS rd_title
FROM (SELECT p_partkey AS k, CASE p_partkey % 100
        WHEN 5 THEN p_partkey + 10 WHEN 15 THEN p_partkey + 10 WHEN 25 THEN p_partkey + 1
        WHEN 35 THEN p_partkey + 10 WHEN 45 THEN p_partkey + 10 WHEN 55 THEN p_partkey - 20
        WHEN 65 THEN p_partkey - 10 WHEN 75 THEN p_partkey WHEN 85 THEN p_partkey - 10
        ELSE p_partkey END AS tk
      FROM part WHERE p_partkey % 10 = 5) x
LEFT JOIN fx_page t ON t.page_id = x.tk
"""
LINKTARGET = """
SELECT 1000000 + p_partkey AS lt_id,
       CASE WHEN p_partkey % 41 = 7 THEN 99 ELSE p_size % 3 END AS lt_namespace,
       CASE WHEN p_partkey % 37 = 11 THEN concat('red_link_', CAST(p_partkey AS VARCHAR(20)))
            ELSE concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS VARCHAR(20))) END AS lt_title
FROM part
"""
PAGELINKS = """
SELECT a.l_partkey AS pl_from, 0 AS pl_from_namespace, 1000000 + b.l_partkey AS pl_target_id
FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
"""
SPARSE = " WHERE a.l_linenumber = 1"
VIEWS = {"fx_page": PAGE, "fx_redirect": REDIRECT, "fx_linktarget": LINKTARGET, "fx_pagelinks": PAGELINKS}

#: (pair_id, source_in, target_in): a link away, redirects at either end, a dropped cycle, equal ends.
PAIRS = ((1, 0, 100), (2, 1, 15), (3, 5, 0), (4, 3, 150), (5, 45, 46), (6, 10, 190), (7, 25, 26), (8, 85, 75), (9, 7, 7))

#: Ids of no page.
UNKNOWN = (-1, 999_999_999)
#: What follows grows with the tables: every page and a few unknown ids; and every page whose id is divisible by 100
#: to the next such page (the last to the first), after the fixed pairs.
ALL_IDS = "SELECT page_id FROM fx_page UNION SELECT page_id FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT))" for i in UNKNOWN) + ") v(page_id)"
ALL_PAIRS = """
SELECT CAST(1000 + page_id AS BIGINT) AS pair_id, page_id AS source_in,
       coalesce(lead(page_id) OVER (ORDER BY page_id), min(page_id) OVER ()) AS target_in
FROM fx_page WHERE page_id % 100 = 0
UNION ALL SELECT CAST(a AS BIGINT), CAST(b AS BIGINT), CAST(c AS BIGINT) FROM (VALUES """ + ", ".join(map(str, PAIRS)) + ") v(a, b, c)"


#: Names of databases and files, some of them neither, from customers and their nations: a language may have many dates.
NAMES = """
SELECT concat('wp-', chr(CAST(97 + n_nationkey AS INT)), chr(CAST(97 + c_custkey % 5 AS INT)), '-', CAST(20200101 + c_custkey % 900 AS VARCHAR(20))) AS name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 7 < 4
UNION SELECT concat(chr(CAST(97 + n_nationkey AS INT)), chr(CAST(97 + c_custkey % 5 AS INT)), 'wiki-', CAST(20200101 + c_custkey % 900 AS VARCHAR(20)), '-', CASE c_custkey % 3 WHEN 0 THEN 'page' WHEN 1 THEN 'pagelinks' ELSE 'abstract-1' END, '.sql.gz') FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 7 = 4
UNION SELECT concat('wp-', chr(CAST(97 + n_nationkey AS INT)), chr(CAST(97 + c_custkey % 5 AS INT)), '_x-', CAST(c_custkey AS VARCHAR(20))) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 7 = 5
UNION SELECT concat(lower(n_name), 'wiki-', CAST(c_custkey AS VARCHAR(20)), 'x-page.sql') FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 7 = 6
"""
#: Lines of a checksum list, in order: other files are passed over, and of a kind's files the first counts.
SUMS = """
SELECT s_suppkey AS line, concat('enwiki-20240101-', CASE s_suppkey % 5 WHEN 0 THEN 'abstract' WHEN 1 THEN 'page' WHEN 2 THEN 'redirect' WHEN 3 THEN 'linktarget' ELSE 'pagelinks' END, '.sql.gz') AS name, s_name AS content
FROM supplier
"""


class Fixture:
    """Relations and clean graph of a folder of tables; what is shared is computed once per session and folder."""

    _held: dict = {}

    def __new__(cls, spark: SparkSession, sf_dir: str, sparse: bool = False):
        key = (sf_dir, sparse)
        if key not in cls._held or cls._held[key].spark is not spark:
            cls._held = {k: v for k, v in cls._held.items() if v.spark is spark}
            cls._held[key] = super().__new__(cls)
            cls._held[key]._fill(spark, sf_dir, sparse)
        return cls._held[key]

    @classmethod
    def forget(cls) -> None:
        """Let go of what is shared, so that it is computed again."""
        cls._held = {}

    def _fill(self, spark: SparkSession, sf_dir: str, sparse: bool) -> None:
        self.spark, self._parts = spark, {}
        # Spark takes a table for as small as its compressed file, and would send all of it through the driver to be broadcast
        part, lineitem = (spark.read.parquet(f"{sf_dir}/{t}.parquet").hint("merge") for t in ("part", "lineitem"))
        self.page = spark.sql(PAGE.replace("FROM part", "FROM {part}"), part=part)
        self.redirect = spark.sql(REDIRECT.replace("FROM part", "FROM {part}").replace("JOIN fx_page", "JOIN {page}"), part=part, page=self.page)
        self.linktarget = spark.sql(LINKTARGET.replace("FROM part", "FROM {part}"), part=part)
        self.pagelinks = spark.sql(PAGELINKS.replace("FROM lineitem a JOIN lineitem b", "FROM {lines} a JOIN {lines} b") + (SPARSE if sparse else ""), lines=lineitem)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._parts:
            self._parts[name] = make()
        return self._parts[name]

    @property
    def resolved(self) -> DataFrame:
        return clean.resolve_redirects(self.redirect, self.page)

    @property
    def redirects(self) -> DataFrame:
        return self._once("redirects", lambda: cut(clean.compress_redirects(self.resolved)))

    @property
    def linktargets(self) -> DataFrame:
        return clean.resolve_linktargets(self.linktarget, self.page)

    @property
    def links(self) -> DataFrame:
        return self._once("links", lambda: cut(clean.links(self.pagelinks, self.linktargets, self.redirects)))

    @property
    def pairs(self) -> DataFrame:
        return self.spark.createDataFrame(list(PAIRS), "pair_id long, source_in long, target_in long")

    @property
    def search(self) -> search.Search:
        def run() -> search.Search:
            found = search.shortest_paths(self.links, self.redirects, self.pairs)
            return search.Search(cut(found.summary), cut(found.links))

        return self._once("search", run)

    @property
    def all_pairs(self) -> DataFrame:
        return self.spark.sql(ALL_PAIRS.replace("FROM fx_page", "FROM {page}"), page=self.page)

    @property
    def search_all(self) -> search.Search:
        def run() -> search.Search:
            found = search.shortest_paths(self.links, self.redirects, self.all_pairs)
            return search.Search(cut(found.summary), cut(found.links))

        return self._once("search_all", run)

    @property
    def ids(self) -> DataFrame:
        return self.spark.sql(ALL_IDS.replace("FROM fx_page", "FROM {page}"), page=self.page)
