"""Titles that are equal but for case and accents, letters that other rules make several of included, against the queries' SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestep.plans import queries, sql

TITLES = ("Straße", "STRASSE", "STRAẞE", "strasse", "Éa", "ea", "e\u0301A", "ﬁn", "fin", "Fin", "ΟΔΟΣ", "οδος", "οδοσ", "İx", "ix", "ıx", "ᾳ", "αι", "ŉ", "Ｅn", "En", "æ", "ae", "\u1100\u1161\u11a8", "각", "가", "a\u200bb", "ab", "", "ǰ")


@pytest.mark.parametrize("name", ["title_fold_match", "title_suggest", "title_first_match"])
def test_letters_stay_one_letter(spark, tmp_path, name):
    rows = [(i * 100 + k, f"<html><title> {t} </title>" if t else None) for i, t in enumerate(TITLES) for k in (0, 7)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, html string").select("page_id", F.lit("u").alias("url"), "html").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{path}/*.parquet'")
    wanted = con.sql(sql.ORACLES[name])
    found = queries.queries()[name](spark, str(tmp_path)).select(*wanted.columns)
    assert sorted(map(tuple, found.collect())) == sorted(wanted.fetchall()) != []


def test_every_title_is_a_query(spark, tmp_path):
    """Whatever the page's id; pages without a title match nothing."""
    rows = [(7, "Éa"), (31, "ea"), (100, "b"), (201, None), (250, "C")]
    pages = [(i, f"<title>{t}</title>" if t else None) for i, t in rows]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = sorted(map(tuple, queries.title_fold_match(spark, str(tmp_path)).select("query", "page_id", "title").collect()))
    assert found == [("B", 100, "b"), ("C", 250, "C"), ("EA", 7, "Éa"), ("EA", 31, "ea"), ("ÉA", 7, "Éa"), ("ÉA", 31, "ea")]
