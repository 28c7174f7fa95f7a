"""Rows of dumps: what is one, what isn't, and what is kept of it."""

import pytest
from pyspark.sql import functions as F

from lodestep.functions import patterns

def page(id_=7, namespace=0, title="Oak", redirect=0, new=1, random="0.5", touched="'20231111111111'", links="NULL", latest=90, length=12, model="'wikitext'", lang="NULL"):
    return f"({id_},{namespace},'{title}',{redirect},{new},{random},{touched},{links},{latest},{length},{model},{lang})"


def escaped(text):
    return text.replace("\\", "\\\\").replace("'", "\\'")


TITLES = ("Oak", "Café_au_lait", "O'Hara", "back\\slash", "a,b),(c", "'", "Zürich;_(canton)")
ACCEPTED = [
    *(("page", page(i, -i % 3 - 1, escaped(t)), (str(i), str(-i % 3 - 1), escaped(t))) for i, t in enumerate(TITLES)),
    *(("page", page(random=f"{x}"), ("7", "0", "Oak")) for x in (0, 1, 0.75, 0.000123, "1.000", ".25")),
    ("page", page(links="'20231212121212'", model="'Scribunto'", lang="'pt-br'"), ("7", "0", "Oak")),
    *(("redirect", f"({i},{i % 4},'{escaped(t)}',NULL,NULL)", (str(i), str(i % 4), escaped(t))) for i, t in enumerate(TITLES)),
    ("redirect", "(5,0,'Oak','de','Bark_\\\\ leaf')", ("5", "0", "Oak")),
    *(("linktarget", f"({2**64 - 1 - i},{-i},'{escaped(t)}')", (str(2**64 - 1 - i), str(-i), escaped(t))) for i, t in enumerate(TITLES)),
    *(("pagelinks", f"({i},{n},{2**64 - 1 - i})", (str(i), str(2**64 - 1 - i))) for i, n in ((0, -2), (3, 0), (2**32 - 1, 15))),
]
REJECTED = [
    ("page", page(title="O'Hara")),
    ("page", page(random="2e-6")),
    ("page", page(random="3E")),
    ("redirect", "(5,0,'O'Hara',NULL,NULL)"),
    ("linktarget", "(5,0,Oak)"),
    ("pagelinks", "(5,0,-6)"),
    ("pagelinks", "(-5,0,6)"),
]


def taken(spark, relation, line):
    df = spark.createDataFrame([(line,)], "value string").select(F.explode(patterns.rows(F.col("value"), relation)).alias("row"))
    return [tuple(r) for r in df.select(*patterns.groups(F.col("row"), relation)).collect()]


@pytest.mark.parametrize(("relation", "row", "kept"), ACCEPTED)
def test_accepted(spark, relation, row, kept):
    assert taken(spark, relation, f"INSERT INTO `x` VALUES {row},{row};") == [kept, kept]


@pytest.mark.parametrize(("relation", "row"), REJECTED)
def test_rejected(spark, relation, row):
    assert taken(spark, relation, row) == []


def test_long_text_needs_no_stack(spark):
    title = "x" * 50_000 + r"\'" * 1000
    assert taken(spark, "linktarget", f"(1,0,'{title}')") == [("1", "0", title)]


def test_ids_out_of_range_are_null(spark):
    df = spark.createDataFrame([("4294967295", "18446744073709551615"), ("4294967296", "18446744073709551616"), ("99999999999999999999", "x")], "a string, b string")
    found = df.select(patterns.page_id(F.col("a")), patterns.linktarget_id(F.col("b")).cast("string")).collect()
    assert [tuple(r) for r in found] == [(4294967295, "18446744073709551615"), (None, None), (None, None)]
