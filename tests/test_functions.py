import unicodedata
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from citeweave.functions import text as X

WORDS = ["", "Straße  Nord", "\tA b ", "ÉTÉ à la  mer", "plain text", "ﬁn", "İx"]


def column(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_normalized_text(spark):
    assert column(spark, [*WORDS, None], X.normalized_text) == [" ".join(w.casefold().split()) for w in WORDS] + [None]


def test_ascii_fold_and_quote(spark):
    assert column(spark, WORDS, X.ascii_fold) == [unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode() for w in WORDS]
    assert column(spark, WORDS, X.url_quote) == [quote(w) for w in WORDS]


@pytest.mark.parametrize("a, b, ratio", [("kitten", "sitting", 8 / 13), ("", "", 1.0), ("", "x", 0.0), ("Title", "title", 0.8), ("abc", "abc", 1.0)])
def test_indel_ratio(spark, a, b, ratio):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(X.indel_ratio("a", "b")).first()[0] == pytest.approx(ratio)


def test_name_similarity(spark):
    rows = spark.createDataFrame([("é", "e"), ("", "a"), ("name", "name")], "a string, b string")
    assert [r[0] for r in rows.select(X.name_similarity(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]


def test_names(spark):
    rows = spark.createDataFrame([(None, "Ada", "Lovelace"), ("ACM  Press", "x", "y"), (None, None, None), ("", "a", "b")], "n string, g string, f string")
    assert [r[0] for r in rows.select(X.agent_full_name(F.col("n"), F.col("g"), F.col("f"))).collect()] == ["ada lovelace", "acm press", None, None]


def test_years(spark):
    assert column(spark, ["2020", "2020-05-12", "05-2020", "x", "12-5", None], X.year_int) == [2020, 2020, 2020, None, None, None]


def test_titles(spark):
    clean = lambda v: X.clean_title(v, ["the", "of"])
    assert column(spark, ["the Art of  War and Peace", "The of"], clean) == ["Art  War and", "The"]
    assert column(spark, [" Unknown ", "", None, "A title"], X.usable_title) == [False, False, False, True]


def test_author_score(spark):
    rows = spark.createDataFrame([([("Ada", "Lovelace"), ("A.", "lovelace"), (None, "Lovelace"), ("Ada", None), ("Bob", "Lovelace")],)], "c array<struct<given:string,family:string>>")
    assert rows.select(X.author_score(F.lit("ada"), F.lit("lovelace"), F.col("c"))).first()[0] == 4


def test_small_functions(spark):
    row = spark.range(1).select(X.doi_case_variants(F.lit("10.1/aB")), X.doi_case_variants(F.lit("10.1")), X.strip_prefix(F.lit("https://openalex.org/W1")), X.short_scheme(F.lit("http://x/y/doi")), X.bucket(F.lit(10001), 10000), X.bucket(F.lit(10000), 1000)).first()
    assert list(row) == [["10.1/aB", "10.1/ab", "10.1/AB"], ["10.1"], "W1", "doi", 20000, 10000]
