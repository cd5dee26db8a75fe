import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, over several partitions."""

    def build(rows, parts=3):
        rows = [(*r, *("en", "s")[len(r) - 2 :], len(r[1] or "")) if len(r) < 4 else (*r, len(r[1] or "")) for r in rows]
        return spark.createDataFrame(rows, SCHEMA).repartition(parts)

    return build


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table as (doc_id, text, lang, source) rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    return [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()]


#: Rows that any operator must take: nulls, empty, no words, ties, repeats, non-ASCII, a long word, a long text.
ODD = [
    (1, None, None, None),
    (2, "", "en", "s"),
    (3, " \n\t ", "en", "s"),
    (4, "one", "en", "s"),
    (4, "one", "en", "s"),
    (None, "no id here at all", "en", "s"),
    (5, "É 日本語 ǅ İK ſ \U0001f600   word", "fr", "t"),
    (6, "x" * 5000, "en", "t"),
    (7, "some words again and again " * 8000, "en", "t"),
    (8, "one", None, None),
]


@pytest.fixture
def odd(make):
    return make(ODD)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def clashing(odd):
    """The odd rows with more columns, named like what operators add."""
    from pyspark.sql import functions as F

    names = "key node score n_words hits place epoch digest words hash template gram rep component_id begin stop label features copies".split()
    return odd.withColumns({n: F.lit(1) for n in names})
