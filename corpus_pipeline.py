"""From raw documents to token files: language, near copies, benchmark text, mix, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from imprint.llm import decontaminate, language, mixing, ngram_join
from imprint.llm.queries import table, train_languages, write_and_read_tokens
from imprint.session import materialize

#: SQL cannot classify languages or encode tokens; the tests compare with plain loops.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the others go.

    Texts that are null or without letters go, and those of which too little is known
    for their best language. Repeated rows are judged alike. Without any label
    everything goes, and an empty table stays empty.
    """
    return language.keep_recognised(docs, train_languages(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies: similarity 0.8 or more over five-word shingles.

    The smallest id stays, null ids come last. Texts without words are no copies. Texts
    that share an id are judged each by its own; of rows with the same id and text one
    stays.
    """
    return ngram_join.keep_first(docs, n=5, part=80, whole=100)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts stay, as nothing occurs in them, and repeated rows are judged
    alike. With an empty benchmark all documents stay.
    """
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"), window=10)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them.

    A null source is a source. Texts without words have no weight and are not read.
    """
    return mixing.apply_mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold of each document.

    Null text is empty and gets the end id alone. A document that the mix reads
    twice is written twice.
    """
    return write_and_read_tokens(spark, docs)


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("decontaminate", drop_benchmark_text),
    ("mix", mix_to_weights),
    ("tokens", write_token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
