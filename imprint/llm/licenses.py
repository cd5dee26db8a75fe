"""Licence scan by diagonal voting.

All rolling hashes of k words of a text are joined to the places where the same
k words stand in a template. A hit votes for its diagonal, the place in the text
minus the place in the template: a quotation is a run of hits on one diagonal, and
an inserted or dropped word moves the rest to a neighbouring one. Neighbouring
diagonals of a template are merged, and a span is verified by the share of the
template's k-grams it holds and by its length. A phrase must stand whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base phrases with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wordings of public licences with their labels.
TEMPLATES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "subject to the terms of the mozilla public license v 2 0": "mpl-2.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
}

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Voting:
    """Words in a hash, least share of a template's k-grams, and how far diagonals may lie apart to be merged."""

    k: int = 3
    coverage: float = 0.6
    drift: int = 3


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null has none.

    ``lower`` goes on to other alphabets, which is harmless, as words are only
    compared with ASCII ones; the one sign that it turns into an ASCII letter is
    replaced first.
    """
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.filter(F.split(plain, _SEPARATOR, -1), lambda w: w != "")


def _grams(words: str, places: str, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(F.col(words), F.col(places) + i) for i in range(k)])


def template_grams(spark, phrases: dict[str, str], templates: dict[str, str], k: int) -> DataFrame:
    """Places of all k-grams of phrases and templates: hash, template, at, grams, size, exact, label.

    A phrase of fewer words is one gram of its own length.
    """
    rows = []
    for number, (text, label) in enumerate([*phrases.items(), *templates.items()]):
        words = re.findall("[a-z0-9]+", text)
        size = min(k, len(words))
        rows += [
            (number, at, words[at : at + size], size, len(words) - size + 1, len(words), number < len(phrases), label)
            for at in range(len(words) - size + 1)
        ]
    table = spark.createDataFrame(
        rows, "template int, at int, words array<string>, k int, grams int, size int, exact boolean, label string"
    )
    hashes = [F.when(F.col("k") == n, F.xxhash64(F.lit(n), *[F.get("words", F.lit(i)) for i in range(n)])) for n in sorted({r[3] for r in rows})]
    return table.withColumn("hash", F.coalesce(*hashes)).drop("words", "k")


def scan_licenses(
    docs: DataFrame,
    phrases: dict[str, str] | None = None,
    templates: dict[str, str] | None = None,
    voting: Voting = Voting(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Licence mentions of every text.

    Returns doc_id, n_words, n_base (places of base phrases), first_word and
    last_word (least and largest start of those, else null), base_labels and
    labels (sorted, comma-joined; the latter with the templates' labels), score
    (largest share of a template found among verified spans, else 0) and spans
    (array of first word, end and label).

    Null and empty texts have no words and no labels. Rows that repeat an id and
    text come back as often, with equal values; an id on different texts is told
    apart by their hashes. Other columns are ignored.

    A text becomes one row per place where it has a hash of some template, and one
    that stands for the text itself; only these are exchanged. The templates are
    given as arguments, so what is broadcast does not grow with the data.
    """
    spark = docs.sparkSession
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    table = template_grams(spark, phrases, templates, voting.k)
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), words_of(F.col(text_col)).alias("words")
    )
    sizes = sorted({min(voting.k, len(re.findall("[a-z0-9]+", t))) for t in [*phrases, *templates]})
    places = texts.select(
        "doc_id", "digest", F.size("words").alias("n_words"), "words",
        F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("place"),
    )
    known = [r["hash"] for r in table.select("hash").distinct().collect()]
    hashes = [_grams("words", "place", n) for n in sizes]
    hit = hashes[0].isin(known)
    for h in hashes[1:]:
        hit = hit | h.isin(known)
    rows = places.filter((F.col("place") < 0) | hit).select(
        "doc_id", "digest", "n_words", "place", F.explode(F.array(*hashes)).alias("hash")
    )
    key = ["doc_id", "digest"]
    marks = rows.join(F.broadcast(table), "hash", "left").filter("place < 0 or template is not null")
    # Votes of repeated rows are one; how often the text itself is there is kept.
    votes = marks.groupBy(*key, "n_words", "place", "template", "at", "grams", "size", "exact", "label").agg(
        (F.count(F.lit(1)) / len(sizes)).cast("int").alias("copies")
    )
    by_template = Window.partitionBy(*key, "template").orderBy("diagonal", "place")
    seen = votes.withColumn("diagonal", F.when(F.col("place") >= 0, F.col("place") - F.col("at")))
    gap = F.col("diagonal") - F.lag("diagonal").over(by_template)
    # Neighbouring diagonals belong together; a phrase does not tolerate changes.
    fresh = F.coalesce((gap > F.when(F.col("exact"), 0).otherwise(voting.drift)).cast("int"), F.lit(1))
    group = F.sum(fresh).over(by_template.rowsBetween(Window.unboundedPreceding, 0))
    spans = seen.withColumn("span", group).groupBy(*key, "n_words", "template", "span", "grams", "size", "exact", "label").agg(
        F.max(F.when(F.col("place") < 0, F.col("copies"))).alias("copies"),
        F.min("place").alias("first"), F.max("place").alias("last"), F.countDistinct("at").alias("found"),
    )
    share = F.col("found") / F.col("grams")
    whole = F.when(F.col("exact"), share == 1).otherwise(
        (share >= voting.coverage) & (F.col("last") - F.col("first") + 1 <= F.col("grams") + voting.drift * 2)
    )
    good = spans.withColumn("good", F.col("template").isNotNull() & whole).filter("template is null or good")
    end = F.col("last") + F.col("size") - F.col("grams") + 1
    base = F.col("good") & F.col("exact")
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    return (
        good.groupBy(*key, "n_words")
        .agg(
            F.max("copies").alias("copies"),
            F.count_if(base).alias("n_base"),
            F.min(F.when(base, F.col("first"))).cast("bigint").alias("first_word"),
            F.max(F.when(base, F.col("first"))).cast("bigint").alias("last_word"),
            joined(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
            joined(F.collect_set(F.when(F.col("good"), F.col("label")))).alias("labels"),
            F.coalesce(F.max(F.when(F.col("good"), share)), F.lit(0.0)).alias("score"),
            F.sort_array(F.collect_list(F.when(F.col("good"), F.struct(F.col("first"), end.alias("stop"), "label")))).alias("spans"),
        )
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(
            "doc_id", F.col("n_words").cast("bigint").alias("n_words"), "n_base", "first_word", "last_word", "base_labels",
            "labels", "score", "spans",
        )
    )
