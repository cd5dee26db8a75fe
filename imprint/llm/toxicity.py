"""Toxicity from dense features with gradient-boosted trees and isotonic calibration.

Features of a text: density and number of lexicon words and stems, the share of
them near a second-person word, shares of capitals, of shouted words, of
punctuation and of obfuscated spellings, and length. The lexicon has a few fixed
words and the words and stems that set labelled toxic texts apart from others.
The trees learn on one part of the labelled sample, the calibration on another.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from imprint.llm.common import batch
from imprint.session import materialize

# Common insults, and second-person words of the corpus's languages.
INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb ugly fool jerk".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr tu te toi ton ta vous votre tú ti tus usted".split()

FEATURES = ["lexicon_density", "lexicon_hits", "lexicon_kinds", "stem_density", "near_second", "capitals", "shouting", "punctuation", "obfuscated", "log_words"]

_WORD = re.compile(r"[^\W_]+(?:[@$!*'’0-9][^\W_]+)*")
_PUNCTUATION = re.compile(r"[!?*@#$%^&]")
_DISGUISE = str.maketrans("@$!013457", "asioieast")
_STEMS = (4, 5, 6)
_NEAR = 3


@dataclass(frozen=True)
class Lexicon:
    """Words, and beginnings of words (kept apart by a trailing ``*``)."""

    words: frozenset[str]
    stems: frozenset[str]


def _features(text: str, lexicon: Lexicon) -> list[float]:
    words = _WORD.findall(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lower = [w.lower() for w in words]
    stems = lexicon.stems
    hits, soft, disguised, kinds = [], 0, 0, set()
    for k, w in enumerate(lower):
        if w in lexicon.words:
            hits.append(k)
            kinds.add(w)
        elif stems and (w[:4] in stems or w[:5] in stems or w[:6] in stems):
            soft += 1
            kinds.add(w)
        elif not w.isalpha():
            plain = w.translate(_DISGUISE).replace("*", "")
            if plain != w and plain.isalpha():
                disguised += 1
                if plain in lexicon.words:
                    hits.append(k)
                    kinds.add(plain)
    near = sum(any(x in _SECOND for x in lower[max(0, k - _NEAR) : k + _NEAR + 1]) for k in hits)
    capitals = sum(map(str.isupper, text))
    shouted = sum(len(w) > 1 and w.isupper() for w in words)
    return [
        len(hits) / n, float(len(hits)), float(len(kinds)), soft / n, near / max(1, len(hits)), capitals / len(text),
        shouted / n, len(_PUNCTUATION.findall(text)) / len(text), disguised / n, math.log1p(n),
    ]


_SECOND = frozenset(SECOND_PERSON)


def features(rows: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the features of ``text``."""

    def run(batches):
        for b in batches:
            values = []
            for a in range(0, b.num_rows, 512):
                values += [_features(t or "", lexicon) for t in b.column("text").slice(a, 512).to_pylist()]
            table = np.array(values, float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in keep] + [pa.array(table[:, i].copy()) for i in range(len(FEATURES))], names=keep + FEATURES
            )

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"{k} {kinds[k]}" for k in keep] + [f"{k} double" for k in FEATURES])
    return rows.select(*keep, "text").mapInArrow(run, schema)


def learn_lexicon(sample: DataFrame, size: int = 2000, least: int = 5) -> Lexicon:
    """Fixed insults, and up to ``size`` words and stems that labelled toxic texts have far more often."""

    def run(batches):
        for b in batches:
            labels, terms = [], []
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                words = {w.lower() for w in _WORD.findall(text or "")}
                found = words | {w[:n] + "*" for w in words for n in _STEMS if len(w) > n}
                labels += [toxic] * len(found)
                terms += found
            yield batch(toxic=pa.array(labels, pa.int32()), term=pa.array(terms, pa.string()))

    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon(frozenset(INSULTS), frozenset())
    counts = sample.select("toxic", "text").mapInArrow(run, "toxic int, term string").groupBy("term").agg(
        F.count_if(F.col("toxic") == 1).alias("bad"), F.count_if(F.col("toxic") == 0).alias("good")
    )
    odds = F.log(((F.col("bad") + 0.5) / (bad + 1.0)) / ((F.col("good") + 0.5) / (good + 1.0)))
    chosen = (
        counts.filter(F.col("bad") >= least).withColumn("odds", odds).filter("odds > 3")
        .orderBy(F.desc("odds"), F.desc("bad"), "term").limit(size).select("term").collect()
    )
    terms = [r.term for r in chosen]
    return Lexicon(
        frozenset(INSULTS) | {t for t in terms if not t.endswith("*")}, frozenset(t[:-1] for t in terms if t.endswith("*"))
    )


@dataclass
class Model:
    """Trees, calibration and lexicon; ``trees`` is None when nothing could be learned."""

    lexicon: Lexicon
    trees: object = None
    calibration: object = None


def _vector(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def train(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = 20_000,
    trees: int = 24,
    depth: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    toxic_col: str = "toxic",
) -> Model:
    """Learns from about ``sample_rows`` labelled documents, taken by a hash of their id.

    Null labels are left out; an id with several labels is toxic if one of them
    says so. With only one kind of label there are no trees, and the fixed insults
    decide.
    """
    marks = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(toxic_col).cast("int").alias("toxic"))
        .filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    count = marks.count()
    if count > sample_rows:
        marks = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(count)) < sample_rows)
    # At most the sample's ids are sent to the tasks; the texts are not exchanged before that.
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(marks), "doc_id")
    sample = materialize(rows.select("doc_id", "toxic", "text"))
    lexicon = learn_lexicon(sample)
    part = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3))
    data = materialize(_vectorless(sample, lexicon).withColumn("part", part).repartition(4))
    kinds = {(r["part"] == 0, r["toxic"]) for r in data.select("part", "toxic").distinct().collect()}
    if len(kinds) < 4:
        return Model(lexicon)
    learner = GBTClassifier(
        featuresCol="features", labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.3, maxBins=32, seed=1, minInstancesPerNode=10
    )
    model = learner.fit(_vector(data.filter("part <> 0")).select("toxic", "features"))
    held = model.transform(_vector(data.filter("part = 0"))).select(
        F.col("toxic").cast("double").alias("label"), vector_to_array("probability")[1].alias("raw")
    )
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label").fit(held)
    return Model(lexicon, model, calibration)


def _vectorless(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    return features(sample, lexicon, ["doc_id", "toxic"])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted of every text, from the text alone.

    Null and empty texts have all features zero and are scored like any other.
    Rows that repeat an id are scored one by one. Other columns are ignored.
    Without trees the score is the density of fixed insults, and any makes it
    at least 0.5.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    made = features(rows, model.lexicon, ["doc_id"])
    if model.trees is None:
        value = F.when(F.col("lexicon_hits") > 0, F.least(F.lit(1.0), 0.5 + F.col("lexicon_density"))).otherwise(0.0)
        found = made.select("doc_id", value.alias("score"))
    else:
        raw = model.trees.transform(_vector(made)).select("doc_id", vector_to_array("probability")[1].alias("raw"))
        steps = model.calibration.transform(raw)
        found = steps.select("doc_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
