"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

A source's weight is its share of all tokens raised to an exponent, normalised.
The exponent is bisected until the weights have a target entropy, and raised
again where a source would have to be repeated more often than allowed. The
budget of a source is spent on permutations of its documents, one for each epoch:
whole epochs first, then the beginning of one more, up to a cut in its order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from imprint.session import materialize

#: Tokens of a block, the stretch of a permutation that is added up on its own.
BLOCK_TOKENS = 1 << 20
#: Sources whose plan may be sent to every task.
SMALL_SOURCES = 100_000
_GRID = 32
_ROUNDS = 6
_WHOLE = 1 << 62


@dataclass(frozen=True)
class Target:
    """What the mix is to meet.

    ``entropy`` is the wanted entropy of the weights as a part of the largest
    possible one. ``repeats`` is the most often that a source may be read, on
    average over its documents. ``budget`` is the number of tokens to hand out as
    a multiple of all there are.
    """

    entropy: float = 0.97
    repeats: float = 4.0
    budget: float = 1.0


def token_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _place(epoch: Column | int) -> Column:
    """Place of a document in an epoch's permutation, from 0 to 2 ** 62."""
    epoch = F.lit(epoch) if isinstance(epoch, int) else epoch
    return F.shiftrightunsigned(F.xxhash64("doc_id", "digest", epoch.cast("bigint"), F.lit("mixing")), 2)


def _measure(shares: DataFrame, target: Target, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, most repeats) of the weights for each exponent, in one pass over the sources."""
    columns = []
    for k, e in enumerate(exponents):
        p = F.pow("share", F.lit(e))
        columns += [F.sum(p).alias(f"z{k}"), F.sum(p * F.log(p)).alias(f"h{k}"), F.max(p / F.col("share")).alias(f"m{k}")]
    row = shares.agg(*columns).first()
    out = []
    for k in range(len(exponents)):
        z, h, m = row[f"z{k}"], row[f"h{k}"], row[f"m{k}"]
        out.append((math.log(z) - h / z, m / z * target.budget))
    return out


def _bisect(shares: DataFrame, target: Target, met, low: float, high: float) -> float:
    """The exponent next to ``low`` that meets a condition, which holds at ``high`` if anywhere.

    Every round measures a grid of exponents at once and goes on within one step.
    """
    for _ in range(_ROUNDS):
        grid = [low + (high - low) * k / _GRID for k in range(_GRID + 1)]
        good = [k for k, x in enumerate(_measure(shares, target, grid)) if met(*x)]
        if not good:
            return high
        if good[0] == 0:
            return low
        low, high = grid[good[0] - 1], grid[good[0]]
    return high


def source_plan(rows: DataFrame, target: Target) -> DataFrame:
    """Per source: tokens, weight, whole epochs and the cut of the last one.

    ``rows`` has doc_id, digest, source and n_tokens. A source without tokens has
    weight 0 and no epochs.
    """
    totals = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    every = totals.agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > 0).alias("sources")).first()
    total, sources = every["tokens"] or 0, every["sources"]
    if not total:
        return totals.select(
            "source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("bigint").alias("epochs"), F.lit(0).cast("bigint").alias("cut")
        )
    shares = totals.filter("tokens > 0").select("source", "tokens", (F.col("tokens") / F.lit(total)).alias("share"))
    wanted = target.entropy * math.log(sources)
    # Entropy and repeats both fall as the exponent grows: the largest with enough
    # entropy, unless only a larger one keeps the repeats down.
    flat = _bisect(shares, target, lambda entropy, _: entropy >= wanted - 1e-12, 1.0, 0.0)
    tame = _bisect(shares, target, lambda _, repeats: repeats <= target.repeats + 1e-9, 0.0, 1.0)
    exponent = max(flat, tame)
    z = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0]
    plan = shares.withColumn("weight", F.pow("share", F.lit(exponent)) / F.lit(z)).withColumn(
        "spend", F.floor(F.col("weight") * F.lit(target.budget * total)).cast("bigint")
    )
    plan = materialize(
        plan.withColumn("epochs", F.expr("spend div tokens"))
        .withColumn("rest", F.col("spend") - F.col("epochs") * F.col("tokens"))
        .withColumn("blocks", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("bigint"))
    )
    # The last epoch: add up its blocks, then look into the one block in which the budget ends.
    last = rows.filter("n_tokens > 0").join(_sent(plan, "source", "epochs", "blocks", "rest"), rows.source.eqNullSafe(F.col("p_source")))
    last = last.withColumn("place", _place(F.col("p_epochs"))).withColumn(
        "block", F.least(F.floor(F.col("place") / (F.lit(float(_WHOLE)) / F.col("p_blocks"))).cast("bigint"), F.col("p_blocks") - 1)
    )
    sums = last.groupBy("source", "block", "p_rest").agg(F.sum("n_tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("block"))
    edge = (
        sums.withColumn("upto", upto).filter("upto > p_rest AND upto - tokens <= p_rest")
        .select(F.col("source").alias("e_source"), F.col("block").alias("e_block"), (F.col("upto") - F.col("tokens")).alias("e_before"))
    )
    inner = last.join(edge, last.source.eqNullSafe(F.col("e_source")) & (F.col("block") == F.col("e_block")))
    within = F.sum("n_tokens").over(Window.partitionBy("source", "block").orderBy("place"))
    cuts = (
        inner.withColumn("upto", within + F.col("e_before")).filter("upto > p_rest")
        .groupBy("source").agg(F.min("place").alias("cut"))
    )
    c = cuts.select(F.col("source").alias("c_source"), "cut")
    planned = plan.join(c, plan.source.eqNullSafe(F.col("c_source")), "left").select(
        "source", "weight", "epochs", F.coalesce("cut", F.lit(0)).alias("cut")
    )
    p = planned.select(F.col("source").alias("p_source"), "weight", "epochs", "cut")
    return totals.join(p, totals.source.eqNullSafe(F.col("p_source")), "left").select(
        "source", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"),
        F.coalesce("epochs", F.lit(0)).cast("bigint").alias("epochs"), F.coalesce("cut", F.lit(0)).cast("bigint").alias("cut"),
    )


def _sent(plan: DataFrame, *columns: str) -> DataFrame:
    """A plan under prefixed names, broadcast if it has few sources."""
    out = plan.select(*[F.col(c).alias(f"p_{c}") for c in columns])
    return F.broadcast(out) if plan.count() <= SMALL_SOURCES else out


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, digest (of the text), source and n_tokens of every document."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(source_col).alias("source"),
        token_count(text).alias("n_tokens"),
    )


def mix_sources(
    docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The mix: a row for every reading of a document: doc_id, source, n_tokens, weight, epoch, place.

    ``weight`` is the source's, ``epoch`` counts the readings of a document from 0,
    ``place`` orders the documents of an epoch. Documents that the budget does not
    reach have no row.

    A null source is a source of its own. Documents without words (null and empty
    texts too) have no tokens; they are read once in every whole epoch, and never
    in a cut one. Rows that repeat an id and text share their place and are read
    alike. Other columns are ignored. An empty table gives an empty mix.

    Texts are only scanned. What is exchanged is one row per source and per block
    of tokens, and the one block of each source in which its budget ends.
    """
    rows = materialize(described(docs, id_col, text_col, source_col))
    return read_plan(rows, source_plan(rows, target)).select("doc_id", "source", "n_tokens", "weight", "epoch", "place")


def read_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` once for every reading, with weight, epoch and place."""
    plan = materialize(plan)
    joined = rows.join(_sent(plan, "source", "weight", "epochs", "cut"), rows.source.eqNullSafe(F.col("p_source")))
    more = ((F.col("n_tokens") > 0) & (_place(F.col("p_epochs")) < F.col("p_cut"))).cast("bigint")
    return (
        joined.withColumn("readings", F.col("p_epochs") + more).filter("readings > 0")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("readings") - 1)))
        .withColumn("place", _place(F.col("epoch"))).withColumnRenamed("p_weight", "weight")
        .drop("p_source", "p_epochs", "p_cut", "readings")
    )


def apply_mix(
    docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Rows of ``docs``, all columns kept, as often as :func:`mix_sources` reads them.

    What each source reads is sent to the texts, not the other way round.
    """
    plan = materialize(source_plan(materialize(described(docs, id_col, text_col, source_col)), target))
    p = _sent(plan, "source", "epochs", "cut")
    n = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"), F.col(source_col).alias("source"),
        token_count(F.col(text_col)).alias("n_tokens"), n.alias("whole"),
    )
    joined = rows.join(p, rows.source.eqNullSafe(F.col("p_source")))
    more = ((F.col("n_tokens") > 0) & (_place(F.col("p_epochs")) < F.col("p_cut"))).cast("int")
    return joined.select("whole", F.explode(F.array_repeat(F.lit(0), F.col("p_epochs").cast("int") + more))).select("whole.*")
