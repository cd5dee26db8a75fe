"""Words one edit apart: states walk a distributed tree of all words, level by level.

The tree is a table of edges (node, letter, child). Words of each length have a tree
of their own, and all of them are in it twice, from the front and from the back. A
node is named by the hash of (side, length, letters so far).

A pair one edit apart agrees in its first or its last half. So a state starts where
half of its word is read, in the tree of its own length (one letter may be replaced)
and in that of one letter less (one may be dropped); the front finds edits in the
second half and the back those in the first. There a node has few children, where
the root would have the whole alphabet. A state is (word, letters read, node, edits).
Step k joins the states with the edges of level k: a child with the word's next letter
keeps the edits, any other one spends the one edit there is. A child with one word
below is not walked any further: that word is compared with the state's word, and
becomes its neighbour if they are one edit apart. Every pair comes up exactly once on
each side, so nothing has to be made distinct.

A node with many states is split: its edges are listed once for each chunk of its
states, so the states of one node are spread over tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint.operators.skew import chunked_join
from imprint.session import checkpoint_dir, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Longest words that the tree holds; its levels are half as many. Longer ones meet by the hashes of what is left without a letter.
LONGEST = 40
#: States of a node beyond which they are spread over several tasks.
SPLIT_STATES = 50_000


def count_words(
    docs: DataFrame, least_length: int = 5, least_count: int = 3, delete_one_in: int = 97, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """word, n: the words of all texts, some with a letter deleted.

    Runs of ASCII letters and code points U+00C0 to U+00FF, only A-Z lower-cased. If
    ``delete_one_in`` divides the crc32 of ``id:run``, the run's code point at the
    crc32 modulo its length is deleted. Null text has no runs, a null id counts as
    the empty string, repeated rows count again.
    """
    lower = F.translate(F.col(text_col), _UPPER, _LOWER)
    # A run that is too short before a deletion is too short after it.
    runs = F.regexp_extract_all(lower, F.lit(f"[a-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    draw = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    found = found.select("run", draw.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    rest = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(F.col("h") % delete_one_in == 0, rest).otherwise(F.col("run"))
    return found.select(word.alias("word")).filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def _node(side: Column, length: Column, word: Column, read: Column) -> Column:
    return F.xxhash64(side, length, F.substr(word, F.lit(1), read))


def _letter(word: Column, read: Column) -> Column:
    """The letter after the first ``read`` ones; empty at the end."""
    return F.substr(word, read + 1, F.lit(1))


def _sided(words: DataFrame) -> DataFrame:
    """side, word, n, size: every word from the front (0) and from the back (1)."""
    front = words.select(F.lit(0).alias("side"), "word", "n")
    back = words.select(F.lit(1).alias("side"), F.reverse("word").alias("word"), "n")
    return front.union(back).withColumn("size", F.length("word"))


def tree_edges(sided: DataFrame) -> DataFrame:
    """level, node, letter, child, below, only: edges from the middle of the words to their ends.

    ``level`` counts from the middle, ``below`` is the number of words under the
    child, ``only`` (word, n) one of them, which is the word if there is no other.
    """
    start = F.floor(F.col("size") / 2).cast("int")
    steps = sided.select("side", "word", "n", "size", start.alias("start"), F.explode(F.sequence(start, F.col("size") - 1)).alias("read"))
    edges = steps.select(
        (F.col("read") - F.col("start")).alias("level"),
        _node(F.col("side"), F.col("size"), F.col("word"), F.col("read")).alias("node"),
        _letter(F.col("word"), F.col("read")).alias("letter"),
        _node(F.col("side"), F.col("size"), F.col("word"), F.col("read") + 1).alias("child"),
        "word", "n",
    )
    return edges.groupBy("level", "node", "letter", "child").agg(F.count(F.lit(1)).alias("below"), F.min("word").alias("only"), F.min("n").alias("only_n"))


def _first_states(sided: DataFrame) -> DataFrame:
    """States in the middle of their word, in the tree of its own length and in that of one letter less."""
    both = sided.select("side", "word", "n", "size", F.explode(F.array(F.lit(False), F.lit(True))).alias("drops"))
    both = both.withColumn("length", F.col("size") - F.col("drops").cast("int"))
    both = both.withColumn("read", F.floor(F.col("length") / 2).cast("int"))
    node = _node(F.col("side"), F.col("length"), F.col("word"), F.col("read"))
    return both.select("side", "word", "n", "drops", "read", node.alias("node"), F.lit(0).alias("edits"))


def _step(states: DataFrame, edges: DataFrame, total: int, split: int) -> DataFrame:
    """The states one level on. Those at a child with one word are pairs or gone: ``near`` is that word, else null."""
    met = chunked_join(edges, states, ["node"], "word", split, total)
    now, then = _letter(F.col("word"), F.col("read")), _letter(F.col("word"), F.col("read") + 1)
    letter, unspent = F.col("letter"), F.col("edits") == 0
    same = letter == now
    # Of equal letters in a row only the last is dropped, so that a pair has one way.
    dropped = unspent & F.col("drops") & (letter == then) & (then != now)
    replaced = unspent & ~F.col("drops")
    read = F.when(same, F.col("read") + 1).when(dropped, F.col("read") + 2).when(replaced, F.col("read") + 1)
    alone = F.col("below") == 1
    moved = met.select(
        "side", "word", "n", "drops", read.alias("read"), F.col("child").alias("node"),
        F.when(same, F.col("edits")).otherwise(1).alias("edits"),
        F.when(alone, F.col("only")).alias("near"), F.when(alone, F.col("only_n")).alias("near_n"),
    )
    near = F.levenshtein("word", "near", 1) == 1
    return moved.filter(F.col("read").isNotNull() & (F.col("near").isNull() | near))


def _tree_pairs(words: DataFrame, split: int) -> DataFrame:
    """word, n, near, near_n: each pair of one length in both orders, longer words with shorter ones."""
    spark = words.sparkSession
    sided = _sided(words)
    folder = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    edges = tree_edges(sided)
    edges.write.partitionBy("level").parquet(folder)
    edges = spark.read.schema(edges.schema).parquet(folder)
    states, level, found = materialize(_first_states(sided)), 0, []
    total = states.count()
    while total:
        moved = materialize(_step(states, edges.filter(F.col("level") == level).drop("level"), total, split))
        found.append(moved.filter("near is not null").select("side", "word", "n", "near", "near_n"))
        states = moved.filter("near is null").drop("near", "near_n")
        total, level = states.count(), level + 1
    pairs = found[0] if found else sided.select("side", "word", "n", F.col("word").alias("near"), F.col("n").alias("near_n"))
    for more in found[1:]:
        pairs = pairs.union(more)
    # What agrees in the first half was found from the front already.
    half = F.floor(F.length("near") / 2).cast("int")
    again = (F.col("side") == 1) & (F.right("word", half) == F.right("near", half))
    turn = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c)).alias(c)
    return pairs.filter(~again).select(turn("word"), "n", turn("near"), "near_n")


def _long_pairs(words: DataFrame, longest: int) -> DataFrame:
    """The same of words with more than ``longest`` letters, and of them with those that have as many.

    Words meet by the hash of what is left without one letter. Words that are equal
    without the same letter are at most as many as there are letters.
    """
    some = materialize(words.filter(F.length("word") >= longest).withColumn("id", F.xxhash64("word")))
    cut = some.filter(F.length("word") > longest).select(
        "id", "word", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at")
    )
    rest = F.concat(F.substr("word", F.lit(1), F.col("at")), F.substr("word", F.col("at") + 2))
    last = _letter(F.col("word"), F.col("at")) != _letter(F.col("word"), F.col("at") + 1)
    left = materialize(cut.select("id", "at", F.xxhash64(rest).alias("rest"), last.alias("last")))
    x, y = left.alias("x"), left.alias("y")
    same = x.join(y, (F.col("x.rest") == F.col("y.rest")) & (F.col("x.at") == F.col("y.at")) & (F.col("x.id") != F.col("y.id")))
    less = left.filter("last").alias("x").join(some.alias("y"), F.col("x.rest") == F.col("y.id"))
    pairs = same.select(F.col("x.id").alias("id"), F.col("y.id").alias("near_id")).union(less.select("x.id", "y.id"))
    near = some.select(F.col("id").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.join(some, "id").join(near, "near_id").filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def neighbours(words: DataFrame, longest: int = LONGEST, split: int = SPLIT_STATES) -> DataFrame:
    """word, n, near, near_n: all ordered pairs of different words (word, n) that are one edit apart, once each."""
    tree = _tree_pairs(words.filter(F.length("word") <= longest), split)
    if words.filter(F.length("word") > longest).isEmpty():
        pairs = tree
    else:
        pairs = tree.union(_long_pairs(words, longest))
    shorter = pairs.filter(F.length("word") > F.length("near")).select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")
    )
    return pairs.union(shorter)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of all (word, form), where form never leads back: the last word of the way."""
    now = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while True:
        # Only ways that did not end are joined, so that a word where many end is no hot key.
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = now.filter("open").drop("open").join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")
        )
        now = materialize(further.union(now.filter("NOT open")))
        if now.filter("open").isEmpty():
            return now.select("word", "root")


def group_variants(words: DataFrame, longest: int = LONGEST, split: int = SPLIT_STATES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every (word, n).

    ``form`` is the neighbour of largest n, of those with equal n the first in
    code-point order, if that n is at least twice the word's; else null, as
    ``form_n`` then is. ``root`` is where forms lead in the end, the word itself
    without one. ``n_near`` counts neighbours. Words are expected once each.
    An empty table gives an empty one.
    """
    words = materialize(words.select("word", "n"))
    near = neighbours(words, longest, split)
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    named = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"),
    )
    taken = F.col("form_n") >= 2 * F.col("n")
    named = materialize(named.withColumns({"form": F.when(taken, F.col("form")), "form_n": F.when(taken, F.col("form_n"))}))
    roots = _roots(named.filter("form is not null"))
    return named.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
