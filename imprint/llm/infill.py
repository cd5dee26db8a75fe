"""Fill-in-the-middle: prefix, middle and suffix of a text, cut by one counted regular expression.

A text is a run of tokens, each a word of ASCII letters or one other code point.
``regexp_count`` says how many there are; two numbers drawn from the document's id
say after how many the prefix and the middle end. The pattern of a row then is

    \\A((?:unit){a}+)((?:unit){b-a}+)(rest)\\z

and one match of it captures the three parts, which the replacement puts in the
order of the form. The quantifiers are possessive: a token is taken once and never
given back, so the match is one pass without a stack that grows with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A token.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: The same where nothing is given back.
_POSSESSIVE = "(?:[A-Za-z]++|[^A-Za-z])"

#: Marks of the three parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

#: Of a hundred documents, those that stay plain, and of a hundred others those with the suffix first.
PLAIN_OF_100, SPM_OF_100 = 10, 20

_ORDERS = {"psm": f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2", "spm": f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2"}
_BACK = {
    "psm": (rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*)\z", "$1$3$2"),
    "spm": (rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*)\z", "$2$3$1"),
}


def draws(id_col: Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the sha256 of ``seed:id``; a null id is the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(count)]


def _length(name: str, *ends: str) -> Column:
    """Code points of ``name`` between the first places of two marks."""
    first, last = (F.instr(F.col(name), mark) for mark in ends)
    return (last - first - len(ends[0])).cast("bigint")


def fill_in_middle(docs: DataFrame, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every text.

    ``n`` counts tokens, ``form`` is ``plain``, ``psm`` or ``spm``. A null text is
    empty. A text stays plain if it is empty, holds one of the marks, or is drawn
    so; then both lengths are null and the output is the text. Rows with the same
    id and text come back with equal values, and a null id draws as an empty one.
    An empty table gives an empty one; other columns are ignored, whatever their
    names. Every row is worked on by itself: nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", F.regexp_count("text", F.lit(UNIT)).cast("bigint").alias("n"))
    h1, h2, h3, h4 = draws(F.col("doc_id"), seed)
    one, two = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    form = (
        F.when((F.col("n") == 0) | marked | (h3 % 100 >= 100 - PLAIN_OF_100), "plain")
        .when(h4 % 100 < SPM_OF_100, "spm")
        .otherwise("psm")
    )
    cut = rows.select("doc_id", "text", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    pattern = F.concat(
        F.lit(rf"(?s)\A({_POSSESSIVE}{{"), F.col("a").cast("string"),
        F.lit(rf"}}+)({_POSSESSIVE}{{"), (F.col("b") - F.col("a")).cast("string"), F.lit(r"}+)(.*)\z"),
    )
    order = F.when(F.col("form") == "psm", _ORDERS["psm"]).otherwise(_ORDERS["spm"])
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace(F.col("text"), pattern, order))
    built = cut.select("doc_id", "n", "form", output.alias("output"))
    psm, spm = F.col("form") == "psm", F.col("form") == "spm"
    middle = (F.length("output") - F.instr("output", MIDDLE) - len(MIDDLE) + 1).cast("bigint")
    return built.select(
        "doc_id", "n", "form",
        F.when(psm, _length("output", PREFIX, SUFFIX)).when(spm, _length("output", PREFIX, MIDDLE)).alias("prefix_chars"),
        F.when(psm | spm, middle).alias("middle_chars"),
        "output",
    )


def restore(output: Column, form: Column) -> Column:
    """The text that was made into ``output``; null for an unknown form."""
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.regexp_replace(output, *_BACK["psm"]))
        .when(form == "spm", F.regexp_replace(output, *_BACK["spm"]))
    )
