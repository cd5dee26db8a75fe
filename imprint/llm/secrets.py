"""Secret scan with linking of the parts of a credential.

Base kinds are found by their patterns alone. A token that merely looks random is
a weak candidate: it counts only where parts that complete a credential stand
near it, an access identifier or an endpoint. Candidates and parts are spans of a
text; they are joined as intervals within scopes, stretches of a text of fixed
width: a candidate is listed in those it touches, a part in those it reaches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint.session import materialize

# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24

# Parts that complete a credential, and what a lone secret looks like.
IDENTIFIER = r"""(?i:(user_?name|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9@+/_.-]+)"""
ENDPOINT = r"(?i:https?|postgres|mysql|mongodb|redis|amqp|ftp)://[A-Za-z0-9.:@/_-]+"
WEAK = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"

#: Most code points between a weak candidate and a part that completes it.
REACH = 200

_SPANS = "array<struct<start:int,stop:int>>"


def find_spans(text: str, pattern: str, least: int = 0, group: int = 0) -> Column:
    """Spans (code points) of all leftmost, non-overlapping matches whose ``group`` has ``least`` characters.

    A place is found from the lengths of what lies between the matches and of the
    matches before it.
    """
    gaps = F.split(F.col(text), pattern, -1)
    whole = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)) if group else whole
    matches = F.zip_with(F.arrays_zip(whole.alias("m"), part.alias("p")), gaps, lambda x, gap: F.struct(F.length(gap).alias("gap"), F.length(x["m"]).alias("size"), F.length(x["p"]).alias("held")))
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        stop = begin + F.coalesce(x["size"], F.lit(0))
        more = F.array(F.struct(begin.alias("start"), stop.alias("stop")))
        return F.struct(
            stop.alias("at"),
            F.when(F.coalesce(x["held"], F.lit(-1)) >= least, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"),
        )

    found = F.aggregate(matches, start, step, lambda acc: acc["out"])
    return F.when(F.col(text).rlike(pattern), found).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def scan_secrets(docs: DataFrame, reach: int = REACH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets of every text: doc_id, assign, access, hex and linked, arrays of (start, stop).

    Places are code points, the end exclusive. ``linked`` has the weak candidates
    that stand within ``reach`` code points of an access key, a named identifier
    or an endpoint, and lie outside the base spans. A candidate has 20 characters or
    more, of any number, and up to two ``=`` at its end.

    Null and empty texts have no spans. Rows that repeat an id and text come back
    as often, with equal values; an id on different texts is told apart by their
    hashes. Other columns are ignored.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("digest", F.xxhash64("text"))
    kinds = {
        # A run of these characters is matched from its first one, so asking for the
        # least length at once finds the same matches and fewer failures.
        "assign": find_spans("text", ASSIGN, ASSIGN_LEAST, 2),
        "access": find_spans("text", ACCESS.replace("+", f"{{{ACCESS_LEAST - 4},}}")),
        "hex": find_spans("text", HEX.replace("+", f"{{{HEX_LEAST},}}")),
        "named": find_spans("text", IDENTIFIER),
        "endpoint": find_spans("text", ENDPOINT),
        "weak": find_spans("text", WEAK),
    }
    # Written once, so that the patterns run once for both uses below.
    found = materialize(texts.select("doc_id", "digest", *[c.alias(k) for k, c in kinds.items()]))
    key = ["doc_id", "digest"]
    some = found.filter(F.size("weak") > 0).dropDuplicates(key)
    base = lambda s: F.exists(F.concat("assign", "access", "hex"), lambda x: (x["start"] < s["stop"]) & (s["start"] < x["stop"]))
    weak = some.select(*key, F.explode(F.filter("weak", lambda s: ~base(s))).alias("s")).select(
        *key, "s.start", "s.stop",
        F.explode(F.sequence(F.floor(F.col("s.start") / reach), F.floor(F.col("s.stop") / reach))).alias("scope"),
    )
    parts = some.select(*key, F.explode(F.concat("access", "named", "endpoint")).alias("p")).select(
        *key, F.col("p.start").alias("p_start"), F.col("p.stop").alias("p_stop"),
        F.explode(F.sequence(F.floor((F.col("p.start") - reach) / reach), F.floor((F.col("p.stop") + reach) / reach))).alias("scope"),
    )
    # A scope holds no more parts than characters, so no key of this join is hot.
    near = (F.col("w.start") <= F.col("p.p_stop") + reach) & (F.col("p.p_start") <= F.col("w.stop") + reach)
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"p.{k}")) for k in [*key, "scope"]]
    linked = (
        weak.alias("w").join(parts.alias("p"), [*same, near], "left_semi")
        .groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("linked"))
    )
    f, x = found.alias("f"), linked.alias("x")
    none = F.expr(f"cast(array() as {_SPANS})")
    return f.join(x, [F.col("f.doc_id").eqNullSafe(F.col("x.doc_id")), F.col("f.digest") == F.col("x.digest")], "left").select(
        "f.doc_id", "f.assign", "f.access", "f.hex", F.coalesce("x.linked", none).alias("linked")
    )
