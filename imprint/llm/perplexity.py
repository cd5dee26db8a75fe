"""Quality rules: surface counts of a text, and its perplexity under an n-gram model of the corpus.

The model is one of characters, order five, with modified Kneser-Ney smoothing and
one set of counts per language. Spark counts the n-grams of all documents and
derives lower orders, discounts and context weights by aggregation. What scoring
needs is two numbers per n-gram, its discounted probability and the weight that
its context leaves to the next lower order. A model of bounded size is held in
arrays sorted by a 64-bit hash; a larger one stays in tables, and the texts'
n-grams are joined to it.

A document is rejected when its perplexity lies outside its language's band, which
is set by the quartiles of all documents of that language.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from imprint.llm.common import SOLID, Words, batch, mix, slices, utf8
from imprint.session import materialize

ORDER = 5
#: Entries of a model that may be sent to every task, 12 bytes each; a larger model is joined.
SENT_ENTRIES = 1 << 24

_CHAR = 21
_MASK = (1 << _CHAR) - 1
#: Characters in the lower of the two integers of an n-gram; the first ones are in the higher.
_LOW = 3
#: Probability of a character before any is seen.
_BASE = 1 / 4096
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_PAD = ORDER - 1
_COUNTERS = 1 << 21


# ---------------------------------------------------------------- surface counts


def _repeated(words: Words, size: int) -> np.ndarray:
    """Per word: is it in a run of ``size`` words found twice or more in its text?"""
    begin, value = words.windows(size)
    marks = np.zeros(len(words.hash) + 1, np.int64)
    if len(begin):
        value = mix(value ^ mix(words.text[begin].astype(np.uint64)))
        order = np.argsort(value, kind="stable")
        same = value[order][1:] == value[order][:-1]
        twice = np.zeros(len(begin), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(marks, begin[twice], 1)
        np.add.at(marks, begin[twice] + size, -1)
    return np.cumsum(marks)[:-1] > 0


def _duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, count = set(), 0
    for line in lines:
        if line in seen:
            count += bool(line.split())
        seen.add(line)
    return count


def surface(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every text."""
    data, offsets = utf8(column)
    out = {k: np.zeros(len(column), np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for lo, hi in slices(offsets):
        piece, bounds = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]

        def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])

        words = Words(piece, bounds, SOLID)
        out["n_words"][lo:hi] = np.diff(words.first)
        out["word_chars"][lo:hi] = total(SOLID[piece] & ((piece & 0xC0) != 0x80), bounds)
        out["n_symbols"][lo:hi] = total(_SYMBOLS[piece], bounds)
        out["n_repeat_words"][lo:hi] = total(_repeated(words, 5), words.first)
        out["n_dup_lines"][lo:hi] = [_duplicate_lines(piece[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
    return out


# ---------------------------------------------------------------- n-grams


def _codes(piece: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the characters of texts, each text after ``_PAD`` zeros, and where each text's codes begin.

    Characters are lower-cased, digits are one, white space is one.
    """
    chars = np.frombuffer(piece.tobytes().decode("utf-8", "replace").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero((piece & 0xC0) != 0x80)
    if len(chars) != len(starts):  # lower-casing that lengthens a text: go without it
        chars = np.frombuffer(piece.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.where(chars < len(_FOLD), _FOLD[np.minimum(chars, len(_FOLD) - 1)], chars).astype(np.int64)
    at = np.searchsorted(starts, bounds)
    size = np.diff(at)
    out = np.zeros(len(chars) + _PAD * len(size), np.int64)
    out[np.arange(len(chars)) + np.repeat(_PAD * np.arange(1, len(size) + 1), size)] = chars
    return out, at + _PAD * np.arange(len(at))


_FOLD = np.arange(128, dtype=np.int64)
_FOLD[48:58] = 48
_FOLD[[9, 10, 11, 12, 13, 0]] = 32


def grams(piece: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram (high, low) that ends at each character, and bounds of the texts among them."""
    codes, at = _codes(piece, bounds)
    count = max(0, len(codes) - _PAD)
    gram = np.zeros((count, 2), np.int64)
    for k in range(ORDER):
        part = gram[:, int(k >= ORDER - _LOW)]
        part <<= _CHAR
        part |= codes[k : k + count]
    keep = np.ones(len(codes), bool)
    for k in range(_PAD):
        keep[at[:-1] + k] = False
    return gram[keep[_PAD:]], at - _PAD * np.arange(len(at))


def _key(gram: np.ndarray, salt: np.uint64) -> np.ndarray:
    """64-bit hashes of n-grams."""
    return mix(gram[:, 1].astype(np.uint64) ^ mix(gram[:, 0].astype(np.uint64) ^ salt))


def _distinct(gram: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams and how often each is there; with equal hashes one may come twice."""
    key = _key(gram, np.uint64(0))
    order = np.argsort(key)
    gram = gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]).any(1)
    first = np.flatnonzero(new)
    if n is None:
        return gram[first], np.diff(np.append(first, len(gram)))
    return gram[first], np.add.reduceat(n[order], first) if len(first) else n


def _count(batches):
    """(lang, high, low, n) of all texts a task sees, added up as far as memory is bounded."""
    held: dict[str, list] = {}

    def settle(lang):
        held[lang] = [_distinct(*(np.concatenate(x) for x in zip(*held[lang])))]

    def rows(langs):
        for lang in langs:
            settle(lang)
            g, n = held.pop(lang)[0]
            yield batch(lang=pa.repeat(pa.scalar(lang), len(g)), high=g[:, 0], low=g[:, 1], n=n)

    for b in batches:
        langs = np.array([v if v is not None else "und" for v in b.column("lang").to_pylist()], object)
        for lang in dict.fromkeys(langs.tolist()):
            data, offsets = utf8(b.column("text").filter(pa.array(langs == lang)))
            for lo, hi in slices(offsets):
                g, _ = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                held.setdefault(lang, []).append(_distinct(g))
                if sum(len(x) for x, _ in held[lang]) > _COUNTERS:
                    settle(lang)
            if sum(len(x) for v in held.values() for x, _ in v) > 2 * _COUNTERS:
                yield from rows(list(held))
    yield from rows(list(held))


# ---------------------------------------------------------------- the model


@dataclass
class Model:
    """Values by 64-bit hash of (language, order, kind, n-gram), in arrays sorted by hash."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def hash(lang: np.uint64, order: int, kind: int, gram: np.ndarray) -> np.ndarray:
        salt = mix(np.array([lang], np.uint64) ^ np.uint64(order * 2 + kind + 1))[0]
        return _key(gram, salt)

    def look(self, lang, order: int, kind: int, gram: np.ndarray, missing: float) -> np.ndarray:
        key = self.hash(lang, order, kind, gram)
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return np.where(self.keys[at] == key, self.values[at], missing) if len(self.keys) else np.full(len(gram), missing)

    def surprise(self, lang, gram: np.ndarray) -> np.ndarray:
        """Bits of the last character of each n-gram."""
        p = np.full(len(gram), _BASE)
        for order in range(1, ORDER + 1):
            own = gram & np.array([(1 << _CHAR * max(0, order - _LOW)) - 1, (1 << _CHAR * min(order, _LOW)) - 1])
            high, low = own.T
            context = np.stack([high >> _CHAR, (low >> _CHAR) | ((high & _MASK) << _CHAR * (_LOW - 1))], 1)
            p = self.look(lang, order, 0, own, 0.0) + self.look(lang, order, 1, context, 1.0) * p
        return -np.log2(np.maximum(p, 1e-12))


def lang_seed(lang: str) -> np.uint64:
    """A number for a language's name."""
    raw = lang.encode()
    return np.uint64(zlib.crc32(raw) | (zlib.adler32(raw) << 32))


def _entries(batches):
    """(key, value) of rows (lang, ord, kind, high, low, value)."""
    for b in batches:
        langs, orders, kinds = (np.array(b.column(k).to_pylist(), object) for k in ("lang", "ord", "kind"))
        gram, value = np.stack([b.column(k).to_numpy() for k in ("high", "low")], 1), b.column("value").to_numpy()
        keys = np.zeros(b.num_rows, np.uint64)
        group = pa.array([f"{o}/{k}/{v}" for v, o, k in zip(langs, orders, kinds)]).dictionary_encode()
        code = group.indices.to_numpy()
        for i, name in enumerate(group.dictionary.to_pylist()):
            order, kind, lang = name.split("/", 2)
            mine = code == i
            keys[mine] = Model.hash(lang_seed(lang), int(order), int(kind), gram[mine])
        yield batch(key=keys.view(np.int64), value=value)


_GRAM, _CONTEXT = ["lang", "high", "low"], ["lang", "c_high", "c_low"]


def _levels(rows: DataFrame) -> tuple[list[tuple[DataFrame, DataFrame]], int]:
    """Tables of the model of texts (lang, text), lowest order first, and a bound on their rows.

    For each order (lang, high, low, c_high, c_low, alpha) of all n-grams, the
    context being the n-gram without its last character, and (lang, c_high, c_low,
    gamma) of all contexts. The counts are whole: every character of every
    document enters.
    """
    counts = materialize(
        rows.filter("text is not null").mapInArrow(_count, "lang string, high bigint, low bigint, n bigint")
        .groupBy("lang", "high", "low").agg(F.sum("n").alias("n"))
    )
    levels, entries = [], 0
    for order in range(ORDER, 0, -1):
        entries += 2 * counts.count()
        few = {
            (r["lang"], r["n"]): r["many"]
            for r in counts.filter("n <= 4").groupBy("lang", "n").agg(F.count(F.lit(1)).alias("many")).collect()
        }
        table = []
        for lang in sorted({k[0] for k in few}):
            n1, n2, n3, n4 = (few.get((lang, k), 0) for k in (1, 2, 3, 4))
            y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
            cut = [k - (k + 1) * y * b / a if a else k * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
            table.append((lang, *(float(min(max(d, 0.05), k - 0.05)) for k, d in zip((1, 2, 3), cut))))
        discounts = rows.sparkSession.createDataFrame(table, "lang string, d1 double, d2 double, d3 double")
        known = (
            counts.join(F.broadcast(discounts), "lang", "left").na.fill(0.5, ["d1", "d2", "d3"])
            .withColumn("c_high", F.shiftright("high", _CHAR))
            .withColumn("c_low", F.shiftright("low", _CHAR).bitwiseOR(F.shiftleft(F.col("high").bitwiseAND(_MASK), _CHAR * (_LOW - 1))))
            .withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        )
        contexts = known.groupBy(*_CONTEXT).agg(F.sum("n").alias("total"), F.sum("d").alias("cut"))
        alpha = known.join(contexts.select(*_CONTEXT, "total"), _CONTEXT).select(
            *_GRAM, "c_high", "c_low", ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha")
        )
        levels.insert(0, (alpha, contexts.select(*_CONTEXT, (F.col("cut") / F.col("total")).alias("gamma"))))
        if order > 1:
            counts = materialize(counts.groupBy("lang", *_lower(order)).agg(F.count(F.lit(1)).alias("n")))
    return levels, entries


def _lower(order: int) -> list[Column]:
    """The n-gram without its first character."""
    high, low = (1 << _CHAR * max(0, order - 1 - _LOW)) - 1, (1 << _CHAR * min(order - 1, _LOW)) - 1
    return [F.col("high").bitwiseAND(F.lit(high).cast("bigint")).alias("high"), F.col("low").bitwiseAND(F.lit(low).cast("bigint")).alias("low")]


def _gather(levels: list[tuple[DataFrame, DataFrame]]) -> Model:
    """The model in arrays, exact but for equal 64-bit hashes."""
    every = None
    for order, (alpha, gamma) in enumerate(levels, 1):
        for kind, part in enumerate((alpha.select(*_GRAM, "alpha"), gamma)):
            named = part.toDF(*_GRAM, "value").select(F.lit(order).alias("ord"), F.lit(kind).alias("kind"), *_GRAM, "value")
            every = named if every is None else every.union(named)
    found = every.mapInArrow(_entries, "key bigint, value double").select("key", F.col("value").cast("float")).toArrow()
    keys, values = found.column("key").to_numpy().view(np.uint64), found.column("value").to_numpy()
    order = np.argsort(keys)
    return Model(keys[order], values[order])


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Modified Kneser-Ney model of all texts, by language (null: ``und``), gathered on the driver whatever its size."""
    return _gather(_levels(_texts(docs, text_col, lang_col))[0])


def _surprises(levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(lang, high, low, bits) of all n-grams of the highest order, by joins."""
    found = None
    for order, (alpha, gamma) in enumerate(levels, 1):
        own = alpha.join(gamma, _CONTEXT)
        if found is None:
            own = own.withColumn("p", F.lit(_BASE))
        else:
            l_high, l_low = _lower(order)
            own = own.withColumns({"l_high": l_high, "l_low": l_low}).join(
                found.toDF("lang", "l_high", "l_low", "p"), ["lang", "l_high", "l_low"]
            )
        found = materialize(own.select(*_GRAM, (F.col("alpha") + F.col("gamma") * F.col("p")).alias("p")))
    return found.select(*_GRAM, (-F.log2(F.greatest("p", F.lit(1e-12)))).alias("bits"))


class _Scorer:
    """Scores n-grams, with a table of the ones met last."""

    def __init__(self, model: Model, bits: int = 20):
        self.model, self.bits = model, bits
        self.keys = np.zeros(1 << bits, np.uint64)
        self.bitsof = np.zeros(1 << bits, np.float32)

    def score(self, lang: str, gram: np.ndarray) -> np.ndarray:
        seed = lang_seed(lang)
        key = _key(gram, mix(np.array([seed]))[0]) | np.uint64(1)
        slot = (key >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.bitsof[slot]
        miss = np.flatnonzero(self.keys[slot] != key)
        if len(miss):
            _, fresh, where = np.unique(key[miss], return_index=True, return_inverse=True)
            value = self.model.surprise(seed, gram[miss[fresh]]).astype(np.float32)[where]
            out[miss] = value
            self.keys[slot[miss]], self.bitsof[slot[miss]] = key[miss], value
        return out


def _score(shared):
    def run(batches):
        scorer = _Scorer(shared.value)
        for b in batches:
            found = surface(b.column("text"))
            langs = np.array([v if v is not None else "und" for v in b.column("lang").to_pylist()], object)
            chars, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            for lang in dict.fromkeys(langs.tolist()):
                rows = np.flatnonzero(langs == lang)
                data, offsets = utf8(b.column("text").take(pa.array(rows)))
                for lo, hi in slices(offsets):
                    g, at = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    sums = np.concatenate([[0], np.cumsum(scorer.score(lang, g), dtype=float)])
                    chars[rows[lo:hi]], total[rows[lo:hi]] = np.diff(at), np.diff(sums[at])
            bits = np.where(chars > 0, total / np.maximum(chars, 1), 0)
            yield batch(
                doc_id=b.column("doc_id"), lang=pa.array(langs.tolist(), pa.string()), **found, n_chars=chars,
                bits=pa.array(bits, mask=chars == 0),
            )

    return run


def _list(batches):
    """Per text a row with its surface counts, and a row for each of its distinct n-grams."""
    from pyspark import TaskContext

    row, names = TaskContext.get().partitionId() << 33, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for b in batches:
        found = surface(b.column("text"))
        langs = [v if v is not None else "und" for v in b.column("lang").to_pylist()]
        data, offsets = utf8(b.column("text"))
        chars = np.zeros(b.num_rows, np.int64)
        for lo, hi in slices(offsets):
            g, at = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            chars[lo:hi] = np.diff(at)
            parts = [_distinct(g[a:z]) for a, z in zip(at[:-1], at[1:])]
            size = np.array([len(x) for x, _ in parts])
            none = pa.nulls(int(size.sum()), pa.int64())
            yield batch(
                row=row + np.repeat(np.arange(lo, hi), size), doc_id=pa.nulls(len(none), b.schema.field("doc_id").type),
                lang=pa.array(langs[lo:hi], pa.string()).take(pa.array(np.repeat(np.arange(hi - lo), size))),
                **{k: none for k in names}, n_chars=none,
                high=np.concatenate([x[:, 0] for x, _ in parts]), low=np.concatenate([x[:, 1] for x, _ in parts]), times=np.concatenate([n for _, n in parts]).astype(np.int64),
            )
        none = pa.nulls(b.num_rows, pa.int64())
        yield batch(
            row=row + np.arange(b.num_rows), doc_id=b.column("doc_id"), lang=pa.array(langs, pa.string()),
            **{k: found[k] for k in names}, n_chars=chars, high=none, low=none, times=none,
        )
        row += b.num_rows


def _scored_by_join(rows: DataFrame, levels: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """What ``_score`` gives, the model staying in tables: the distinct n-grams of each text are joined to it."""
    kind = dict(rows.dtypes)["doc_id"]
    listed = materialize(
        rows.mapInArrow(
            _list,
            f"row bigint, doc_id {kind}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
            "n_repeat_words bigint, n_chars bigint, high bigint, low bigint, times bigint",
        )
    )
    total = (
        listed.filter("times is not null").select("row", *_GRAM, "times").join(_surprises(levels), _GRAM)
        .groupBy("row").agg(F.sum(F.col("bits") * F.col("times")).alias("total"))
    )
    return listed.filter("times is null").drop("high", "low", "times").join(total, "row", "left").select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars",
        F.when(F.col("n_chars") > 0, F.col("total") / F.col("n_chars")).alias("bits"),
    )


def judge(
    docs: DataFrame,
    width: float = 4.0,
    short: float = 16.0,
    least_words: int = 10,
    most_repeated: int = 20,
    sent_entries: int = SENT_ENTRIES,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Surface counts, perplexity and verdict of every text.

    Returns doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, perplexity (per character), lower and upper (the language's
    band), base_failed and kept.

    Base rule: a text fails with fewer than ``least_words`` words, or when more
    than ``most_repeated`` percent of its words are in repeated five-word runs.
    The others are kept if the binary logarithm of their perplexity lies within
    ``width`` quartile ranges of the quartiles of their language, plus
    ``short / sqrt(characters)`` for the scatter of short texts.

    Null and empty text has no words and fails. A null language is ``und``, a
    language of its own. Rows that repeat an id are judged one by one. Other
    columns are ignored. Empty tables give empty results.

    A model of at most ``sent_entries`` entries goes to every task. Beyond that the
    distinct n-grams of each text are shuffled to its tables; the result is the same.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kind = dict(rows.dtypes)["doc_id"]
    levels, entries = _levels(_texts(rows, "text", "lang"))
    if entries > sent_entries:
        scored = materialize(_scored_by_join(rows, levels))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(_gather(levels))
        scored = materialize(
            rows.mapInArrow(
                _score(shared),
                f"doc_id {kind}, lang string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
                "n_repeat_words bigint, n_chars bigint, bits double",
            )
        )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed)
    quartiles = scored.filter("NOT base_failed").groupBy("lang").agg(F.percentile_approx("bits", [0.25, 0.75], 2000).alias("q"))
    slack = width * (F.col("q")[1] - F.col("q")[0]) + short / F.sqrt(F.greatest("n_chars", F.lit(1)))
    lower, upper = F.col("q")[0] - slack, F.col("q")[1] + slack
    return scored.join(quartiles, "lang", "left").select(
        "doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.pow(F.lit(2.0), "bits").alias("perplexity"),
        F.pow(F.lit(2.0), lower).alias("lower"), F.pow(F.lit(2.0), upper).alias("upper"),
        "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("bits").between(lower, upper), F.lit(False))).alias("kept"),
    )
