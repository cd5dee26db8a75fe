"""Language identification with a string kernel, Nyström landmarks and kernel ridge regression.

The kernel of two texts counts the n-grams of one to three characters present in
both, over the root of the product of their own counts. Landmarks are texts of
the labelled sample; a text is described by its kernel with each landmark, and a
one-versus-rest ridge regression over that description scores the languages. All
texts of a batch are scored by two matrix products: presence by landmark n-grams,
kernel by coefficients.

Every text with a letter gets the best learned language. A text is not recognised
as of that language when too few of its own n-grams are known to the model. How few
is set for each language from the sample: halfway between what its rows that are no
landmarks reach and what their letters reach strewn at random.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from imprint.llm.common import batch

UNKNOWN = "und"
_ROWS = 64
#: Labels that each may have all their rows and landmarks; with more, each has fewer.
_LABELS = 64
#: Labels that may be sent to every task with their counts.
SENT_LABELS = 100_000
#: Sampled rows that the floor of a language is set from; with fewer only texts without any known n-gram are rejected.
_LEAST = 20
#: Least distance between those rows and random letters for a floor to mean anything.
_APART = 0.1


def profile(text: str | None, longest: int = 3) -> np.ndarray | None:
    """Distinct n-grams of a text as sorted integers; None without letters.

    Text is lower-cased, and every run of other characters than letters is one space.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    if not len(codes):
        return None
    kinds, where = np.unique(codes, return_inverse=True)
    letters = np.array([chr(c).isalpha() for c in kinds])[where]
    if not letters.any():
        return None
    codes = np.concatenate([[32], np.where(letters, codes, 32), [32]])
    codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
    grams, code = [], np.zeros(len(codes), np.int64)
    for n in range(1, longest + 1):
        code = (code[: len(codes) - n + 1] << 21) | codes[n - 1 :]
        grams.append(np.unique(code))
    return np.concatenate(grams)


def _strewn(profiles: list[np.ndarray], rows: int = 256) -> list[np.ndarray]:
    """Profiles of words of random letters, each with the letters and about the length of one of ``profiles``."""
    rng, out = np.random.default_rng(1), []
    for grams in profiles[:: max(1, len(profiles) // rows)]:
        letters = [chr(g) for g in grams[(grams < 1 << 21) & (grams != 32)]]
        size = int(np.clip(np.count_nonzero(grams >= 1 << 42), 20, 2000))
        text = np.array(letters)[rng.integers(0, len(letters), size)]
        text[rng.random(size) < 0.15] = " "
        out.append(profile("".join(text)))
    return [p for p in out if p is not None]


class KernelModel:
    """Landmark n-grams, coefficients and languages; plain arrays, sent to the tasks."""

    def __init__(self, profiles: list[np.ndarray], labels: list[str], landmarks_per_class: int, ridge: float):
        self.languages = sorted(set(labels))
        rank = {lang: k for k, lang in enumerate(self.languages)}
        y = np.array([rank[v] for v in labels])
        chosen = np.concatenate([np.flatnonzero(y == k)[:landmarks_per_class] for k in range(len(self.languages))])
        self.vocabulary = np.unique(np.concatenate([profiles[i] for i in chosen]))
        self.marks = np.zeros((len(self.vocabulary), len(chosen)), np.uint8)
        for j, i in enumerate(chosen):
            self.marks[np.searchsorted(self.vocabulary, profiles[i]), j] = 1
        self.norms = np.sqrt(np.array([len(profiles[i]) for i in chosen], np.float32))
        kernel = self.kernel(profiles)
        values, vectors = np.linalg.eigh(kernel[chosen].astype(float) + 1e-6 * np.eye(len(chosen)))
        whiten = vectors / np.sqrt(np.maximum(values, 1e-6))
        features = np.hstack([kernel @ whiten, np.ones((len(profiles), 1))])
        target = np.where(y[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        weight = 1.0 / np.bincount(y)[y]  # languages count alike however many rows they have
        gram = (features * weight[:, None]).T @ features
        solved = np.linalg.solve(gram + ridge * np.eye(len(gram)), (features * weight[:, None]).T @ target)
        self.coefficients = (whiten @ solved[:-1]).astype(np.float32)
        self.bias = solved[-1].astype(np.float32)
        values, found = self._values(profiles)
        unseen = values.argmax(1) == y
        unseen[chosen] = False  # every n-gram of a landmark is known
        self.floor = np.zeros(len(self.languages))
        for k in range(len(self.languages)):
            rows = np.flatnonzero(unseen & (y == k))
            if len(rows) >= _LEAST:
                clean = np.quantile(found[rows], 0.001)
                noise = np.median(self._values(_strewn([profiles[i] for i in rows]))[1])
                self.floor[k] = (clean + noise) / 2 if clean - noise > _APART else 0

    def _values(self, profiles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Regression value of every text and language, and the share of each text's n-grams that is known."""
        kernel, known = self._compare(profiles)
        return kernel @ self.coefficients + self.bias, known

    def kernel(self, profiles: list[np.ndarray]) -> np.ndarray:
        return self._compare(profiles)[0]

    def _compare(self, profiles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Kernel with every landmark, and the share of n-grams, the space aside, that landmarks have."""
        known = np.empty(len(profiles))
        out = np.empty((len(profiles), self.marks.shape[1]), np.float32)
        marks = self.marks.astype(np.float32)
        for a in range(0, len(profiles), _ROWS):
            part = profiles[a : a + _ROWS]
            present = np.zeros((len(part), len(self.vocabulary)), np.float32)
            for row, grams in zip(present, part):
                at = np.minimum(np.searchsorted(self.vocabulary, grams), len(self.vocabulary) - 1)
                row[at[self.vocabulary[at] == grams]] = 1
            own = np.sqrt(np.array([len(g) for g in part], np.float32))
            out[a : a + len(part)] = (present @ marks) / (own[:, None] * self.norms)
            known[a : a + len(part)] = (present.sum(1) - 1) / (own * own - 1)
        return out, known

    def predict(self, profiles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, share of the positive evidence it holds, whether enough of the text is known).

        Of languages with equal values the first in name order is taken.
        """
        f, found = self._values(profiles)
        best = f.argmax(1)
        evidence = np.clip((f + 1) / 2, 0, 1)
        top = evidence[np.arange(len(f)), best]
        return best, top / np.maximum(evidence.sum(1), 1e-9), found > self.floor[best]

    def predict_texts(self, texts: pa.Array):
        """(place, language number, score, recognised) of the texts that have a letter."""
        for a in range(0, len(texts), _ROWS):
            found = [(a + i, profile(t)) for i, t in enumerate(texts.slice(a, _ROWS).to_pylist())]
            found = [(i, p) for i, p in found if p is not None]
            if found:
                yield from zip([i for i, _ in found], *self.predict([p for _, p in found]))


def train_language_model(
    labelled: DataFrame,
    rows_per_language: int = 300,
    landmarks_per_language: int = 48,
    ridge: float = 1e-4,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> KernelModel | None:
    """A model of the languages of ``labelled``; None if no row has a label and letters.

    Learns from at most ``rows_per_language`` rows of every label, taken by a hash
    of id and text (equal rows are taken or left together), so the driver gathers the distinct n-grams of a bounded sample
    of each. With more than ``_LABELS`` labels each has a smaller sample and fewer
    landmarks, at least two rows and one landmark, so that all together stay as
    many as those of ``_LABELS``; no label is left out.
    """
    rows = labelled.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).filter("lang is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    many = counts.count()
    if not many:
        return None
    if many > _LABELS:
        rows_per_language = max(2, rows_per_language * _LABELS // many)
        landmarks_per_language = max(1, landmarks_per_language * _LABELS // many)
    # Twice the rows wanted, by the value of a hash, then the first of those.
    order = F.xxhash64("doc_id", "text", F.lit("language"))
    share = 2.0 * rows_per_language / F.col("rows") + 0.01
    # The texts stay where they are as long as the labels are few enough to be sent to them.
    joined = rows.join(F.broadcast(counts) if many <= SENT_LABELS else counts, "lang")
    sample = joined.filter(F.pmod(order, F.lit(1_000_003)) < share * 1_000_003)

    def run(batches):
        for b in batches:
            grams = [profile(t) for t in b.column("text").to_pylist()]
            yield batch(
                lang=b.column("lang"), order=b.column("order"), grams=pa.array([g if g is None else g.tobytes() for g in grams], pa.binary())
            )

    found = (
        sample.select("lang", order.alias("order"), "text")
        .mapInArrow(run, "lang string, order bigint, grams binary")
        .filter("grams is not null")
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("order", "grams"))
    kept = found.withColumn("nth", nth).filter(F.col("nth") <= rows_per_language).orderBy("lang", "nth").collect()
    if not kept:
        return None
    return KernelModel(
        [np.frombuffer(r.grams, np.int64) for r in kept], [r.lang for r in kept], landmarks_per_language, ridge
    )


def predict_language(
    docs: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and recognised of every text, from the text alone.

    Null text and text without letters is ``und`` with score 0 and not recognised,
    and so is every text when there is no model. Any other text has the best learned
    language; ``recognised`` is false if too little of it is known for that language.
    Rows that repeat an id come back as often. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            names, scores, known = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            if model:
                for i, k, score, recognised in model.predict_texts(b.column("text")):
                    names[i], scores[i], known[i] = model.languages[k], score, recognised
            yield batch(doc_id=b.column("doc_id"), lang_pred=pa.array(names, pa.string()), score=scores, recognised=pa.array(known))

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, lang_pred string, score double, recognised boolean")


def keep_recognised(docs: DataFrame, model: KernelModel | None, least_score: float = 0.0, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns kept, whose text is recognised with at least this score.

    Texts go that are null, without letters or of no learned language, and
    everything goes when there is no model.
    """

    def run(batches):
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            if model:
                texts = b.column(b.schema.get_field_index(text_col))
                for i, _, score, recognised in model.predict_texts(texts):
                    keep[i] = recognised and score >= least_score
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
