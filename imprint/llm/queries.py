"""The registered queries of this package over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from imprint.llm import (
    chat, decontaminate, infill, language, licenses, mixing, ngram_join, perplexity, secrets, spelling, suffix_dedup, token_output, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, folder) under its own name."""

    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def train_languages(docs: DataFrame) -> language.KernelModel | None:
    """Learned from the rows outside the held-out quarter."""
    return language.train_language_model(docs.filter(fold(4) != 2))


@query()
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language.predict_language(docs, train_languages(docs))
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "recognised")


@query()
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents"))


def write_and_read_tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Token files in a new folder, and what is read back from them."""
    folder = token_output.new_folder(spark, "tokens")
    token_output.write_tokens(docs, folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_output.read_documents(spark, folder)


@query()
def op3_token_output(spark: SparkSession, folder: str) -> DataFrame:
    return write_and_read_tokens(spark, table(spark, folder, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_NGRAM_SQL = rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d
), u AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, CAST(min(r.b) AS BIGINT) AS component_id
FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.g)
"""


@query(_NGRAM_SQL)
def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.link_similar(table(spark, folder, "documents"), n=3, part=90, whole=100)


_CONTAMINATION_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS MATERIALIZED (
  SELECT DISTINCT item, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS x
  FROM (SELECT item, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS x
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), h AS MATERIALIZED (SELECT dw.doc_id, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.k = bw.k AND dw.x = bw.x),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


@query(_CONTAMINATION_SQL)
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), window=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op6_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, folder, "documents")).drop("spans")


def _listed(*kinds: str) -> Column:
    """kind:start:end of all spans, by start and then by kind in this order."""
    def named(n: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("a"), F.lit(n).alias("n"), F.lit(kind).alias("k"), s["stop"].alias("z")))

    spans = F.concat(*[named(n, kind) for n, kind in enumerate(kinds)])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["k"], s["a"], s["z"])), ",")


@query()
def op7_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, folder, "documents")).select(
        "doc_id",
        *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed("assign", "access", "hex"), 256).alias("base_sha256"),
        _listed("assign", "access", "hex", "linked").alias("spans"),
    )


@query()
def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.filter(fold(5) != 0))
    return toxicity.score(docs, model).select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


@query()
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, folder, "documents"), length=100).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query()
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return perplexity.judge(table(spark, folder, "documents"))


@query()
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, folder, "documents")))


_UNIT_SQL = "[A-Za-z]+|[^A-Za-z]"

_INFILL_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNIT_SQL}') AS u, sha256('1:' || doc_id) AS s FROM documents
), h AS MATERIALIZED (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
    CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d
), p AS MATERIALIZED (
  SELECT doc_id, t, n, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
    array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS suffix FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query(_INFILL_SQL)
def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, folder, "documents"), seed=1)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: What the conversation with id -1 says, in both of its turns.
CONTROL_TEXT = "</s>[INST] ok [/INST]"

_CHAT_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL_TEXT}'
), s AS (
  SELECT *, coalesce(role, '') AS r, regexp_replace(text, '{chat.control_pattern(chat.INSTRUCT)}', '\1\2\\\3', 'g') AS e,
    coalesce(last_value(CASE WHEN role IN ('system', 'user', 'assistant') THEN role END IGNORE NULLS) OVER (
      PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'start') AS state
  FROM c
), f AS (
  SELECT *, CASE WHEN role = 'system' AND state = 'start' THEN '<<SYS>>' || chr(10) || e || chr(10) || '<</SYS>>' || chr(10)
    WHEN role = 'user' AND state <> 'user' THEN '<s>[INST] ' || e || ' [/INST]'
    WHEN role = 'assistant' AND state = 'user' THEN ' ' || e || '</s>'
    ELSE '[ROLE]' || regexp_replace(r, '{chat.control_pattern(chat.INSTRUCT)}', '\1\2\\\3', 'g') || '[/ROLE] ' || e || '</s>' END AS turn_text
  FROM s
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(r || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(turn_text)) AS BIGINT) AS formatted_chars,
  CAST(count(*) FILTER (starts_with(turn_text, '[ROLE]')) AS BIGINT) AS n_irregular
FROM f GROUP BY conv_id
"""


def read_conversations(chunks: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from their chunks.

    The digest of a conversation is one over all of its text, so the chunks of a
    long one meet in the end; all others are whole already and stay where they are.
    """
    text, loss = chat.formatted(F.col("segments")), chat.learned(F.col("segments"))
    read = chunks.select("conv_id", "chunk", "alone", "n_irregular", text.alias("text"), loss.alias("loss"))
    read = read.withColumn("turns", chat.read_turns(F.col("text"))).select(
        "conv_id", "chunk", "alone", "n_irregular", "loss", F.size("turns").cast("bigint").alias("n_turns"),
        F.length("text").cast("bigint").alias("formatted_chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("said"),
    )
    columns = ["conv_id", "n_turns", "said", "loss", "formatted_chars", "n_irregular"]
    joined = read.filter("NOT alone").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk", "said", "loss"))).alias("parts"),
        *[F.sum(c).alias(c) for c in ("n_turns", "formatted_chars", "n_irregular")],
    )
    joined = joined.withColumns({c: F.array_join(F.col(f"parts.{c}"), "") for c in ("said", "loss")})
    return read.filter("alone").select(columns).union(joined.select(columns)).select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_irregular",
    )


@query(_CHAT_SQL)
def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema)
    return read_conversations(chat.format_chunks(turns.union(more)))
