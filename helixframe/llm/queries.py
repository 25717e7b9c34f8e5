"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat_prefix, concat_packing, embed_hnsw, hard_negatives, license_digest, parity_join, pii_bootstrap, quality_gam, runlength_dedup, source_mixing, spotsigs, word_runs
from .common import table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
CONTROL = "</s>[INST] ok [/INST]"


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_hnsw.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.find(table(spark, sf_dir, "documents"))


def op3_chat_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(CONTROL))
    return chat_prefix.conversation_digests(chat_prefix.format_examples(turns.union(probe)))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.roundtrip_digests(table(spark, sf_dir, "documents"), RANKS, PATTERN)


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.score_documents(docs, model)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlength_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_concat_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return concat_packing.pack(table(spark, sf_dir, "documents"), RANKS, PATTERN, concat_packing.added_tokens(TOKENIZER)).drop("ids")


def op9_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scan(table(spark, sf_dir, "documents"))


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compare_with_edits(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(table(spark, sf_dir, "documents"))


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.detect(table(spark, sf_dir, "documents"), planted=True).drop("collapsed", "runs")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_embedding_near_dedup, op2_pii_bootstrap, op3_chat_prefix, op4_byte_bpe, op5_quality_gam,
        op6_suffix_dedup, op7_ngram_jaccard, op8_concat_packing, op9_license_digest, op10_spotsigs,
        op11_hard_negatives, op12_source_mixing, op13_word_runs,
    )
    return {f.__name__: f for f in ops}


def _escaped(e: str) -> str:
    for plain, entity in chat_prefix.ENTITIES:
        e = f"replace({e}, '{plain}', '{entity}')"
    return e


_OP3 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'
), placed AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum({len(chat_prefix.OPEN + chat_prefix.ROLE_END + chat_prefix.CLOSE)} + length({_escaped('role')}) + length({_escaped('text')})) OVER w AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
"""

_OP1 = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM reach r JOIN links l ON r.a = l.a
), comp AS (SELECT a, min(c) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM embeddings v JOIN comp c ON c.a = v.vec_id LEFT JOIN deg d ON d.a = v.vec_id
"""


_OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2], words[i + 3], words[i + 4]))) END AS sh FROM w
), u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT l.b, r.c FROM reach r JOIN links l ON r.a = l.a), comp AS (SELECT a, min(c) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, comp.c AS component_id FROM s JOIN comp ON comp.a = s.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express over whole tables; the others are tested by brute force."""
    return {"op1_embedding_near_dedup": _OP1, "op3_chat_prefix": _OP3, "op7_ngram_jaccard": _OP7, "op9_license_digest": license_digest.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op12_source_mixing": source_mixing.sql()}
