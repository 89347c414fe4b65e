"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamill.llm import bpe, bsi_topk, decontaminate, infilling, near_dedup, ngram_join, ppm, pseudonyms, quality, secrets, spelling, substring_dedup, toxicity
from stratamill.llm._shared import crc_mod, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _held_out(mod: int, remainder: int) -> Column:
    """Whether a row's id has that remainder; a null id has none, so its row is not held out, but
    no model learns from it either."""
    return F.coalesce(crc_mod("doc_id", mod) == remainder, F.lit(False))


def op4_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _held_out(5, 0)
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    out = quality.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _held_out(4, 2)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.TOXIC).cast("int").alias("predicted"))


def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", _held_out(7, 2).alias("held_out"))
    docs = docs.withColumn("train", crc_mod("doc_id", 7) != 2)
    out = ppm.unigram(docs, "train", more=("held_out",), order=ppm.ORDER)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode(docs, vocabulary(), decoded_col="decoded"))


#: For the queries here; a pipeline of one's own takes a secret one.
KEY = b"stratamill"


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonyms.pseudonymised(docs, KEY)
    return out.select("doc_id", "text", *pseudonyms.counts(out))


def op2_bit_sliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return bsi_topk.top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


def op3_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = secrets.train(secrets.samples(spark, docs))
    return secrets.digests(secrets.scan(docs, model, runs_col="runs"), runs_col="runs")


def op11_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spelling.spelling_forms(table(spark, sf_dir, "documents"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return infilling.digests(infilling.restored(infilling.fill_in_middle(docs)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_feistel_pseudonyms": op1_feistel_pseudonyms,
    "op2_bit_sliced_topk": op2_bit_sliced_topk,
    "op3_markov_secrets": op3_markov_secrets,
    "op4_anchor_dedup": op4_anchor_dedup,
    "op5_tensored_minhash": op5_tensored_minhash,
    "op6_simhash_decontamination": op6_simhash_decontamination,
    "op7_attention_quality": op7_attention_quality,
    "op8_segments": op8_segments,
    "op9_ppm": op9_ppm,
    "op10_tree_bpe": op10_tree_bpe,
    "op11_spelling_forms": op11_spelling_forms,
    "op12_count_vector_join": op12_count_vector_join,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: DuckDB SQL for those that SQL can express.
ORACLE: dict[str, str] = {
    "op2_bit_sliced_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id AND len(q.e) = len(r.e)
  WHERE q.vec_id % 20 = 0
), k AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
""",
    "op13_fill_in_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), x AS (
  SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) % (length(t) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (length(t) + 1) AS c2,
    CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), y AS (SELECT doc_id, t, n, form, CASE WHEN c1 < c2 THEN c1 ELSE c2 END AS a, CASE WHEN c1 < c2 THEN c2 ELSE c1 END AS b FROM x)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM y
""",
}
