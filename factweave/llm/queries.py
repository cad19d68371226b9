"""The corpus operators as registered queries: ``opN_<name>(spark, sf_dir)`` with production parameters.

The range join and the URL filter can be said in DuckDB SQL within reason; the others (hash families, tokenizers,
fitted models, sequential rounding) are tested against a brute-force form instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm import embeddings, linededup, media, mixing, packing, quality, sharding, simhash, spans, token_counts, toxicity, urltrust, whitening
from factweave.llm.common import table


def op3_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=4, fold=2, threshold=0.3)


def op2_karmarkar_karp_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op5_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), window=1024)


def op7_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op8_boosted_gam_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=3, fold=1, threshold=0.5)


def op9_patience_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_link_trust_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrust.judge_urls(table(spark, sf_dir, "pages"))


def op12_refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_span_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_nnpu_toxicity,
        op2_karmarkar_karp_shards,
        op3_simhash_pigeonring,
        op4_token_counts,
        op5_metric_range_join,
        op6_retrieval_packing,
        op7_interleaved_media,
        op8_boosted_gam_quality,
        op9_patience_line_dedup,
        op10_entropy_balanced_mix,
        op11_link_trust_urls,
        op12_refined_whitening,
        op13_span_alignment,
        pipeline,
    )
    return {f.__name__: f for f in found}


#: The plain join of all pairs of one label, and the least id that links reach.
OP5_SQL = """WITH RECURSIVE unit AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS size FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93),
 reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
 least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept FROM embeddings e JOIN least c USING (vec_id)"""


def oracle_sql() -> dict[str, str]:
    """See above. ``corpus_pipeline.ORACLE_SQL`` is None for the same reason as the others."""
    return {"op5_metric_range_join": OP5_SQL, "op11_link_trust_urls": urltrust.sql()}
