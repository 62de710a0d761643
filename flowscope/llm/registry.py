"""Registered queries of this subpackage: name to function of (spark, sf_dir), and SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import share_code
from . import chat, decontaminate, lm_scoring, manifest, near_dedup, packing, pieces, ranked, sharding, token_files, topk, toxicity, warc


def _on(operator, *tables: str):
    def query(spark: SparkSession, sf_dir: str):
        share_code(spark)
        return operator(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])

    return query


QUERIES = {
    "op1_decontamination": _on(decontaminate.digest, "documents", "benchmark"),
    "op2_token_files": _on(token_files.digest, "documents"),
    "op3_warc_index_merge": _on(warc.digest, "pages"),
    "op4_best_fit_packing": _on(packing.digest, "documents"),
    "op5_lm_scoring": _on(lm_scoring.digest, "documents"),
    "op6_chat_perspectives": _on(chat.digest, "conversations"),
    "op7_pivot_top_k": _on(topk.digest, "embeddings"),
    "op8_toxicity_chain": _on(toxicity.digest, "documents", "labels"),
    "op9_sampled_shards": _on(sharding.digest, "documents"),
    "op10_minhash_near_dedup": _on(near_dedup.digest, "documents"),
    "op11_merkle_manifest": _on(manifest.digest, "documents"),
    "op12_ranked_search": _on(ranked.digest, "documents", "benchmark"),
    "op13_piece_ids": _on(pieces.digest, "documents"),
}
SQL = {
    "op1_decontamination": decontaminate.DIGEST_SQL,
    "op3_warc_index_merge": warc.DIGEST_SQL,
    "op10_minhash_near_dedup": near_dedup.DIGEST_SQL,
    "op11_merkle_manifest": manifest.DIGEST_SQL,
    "op12_ranked_search": ranked.DIGEST_SQL,
    "op6_chat_perspectives": chat.DIGEST_SQL,
    "op7_pivot_top_k": topk.DIGEST_SQL,
}
