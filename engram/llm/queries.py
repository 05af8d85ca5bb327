"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import decontam, exact_dedup, html_extract, importance, jaccard_join, packing, quality, sharding, substring_dedup, suffix_dedup, topk_search, warc_zip, whitening
from .common import documents, table


def tokenizer_file() -> str:
    """The vocabulary file: ENGRAM_TOKENIZER, else the public file of the contract."""
    import public_tokenizers

    return os.environ.get("ENGRAM_TOKENIZER") or public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup(documents(spark, sf_dir), with_text=False)


def op4_warc(spark, sf_dir):
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op5_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer_file(), with_ids=False)


def op6_quality_classifier(spark, sf_dir):
    return quality.score(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op7_decontamination(spark, sf_dir):
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_sharding(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(documents(spark, sf_dir))


def op10_suffix_array(spark, sf_dir):
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir), with_bytes=False)


def op11_whitening(spark, sf_dir):
    out = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))  # beyond a long: null here, whole in the operator


def op12_importance_resampling(spark, sf_dir):
    out = importance.resample(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_topk_search(spark, sf_dir):
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_exact_dedup,
        op3_substring_dedup,
        op4_warc,
        op5_packing,
        op6_quality_classifier,
        op7_decontamination,
        op8_sharding,
        op9_jaccard_join,
        op10_suffix_array,
        op11_whitening,
        op12_importance_resampling,
        op13_topk_search,
    )
}
ORACLES = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_warc": warc_zip.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op10_suffix_array": suffix_dedup.ORACLE,
    "op12_importance_resampling": importance.ORACLE,
    "op13_topk_search": topk_search.ORACLE,
}
