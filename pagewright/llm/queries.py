"""The operators over their whole tables, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from pagewright.llm import bpe, dedup, knn, mixing, pii, ppm, quality, repetition, secrets, urls
from pagewright.llm.common import table

QUERIES = {
    "op1_secret_scan": lambda spark, sf_dir: secrets.scan(table(spark, sf_dir, "documents")),
    "op2_ppm_scoring": lambda spark, sf_dir: ppm.code_lengths(table(spark, sf_dir, "documents")),
    "op3_repetition_rules": lambda spark, sf_dir: repetition.repetition(table(spark, sf_dir, "documents")),
    "op4_bpe_encode_decode": lambda spark, sf_dir: bpe.encode_and_decode(table(spark, sf_dir, "documents"), stable=True),
    "op5_url_cascade": lambda spark, sf_dir: urls.tracked_pages(table(spark, sf_dir, "pages")),
    "op6_minhash_near_dedup": lambda spark, sf_dir: dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key"),
    "op7_mixing": lambda spark, sf_dir: mixing.mixed(table(spark, sf_dir, "documents")),
    "op8_pii": lambda spark, sf_dir: pii.redact(table(spark, sf_dir, "documents")),
    "op9_voronoi_knn": lambda spark, sf_dir: knn.nearest(table(spark, sf_dir, "embeddings")),
    "op10_quality_classifier": lambda spark, sf_dir: quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
}
ORACLES = {"op5_url_cascade": urls.ORACLE, "op7_mixing": mixing.oracle(), "op9_voronoi_knn": knn.ORACLE}
