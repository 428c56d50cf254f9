"""From documents to token ids in five stages, each an operator of ``pagewright.llm`` over all that the one before kept.

A stage takes (spark, docs, sf_dir) and gives a DataFrame, which ``run`` writes as
Parquet in the shared folder and reads again as the next one's docs. All but the
last keep the columns of documents. How each treats nulls, empty texts, ties and
repeated rows is said in its operator's docstring; mixing may return a document
once per epoch, and encoding then encodes each of these rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import bpe, dedup, mixing, pii, quality
from pagewright.llm.common import prepare, shared_folder, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return dedup.drop_near_duplicates(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the budgets of the tree of domains, languages and sources."""
    return mixing.take_mix(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids, decoded) of each row."""
    from pyspark.sql import functions as F

    found = bpe.encode(docs, ["doc_id", "lang", "source"], stable=True, decoded=True)
    return found.select("doc_id", "lang", "source", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("pii", redact_pii),
    ("mixing", mix_sources),
    ("bpe", encode_bpe),
]

#: Fitted models and iterated components have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    prepare(spark)
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, done = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done is not None:
            _delete(spark, done)
        done = f"{folder}/{name}"
    return docs


def _delete(spark: SparkSession, folder: str) -> None:
    """Removes what a stage wrote, which its successor has read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
