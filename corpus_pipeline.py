"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before it kept. The last returns the pieces of
the packed sequences; the others return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm import exact_dedup, mixing, packing, quality, simhash
from tracelake.llm.common import read, written
from tracelake.llm.queries import tokenizer

GOOD = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches GOOD."""
    scorer = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.scored(docs, scorer).filter(F.col("score") >= GOOD).select(*docs.columns)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document of the smallest id."""
    return exact_dedup.drop_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints of three-word shingles link within three bits, that of the smallest id."""
    return simhash.drop_near_copies(docs, within=3, shingle=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's budget takes it, which may be never."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in a sequence. A document that is taken twice is packed twice."""
    pieces = packing.token_pieces(docs, tokenizer(), length=1024, end_id=2)
    return packing.packed(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup_stage),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mix to target weights", mix_sources),
    ("best-fit packing", best_fit_packing),
]

# The classifier and the tokenizer have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
