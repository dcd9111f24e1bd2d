"""Cleaning a corpus: toxic documents go, repeated lines go, near-duplicates go, sources are mixed, the rest is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from callatlas.llm import lines, mixing, pieces, similar, toxicity
from callatlas.llm.common import new_folder, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go, row by row; null and empty texts, repeated rows and other columns stay. No rows: none."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; documents that lose every line have nothing left and go too. Null and empty texts stay, equal rows are
    treated alike, other columns stay. No rows: none."""
    out = lines.dedup(docs, short=True)
    return out.where("text is null or lines_removed = 0 or text <> ''").drop("lines_removed")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the first by (doc_id, digest): five-word shingles, 0.8 or more.
    Texts without words are one group; of equal rows one stays; null and repeated doc_ids lose nothing by themselves."""
    return similar.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; texts without words have size 0 and follow their place. No rows: none."""
    return mixing.emit(mixing.mix(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids): null text has null ids, empty text none; repeated rows give equal rows. No rows: none."""
    return pieces.encode(docs, keep=("doc_id", "source"))


STAGES = [
    ("toxicity", toxic),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: No SQL: the network and the piece encoder can't be expressed in it. tests/llm tests each
#: stage, the others than the network against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written to the shared folder and read again as the next one's input."""
    folder = new_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
