"""The corpus pipeline: five stages over documents, each written as Parquet and read by the next.

1. toxicity: documents the classifier rejects go;
2. exact dedup: of equal texts one stays;
3. n-gram join: of each component of near duplicates (five words, similarity 0.8 or more) one document stays;
4. mixing: every document is repeated as often as the mix of sources takes it;
5. SentencePiece: every text is encoded and decoded again.

All but the last return the columns of documents; the last returns doc_id with the ids, their digests,
and whether decoding gave the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrgraph.llm import exact_dedup, mixing, ngram_join, sentencepiece_scan, toxicity
from corrgraph.llm.common import save

#: Words of a shingle, and percent of similarity, of the near-duplicate stage; op5 has its own contract.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80

#: Training, and pairing in the mix, cannot be said in SQL.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the cut. The classifier learns from the rows that op9 learns from.

    Every row is judged by its own text, so ids may repeat or be null; null and empty texts stay, and
    without labels of both kinds every row does.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels, held=toxicity.held_out())


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts (white space apart) one stays; null and empty texts are equal."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest id stays; texts without words stay all."""
    return ngram_join.drop_near_duplicates(docs, size=NEAR_SHINGLE, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, 0 to 2 times; a null source is a source, a text without words goes."""
    return mixing.mix_documents(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and their digests of every row, and whether decoding the ids gives its text back; null is empty."""
    import public_tokenizers

    return sentencepiece_scan.round_trips(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
