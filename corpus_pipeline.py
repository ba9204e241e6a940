"""From raw documents to token ids in stages; each is written as Parquet and read again as the next one's documents.

Toxic documents go; of each group of near copies the one with the smallest id stays; passages of 200 bytes and more that repeat
are cut out of the texts (in whole characters); documents that leak a benchmark item go; the rest is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliomill.llm import bpe, decontam, simhash, suffixdedup, toxicity
from foliomill.llm.common import table, written
from foliomill.session import tuned


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of those at hand, does not reject. Null texts are scored like empty
    ones; null ids and repeated rows stay or go by their text; without labels of both classes all stay, or go if all are toxic."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(tuned(spark), sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Null texts are one group, the empty one. A null id
    is the largest; unlike texts that share an id are judged apart; rows equal in id and text are one document."""
    return simhash.representatives(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once. Null texts become empty; null ids and repeated rows stay."""
    return suffixdedup.remove(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts, null ids and repeated rows stay; with no items all stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to. Null texts have no tokens."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("bpe", encode),
]

#: The first stages learn from data and follow chains of links, which SQL does not express; tests hold the pipeline against
#: plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(tuned(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
