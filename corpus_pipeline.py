"""A training corpus from raw documents, stage by stage.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``, unchanged, whatever they are called: the
operators' own columns never meet them. ``docs`` needs ``doc_id`` and ``text``,
and ``lang`` and ``source`` where a stage says so. An empty table gives an
empty one in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.llm import langid, mixing, packing, simhash, toxicity
from lamella.llm.common import place, remove, renamed, scratch, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; it learns from the labels of all documents.

    Null, empty and wordless texts hold no term and stay; a row without an id
    is scored like any other but teaches nothing. Repeated rows get one score,
    so all of them stay or go. Without labels of both kinds nothing goes.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    private, names, own = renamed(docs)
    return own(toxicity.score(private, model, names["text"]).where(F.col("predicted") == 0))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: those with null or empty text or without a letter, and those that no language's code fits.

    The model learns from ``lang``; rows without it are judged all the same.
    Repeated rows stay or go together. Without any row to learn from no
    language is known, and everything goes.
    """
    model = langid.train(docs)
    private, names, own = renamed(docs)
    found = langid.identify(private, model, names["text"])
    return own(found.where((F.col("lang_pred") != langid.UNKNOWN) & F.col("fits")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (shingles of five words, similarity 0.8) one document stays, whole.

    It is the one with the smallest id (null last), ties by text and row.
    Null, empty and wordless texts are one group. Rows that share an id, or
    have none, are documents of their own; repeated rows are copies.
    """
    return simhash.deduplicate(docs, words=simhash.WORDS, similarity=simhash.SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights; documents are repeated or left out for that.

    Documents without a source are one source, the last. Extra copies are spread
    evenly over a source's documents by size; rows with one id, or without, are
    documents of their own. Null and empty texts weigh nothing and are taken as
    often as their source's others.
    """
    return mixing.mix(docs, spaced=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, packed into sequences; a null or empty text is its end id, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned models and token ids can't be expressed in SQL; the tests hold ``run`` against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage wrote is removed when the next one has written its rows."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = place(spark)
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), path)
        if last:
            remove(spark, last)
        last = path
    return docs
