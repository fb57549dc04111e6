"""From raw documents to packed training sequences; each stage is written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coursewright.llm import bpe, language, line_dedup, near_dedup, packing, substring_dedup
from coursewright.llm.staging import Stages
from coursewright.session import stage
from coursewright.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: The id after the last of the vocabulary, which no text gives.
END = 50256


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the language found as lang; without those whose text is null or holds no letter.

    The model is fitted on a bounded sample of ``docs`` by lang.  Every text with a letter has
    a best language and stays; where no language is known (lang is null in all of the sample's
    rows) it stays with lang as given.
    """
    docs = docs.select(*COLUMNS)
    model = language.fit(docs.where(~language.held_out()))
    named = language.identify(docs.where(language.lettered()), model)
    return (named.withColumn("lang", F.col("lang_pred")) if model.families else named).select(*COLUMNS)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of runs of lines; one that keeps no line goes.

    A document that had no line with content from the start stays.
    """
    cut = line_dedup.line_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    emptied = (F.col("removed_count") > 0) & (F.trim(F.translate("text", "\n", "")) == "")
    return cut.where(~F.coalesce(emptied, F.lit(False))).select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity 0.8.

    Rows are judged by id and text, so that texts which share an id do not go with each other.
    The row with the smallest id stays, a row without an id only where no other has one.  Of
    rows equal in id and text the one with the least source stays.  Rows without a word are in
    no group and all stay.
    """
    docs = docs.select(*COLUMNS)
    judged = near_dedup.near_rows(docs.select("doc_id", "text")).groupBy("doc_id", "version")
    judged = judged.agg(F.first("kept").alias("kept"), ((F.first("n_shingles") > 0) & (F.count(F.lit(1)) > 1)).alias("again"))
    marked = Stages(spark).keep("marked", judged.where("NOT kept OR again").toDF("_id", "_version", "_kept", "_again"))
    versioned = docs.withColumn("_own", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_version"))
    left = versioned.join(marked, same, "left_anti").select(*COLUMNS)
    again = marked.where("_kept")
    if again.isEmpty():
        return left
    rest = F.struct("source", "n_chars", "lang")
    once = versioned.join(again, same, "left_semi").groupBy("doc_id", "_own").agg(F.first("text").alias("text"), F.min(rest).alias("rest"))
    return left.unionByName(once.select("doc_id", "text", "rest.*").select(*COLUMNS))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier document holds; one that keeps no word goes.

    A document that had no word from the start stays.
    """
    cut = substring_dedup.substring_dedup(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))
    emptied = (F.col("removed_count") > 0) & (F.col("removed_count") == F.col("word_count"))
    return cut.where(~emptied).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: token ids of whole documents by best fit, each document closed by an end mark.

    One row a sequence: (bin_id, capacity, n_tokens, ids, segments); ``segments`` list the
    documents in it with their place in the text's ids and in the sequence.  A null or empty text
    is an end mark alone, rows that repeat an id are documents of their own, a null id stays null;
    no documents, no sequences.
    """
    encoded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.sequences(encoded, END)


STAGES = [
    ("language ID", identify),
    ("line dedup", cut_lines),
    ("MinHash near-dedup", drop_near),
    ("substring dedup", cut_passages),
    ("best-fit packing", pack),
]

#: Language models and greedy packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
