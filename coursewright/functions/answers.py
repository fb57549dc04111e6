"""Structured answers embedded in free text: locate, parse, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUESTION_SCHEMA = (
    "questions array<struct<question: string, choices: array<string>, correct_index: int, explanation: string>>, "
    "key_terms array<struct<term: string, definition: string>>"
)


def extract_json_block(text: Column) -> Column:
    """The text between the first ``{`` and the last ``}``, fences stripped; null when absent."""
    fenced = F.regexp_extract(text, r"(?s)```[^\n]*\n(.*)```", 1)
    body = F.when(fenced != "", fenced).otherwise(text)
    block = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    return F.when(block != "", block)


def parse_answers(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("answer", F.from_json(extract_json_block(F.col(column)), QUESTION_SCHEMA))


def validate_questions(parsed: DataFrame, key: str) -> DataFrame:
    """Questions with a text and two choices or more; an index out of range becomes 0."""
    rows = parsed.select(key, F.posexplode("answer.questions").alias("pos", "q"))
    size = F.size("q.choices")
    index = F.when((F.col("q.correct_index") >= 0) & (F.col("q.correct_index") < size), F.col("q.correct_index"))
    return rows.where((F.trim("q.question") != "") & (size >= 2)).select(
        key,
        "pos",
        F.trim("q.question").alias("question"),
        F.array_join("q.choices", "|").alias("choices"),
        F.coalesce(index, F.lit(0)).alias("correct_index"),
    )


def key_terms(parsed: DataFrame, key: str) -> DataFrame:
    """Terms with both sides filled in."""
    rows = parsed.select(key, F.inline("answer.key_terms")).select(
        key, F.trim("term").alias("term"), F.trim("definition").alias("definition")
    )
    return rows.where((F.col("term") != "") & (F.col("definition") != ""))


def key_term_cards(terms: DataFrame, key: str) -> DataFrame:
    return terms.select(key, F.col("term").alias("front"), F.col("definition").alias("back")).distinct()
