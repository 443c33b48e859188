"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has
kept; all but the last return the columns of docs, whatever their names, beside
doc_id and text. A row stays or goes by itself: doc_ids can repeat or be null.
Null and empty texts count as empty, texts of any length count whole, and an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import toxicity as tox
from tessera.llm._io import table
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.jaccard_join import jaccard_join
from tessera.llm.queries_text import packed
from tessera.llm.substring_dedup import passages, remove_passages

TOXIC = 0.3


def _new(docs: DataFrame) -> str:
    """A name that no column of docs has."""
    return next(n for n in (f"_row{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below TOXIC.

    Repeated rows share a score, rows without a text get that of no feature and
    rows without a doc_id that of their text. Without labels all rows stay, or
    none where the share of toxic labels is TOXIC or more.
    """
    model = tox.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _new(docs)
    return tox.score(docs, model, column=score).where(F.col(score) < TOXIC).drop(score)


def _kept(docs: DataFrame, mark: Callable[[DataFrame, str], DataFrame], flag: str) -> DataFrame:
    """The rows of docs that an operator marks, told apart by a number of their own."""
    row = _new(docs)
    numbered = table(docs.withColumn(row, F.monotonically_increasing_id()))
    marked = mark(numbered, row).where(flag).select(row)
    return numbered.join(marked, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text that is equal but for white space: one with the smallest doc_id, null last.

    Of repeated rows one stays, and one of all rows without a text.
    """
    return _kept(docs, lambda rows, row: exact_dedup(rows, row=row), "kept")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that five-word shingles link at 0.8 or more: one with the smallest doc_id, null last.

    Of repeated rows one stays; rows without words all stay.
    """
    return _kept(docs, lambda rows, row: jaccard_join(rows, row=row), "first")


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each without the passages of 50 words or more that an earlier one holds too.

    Earlier is in the order of doc_id, null last. Repeated rows are cut alike,
    rows without a text stay as they are, and n_chars, where there is one,
    counts the text that is left.
    """
    out = remove_passages(docs, table(passages(docs)))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens; repeated rows and rows without a doc_id or text have pieces of their own."""
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_passages),
    ("packing", pack),
]

#: The classifier, the alignment and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
