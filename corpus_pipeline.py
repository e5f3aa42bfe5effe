"""The corpus pipeline: five stages, each over all that the one before kept.

Language identification rejects documents without a language, line dedup drops
lines that an earlier document holds, near-dedup keeps one document of each
group, decontamination drops documents that hold a benchmark window, and BPE
turns the rest into token ids and decodes them.

Every stage takes the columns of documents, and other columns go.  Null, empty
and blank texts and texts without a letter have no language and are rejected by
the first stage.  Later stages, given such rows, keep them: they hold no line,
shingle or window, and have no tokens.  Rows without an id lose no lines, have no
copies and are never contaminated.  Repeated rows are treated alike by all
stages; near-dedup keeps all rows of the kept id.  Texts of any length are read
whole.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.bpe import bpe, word_bpe_path
from marlstone.llm.common import materialise, table
from marlstone.llm.decontaminate import decontaminate
from marlstone.llm.language_id import fit_language_id, language_id
from marlstone.llm.line_dedup import line_dedup
from marlstone.llm.near_dedup import near_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Least expected share of words in the predicted language.
MIN_SCORE = 0.3


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and those in which no language prevails."""
    docs = docs.select(*COLUMNS)
    found = language_id(docs, fit_language_id(docs))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE)).select(*COLUMNS)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that a document with a smaller id holds; all documents stay."""
    out = line_dedup(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near copies."""
    docs = docs.select(*COLUMNS)
    gone = materialise(near_dedup(docs).where(~F.col("kept")).select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def stage_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    found = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def stage_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, and the text decoded from them."""
    return bpe(docs.select("doc_id", "text"), word_bpe_path())


STAGES = [
    ("language_id", stage_language),
    ("line_dedup", stage_lines),
    ("near_dedup", stage_near),
    ("decontaminate", stage_leaks),
    ("bpe", stage_bpe),
]

#: SQL can't express the language model or the tokeniser; tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
