"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of docs. A stage reads doc_id, text and lang alone and carries the other
columns along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellkit.llm import bpe_words, line_edit, minhash, perplexity, winnow
from dwellkit.llm.store import stored

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: SQL cannot express the perplexity bands, the edit join's components or BPE; tests hold the stages against brute force.
ORACLE_SQL = None


def _carried(docs: DataFrame, *operator_columns: str) -> DataFrame:
    """The columns that an operator reads, and the whole row beside them as one column."""
    return docs.select(*operator_columns, F.struct(*docs.columns).alias("whole_row"))


def _beside_text(docs: DataFrame) -> DataFrame:
    """As ``_carried``, for operators that give the text back: it isn't stored a second time in the row."""
    others = [c for c in docs.columns if c != "text"]
    return docs.select("doc_id", "text", F.struct(*others).alias("whole_row"))


def _rows(df: DataFrame, docs: DataFrame, **changed) -> DataFrame:
    return df.select(*[changed.get(c, F.col("whole_row")[c]).alias(c) for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and their language's perplexity band keep."""
    judged = perplexity.quality(_carried(docs, "doc_id", "text", "lang"), carry="whole_row")
    return _rows(judged.where("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that near-repeat an earlier one, n_chars counted anew; a
    document that loses its last word goes. Others stay as they are."""
    out = line_edit.deduplicated(_beside_text(docs), carry="whole_row", short=True)
    left = out.where((F.size("removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n_chars = F.when(F.size("removed") == 0, F.col("whole_row.n_chars")).otherwise(F.length("text"))
    return _rows(left, docs, text=F.col("text"), n_chars=n_chars.cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    grouped = minhash.near_duplicates(_beside_text(docs), carry="whole_row", with_text=True)
    return _rows(grouped.where("first"), docs, text=F.col("text"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    scanned = winnow.contamination(_carried(docs, "doc_id", "text"), items, carry="whole_row")
    return _rows(scanned.where("not contaminated"), docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document's ids and their decoded text."""
    return bpe_words.digests(docs, TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("bpe encoding and decoding", bpe_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each stored before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
