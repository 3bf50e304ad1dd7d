"""The training-data pipeline: stages over documents, each written as Parquet and read back by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import encode_texts
from tessella.llm.decontamination import decontaminate
from tessella.llm.jaccard import keep_one
from tessella.llm.language import identify
from tessella.llm.queries import tokenizer
from tessella.llm.substrings import remove_repeated
from tessella.session import materialize


def with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of documents from a struct doc of all but the text, and the text; n_chars counts it anew."""
    new = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return df.select(*[(new[c] if c in new else F.col(f"doc.{c}")).alias(c) for c in columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages; null and empty texts, those without letters and those in none of them go.

    A null source is a host of its own; rows that repeat are judged alike.
    """
    return identify(docs, keep=tuple(docs.columns)).where("accepted").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle similarity of 0.8 or more: the one of least id, null before all.

    Rows that repeat are copies: one stays. Blank texts have no class and stay.
    """
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 35-word windows that stand anywhere else; no document goes.

    Null and blank texts become empty ones; n_chars counts the new text.
    """
    out = remove_repeated(docs, keep=tuple(c for c in docs.columns if c != "text"))
    return with_text(out, docs.columns, "kept_text")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; null and empty texts have none, an empty benchmark drops none."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(c for c in docs.columns if c != "text"))
    return with_text(out.where("n_hit = 0"), docs.columns, "text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to; a null or empty text has no ids."""
    out = encode_texts(docs, tokenizer("byte_bpe_50k.json"), keep=("doc_id", "lang", "source"), decode=True)
    return out.select("doc.*", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("benchmark", benchmark), ("tokens", tokens)]

#: The stages are not expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents in order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
