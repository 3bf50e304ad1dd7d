"""Thin queries over whole tables, one per operator: each derives its digest columns from the operator's output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.bpe import encode_texts, read_definition
from tessella.llm.decontamination import decontaminate, proximity_matches
from tessella.llm.jaccard import NO_ID, similar_documents
from tessella.llm.language import identify, page_evidence
from tessella.llm.licenses import scan_licenses
from tessella.llm.pages import extract
from tessella.llm.quality import quality_rules
from tessella.llm.substrings import remove_repeated
from tessella.llm.tokenfiles import read_tokens, write_tokens
from tessella.llm.toxicity import score, train
from tessella.session import shared_dir


def tokenizer(name: str) -> str:
    """A public tokenizer's definition from the installed files."""
    import public_tokenizers

    return read_definition(public_tokenizers.path(name))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated(read(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: its class (the least id in it) and how many other documents are similar to it."""
    out = similar_documents(read(spark, sf_dir, "documents"))
    shown = lambda c, name: F.when(F.col(c) != NO_ID, F.col(c)).alias(name)
    return out.select(shown("id", "doc_id"), shown("label.id", "class_id"), "n_links")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    definition = tokenizer("byte_bpe_50k.json")
    out = encode_texts(read(spark, sf_dir, "documents"), definition, decode=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(read(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", "language", F.round("probability", 6).alias("probability"), F.col("accepted").alias("kept"))


def op5_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of raw pages by all evidences: text, declared language, host and its suffix; documents fit the model."""
    out = identify(page_evidence(read(spark, sf_dir, "pages")), declared="declared", host="host", keep=("page_id",), labelled=read(spark, sf_dir, "documents"))
    return out.select("doc.page_id", "language", F.round("probability", 6).alias("probability"), F.col("accepted").alias("kept"))


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts and labels from the spans of scan_licenses."""
    base = F.filter("spans", lambda s: s["base"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    first = F.transform(base, lambda s: s["first"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(read(spark, sf_dir, "documents")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), ids, (F.col("n_hit") > 0).alias("contaminated"))


def op7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places near which most words of a benchmark window stand; op7_decontamination has the exact phrases."""
    out = proximity_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "wid", F.array_join("items", ",").alias("items"), "first", "last", "found")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_distance", "common_distance")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path, end=2)
    return read_tokens(spark, path, digest=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = score(docs, train(docs, read(spark, sf_dir, "labels")))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_pages": op2_pages,
    "op3_jaccard": op3_jaccard,
    "op4_bpe": op4_bpe,
    "op5_language": op5_language,
    "op5_pages": op5_pages,
    "op6_licenses": op6_licenses,
    "op7_decontamination": op7_decontamination,
    "op7_proximity": op7_proximity,
    "op8_quality": op8_quality,
    "op9_tokens": op9_tokens,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substrings": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
        gone AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS j FROM win SEMI JOIN twice USING (s)),
        each AS (SELECT rid, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
        kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY j) AS t FROM each ANTI JOIN gone USING (rid, j) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (rid)""",
    "op7_decontamination": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
        placed AS (SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        hit AS (SELECT rid, n, s, item FROM placed JOIN win USING (n, x)),
        cover AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(s, s + n)) AS j FROM hit) GROUP BY rid),
        found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cover USING (rid) LEFT JOIN found USING (rid)""",
}
