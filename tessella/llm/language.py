"""Language ID by Bayesian evidence fusion.

Log posterior of a language = text likelihood + declared markup language + prior of the host. The likelihood is a
multinomial over hashed byte trigrams, tempered since neighbouring trigrams overlap; it is fitted on a bounded sample
of labelled rows. Host priors are grouped sums of the text posteriors of all rows, smoothed towards the prior of the
host's address suffix, which is smoothed towards the prior of all rows. A uniform "und" class competes, so texts in
none of the languages are rejected rather than forced into one.

Defined cases: a text without letters (null and empty ones too) is "und", probability 1, not accepted; a null host or
declaration is missing evidence; repeated rows count in the priors each and get the same result; an empty table gives
an empty result. Only the named columns are read; those asked for are passed on inside a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.textbits import binaries, chunks, modest_batches, tidy
from tessella.session import materialize

BUCKETS = 1 << 15
CHUNK = 1_500_000
#: Rows of host priors that are broadcast at most; more are joined by a shuffle.
BROADCAST_HOSTS = 200_000
_CODE = np.arange(256)
_FOLD = np.where((_CODE >= 65) & (_CODE <= 90), _CODE + 32, np.where((_CODE >= 128) | ((_CODE >= 97) & (_CODE <= 122)), _CODE, 32)).astype(np.uint8)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all trigrams that hold a letter beside a letter, where each text's begin, and letters per text."""
    raw = _FOLD[np.frombuffer(b"  ".join([b"", *texts, b""]), np.uint8)]
    a, b, c = (raw[i : len(raw) - 2 + i].astype(np.uint32) for i in range(3))
    bucket = ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))) >> np.uint32(17)
    use = (b != 32) & ((a != 32) | (c != 32))
    ends = np.cumsum([0, *[len(t) + 2 for t in texts]])[:-1]
    before = np.concatenate([[0], np.cumsum(use)])
    letters = np.concatenate([[0], np.cumsum(raw != 32)])
    heads = np.append(ends, len(raw) - 2)
    return bucket[use], before[np.minimum(heads, len(use))], np.diff(letters[np.append(ends, len(raw))])


def fit(docs: DataFrame, languages: tuple[str, ...], *, text: str, label: str, rows: int) -> np.ndarray:
    """Log probabilities [bucket, language and "und"] from at most `rows` distinct labelled texts, the least by a hash of the text."""
    own = docs.select(F.col(text).alias("text"), F.col(label).alias("label")).where(F.col("label").isin(*languages) & F.col("text").isNotNull())
    picked = own.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(rows)
    sample = own.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), "h").groupBy("h").agg(F.min(F.struct("label", "text")).alias("r")).select("r.label", "r.text")

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            labels, texts = np.array(batch.column(0).to_pylist()), binaries(batch.column(1))
            for i, language in enumerate(languages):
                mine = [texts[j] for j in np.flatnonzero(labels == language)]
                for a, b in chunks(mine, CHUNK):
                    sums[i] += np.bincount(trigrams(mine[a:b])[0], minlength=BUCKETS)
        i, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[i, bucket], pa.int64())], ["i", "bucket", "n"])

    counts = np.zeros((BUCKETS, len(languages) + 1))
    for r in sample.mapInArrow(count, "i int, bucket int, n bigint").groupBy("i", "bucket").agg(F.sum("n").alias("n")).collect():  # languages times buckets at most
        counts[r["bucket"], r["i"]] = r["n"]
    counts += 0.5
    counts[:, -1] = 1
    return np.log(counts / counts.sum(axis=0)).astype(np.float32)


def likelihoods(model: np.ndarray, texts: list[bytes], full: float) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log likelihoods [text, class]: a text weighs as `full` independent trigrams at most; letters."""
    bucket, heads, letters = trigrams(texts)
    n = np.diff(heads)
    out = np.zeros((len(texts), model.shape[1]))
    for i in range(model.shape[1]):
        sums = np.concatenate([[0.0], np.cumsum(model[bucket, i], dtype=np.float64)])
        out[:, i] = sums[heads[1:]] - sums[heads[:-1]]
    return out * (np.minimum(n / 3, full) / np.maximum(n, 1))[:, None], letters


def posterior(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def host_priors(df: DataFrame, model: np.ndarray, full: float, strength: float) -> tuple[DataFrame, list[float]]:
    """host, log prior of each class, and the prior of all rows. df: host, suffix, text."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    classes = model.shape[1]

    @tidy
    def soft(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binaries(batch.column(2))
            for a, b in chunks(texts, CHUNK):
                logs, letters = likelihoods(sent.value, texts[a:b], full)
                p = posterior(logs)
                p[letters == 0] = 0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *[pa.array(p[:, i]) for i in range(classes)]], ["host", "suffix", *[f"p{i}" for i in range(classes)]])

    names = [f"p{i}" for i in range(classes)]
    each = df.mapInArrow(soft, "host string, suffix string, " + ", ".join(f"{n} double" for n in names))
    # Sums of whole thousandths do not depend on the order in which tasks end.
    hosts = each.groupBy("host", "suffix").agg(*[F.sum(F.round(F.col(n) * 1000).cast("bigint")).alias(n) for n in names])
    hosts = materialize(hosts, "host-counts")
    total = hosts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    base = np.array([total[n] for n in names], float) + 1000
    base /= base.sum()
    whole = lambda ns: sum((F.col(n) for n in ns[1:]), F.col(ns[0]))
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(n).alias(f"s{n}") for n in names])
    smooth = 1000 * strength
    suffixes = suffixes.select("suffix", *[((F.col(f"s{n}") + smooth * float(q)) / (whole([f"s{n}" for n in names]) + smooth)).alias(f"s{n}") for n, q in zip(names, base, strict=True)])
    joined = hosts.join(suffixes, "suffix")
    logs = [F.log((F.col(n) + smooth * F.col(f"s{n}")) / (whole(names) + smooth)) for n in names]
    return joined.select("host", F.array(*logs).alias("prior")), base.tolist()


def suffix_of(host: Column) -> Column:
    """What follows the last dot of the host's name; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(host), r"\.([a-z0-9-]+)(?::\d+)?$", 1), F.lit(""))


def identify(docs: DataFrame, *, languages: tuple[str, ...] = ("de", "en", "es", "fr"), text: str = "text", label: str = "lang", host: str | None = "source", declared: str | None = None, keep: tuple[str, ...] = ("doc_id",), sample_rows: int = 8000, full: float = 60.0, strength: float = 20.0, trust: float = 0.9, least: float = 0.5, labelled: DataFrame | None = None) -> DataFrame:
    """Rows doc (a struct of the columns in keep), language, probability, accepted.

    label names the column that fits the model on a sample of at most sample_rows rows; it is no evidence. labelled is
    the table that has it, if docs has none. declared
    names a column of declared languages, right with probability `trust`. Accepted: a listed language with a
    probability of `least` or more.
    """
    modest_batches(docs.sparkSession)
    model = fit(docs if labelled is None else labelled, languages, text=text, label=label, rows=sample_rows)
    hosted = F.coalesce(F.col(host).cast("string"), F.lit("")) if host else F.lit("")
    said = F.lower(F.substring(F.col(declared).cast("string"), 1, 2)) if declared else F.lit(None).cast("string")
    df = docs.select(F.struct(*keep).alias("doc"), F.col(text).alias("text"), hosted.alias("host"), said.alias("declared"))
    priors, base = host_priors(df.select("host", suffix_of(F.col("host")).alias("suffix"), "text"), model, full, strength)
    small = priors.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = df.join(F.broadcast(priors) if small else priors, "host", "left").select("doc", "text", "prior", "declared")
    names, sent = [*languages, "und"], docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def fuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binaries(batch.column(1))
            for a, b in chunks(texts, CHUNK):
                logs, letters = likelihoods(sent.value, texts[a:b], full)
                logs += np.array([p or np.log(base) for p in batch.column(2).slice(a, b - a).to_pylist()])
                for i, d in enumerate(batch.column(3).slice(a, b - a).to_pylist()):
                    if d in languages:
                        logs[i] += np.log([trust if x == d else (1 - trust) / len(languages) for x in names])
                p = posterior(logs)
                p[letters == 0] = [0] * len(languages) + [1]
                best = p.argmax(axis=1)
                most = p[np.arange(len(p)), best]
                accepted = (best < len(languages)) & (most >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([names[i] for i in best], pa.string()), pa.array(most), pa.array(accepted)], ["doc", "language", "probability", "accepted"])

    schema = T.StructType([joined.schema["doc"], T.StructField("language", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return joined.mapInArrow(fuse, schema)


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text without markup, host and declared language of raw pages, as identify reads them."""
    html = F.coalesce("html", F.lit(""))
    plain = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    return pages.select("page_id", plain.alias("text"), F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract(html, r"(?is)<html\b[^>]*\blang\s*=\s*[\"']?([a-z]{2})", 1).alias("declared"))
