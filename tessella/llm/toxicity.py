"""Toxicity by maximum-scoring segments.

Words score by their log-odds between toxic and clean labelled texts under an informative Dirichlet prior; words
without clear evidence score a small negative drift. A linear-time scan finds every maximal-scoring segment of a text.
Extreme-value statistics calibrate them: a segment of score S in a text of n words has E = n exp(-lambda S) chance
segments as good, where lambda solves sum p_i exp(lambda s_i) = 1 over the clean words. A document's score is a
logistic function of its best segment, of all significant ones and of its length.

Defined cases: a null or empty text has no segment and a score from its length alone; labels without a class are left
out, of several for one document the highest counts; without any labelled rows every score is 0; repeated rows get
the same score; a null doc_id has no label and crc32 of nothing, 0, so it is held out; an empty table gives an empty
result. Only the text is scored; other columns are never inputs and cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.decontamination import words_of
from tessella.llm.textbits import letter_words, modest_batches, slices, tidy, word_hashes
from tessella.session import materialize

CHUNK = 1_000_000
#: Labelled texts that calibrate a model, at most.
CALIBRATION_ROWS = 20_000
#: Labelled rows that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
SEED = 11
_SPAN = "array<struct<first int, n int, score double, expected double>>"


@dataclass
class Toxicity:
    """Sorted hashes of the scored words, their scores, the drift of all others, lambda and the logistic weights."""

    hashes: np.ndarray
    scores: np.ndarray
    drift: float
    scale: float
    weights: np.ndarray


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(0))


def hash_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    lens = np.array([len(w) for w in raw], np.int64)
    return word_hashes(b"".join(raw), np.cumsum(lens) - lens, lens, SEED) if raw else np.zeros(0, np.uint64)


def segments(at: np.ndarray, scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, end, score) of a text with scored words at the given places.

    Every word is looked at once and every segment joins a larger one at most once: a segment knows the nearest one
    before it that starts lower (`back`), so the walk over starts that are not lower is never made twice.
    """
    lefts: list[float] = []
    rights: list[float] = []
    firsts: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    total, last = 0.0, 0
    for i, s in zip(at.tolist(), scores.tolist(), strict=True):
        total -= drift * (i - last)
        last = i + 1
        left, total = total, total + s
        if s <= 0:
            continue
        first, j = i, len(lefts) - 1
        while True:
            while j >= 0 and lefts[j] >= left:
                j = back[j]
            if j < 0 or rights[j] >= total:
                break
            # The segment reaches down to that start and takes all from there on.
            left, first = lefts[j], firsts[j]
            nearest = back[j]
            del lefts[j:], rights[j:], firsts[j:], ends[j:], back[j:]
            j = nearest
        lefts.append(left)
        rights.append(total)
        firsts.append(first)
        ends.append(i + 1)
        back.append(j)
    return [(a, b, right - left) for left, right, a, b in zip(lefts, rights, firsts, ends, strict=True)]


def log_odds(words: DataFrame, n_toxic: int, n_clean: int, *, least_z: float, least_score: float, prior: float) -> pa.Table:
    """term, score, n of all words whose log-odds are clearly and strongly positive; words: term, toxic, clean, n."""
    total = n_toxic + n_clean
    a = prior * (F.col("toxic") + F.col("clean"))
    mass = prior * total
    odds = lambda y, n: F.log((F.col(y) + a) / (F.lit(float(n)) + mass - F.col(y) - a))
    scored = words.withColumn("score", odds("toxic", n_toxic) - odds("clean", n_clean))
    scored = scored.withColumn("z", F.col("score") / F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a)))
    return scored.where((F.col("z") >= least_z) & (F.col("score") >= least_score)).select("term", "score", "n").toArrow()


def decay(scores: np.ndarray, shares: np.ndarray, drift: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over clean words, of which all but the scored ones have the drift."""
    if not len(scores):
        return 1.0
    f = lambda x: float((shares * np.exp(x * scores)).sum() + (1 - shares.sum()) * math.exp(-x * drift)) - 1
    low, high = 1e-6, 1.0
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return max(low, 1e-3)


def features(model: Toxicity, texts: list[bytes], significant: float) -> tuple[np.ndarray, list[list[tuple[int, int, float, float]]]]:
    """Per text lambda S of the best segment, of the significant ones together, log of the words; and the latter."""
    buf, starts, lens, counts = letter_words(texts)
    hashes = word_hashes(buf, starts, lens, SEED) if len(starts) else np.zeros(0, np.uint64)
    out, found = np.zeros((len(texts), 3)), [[] for _ in texts]
    out[:, 2] = np.log1p(counts)
    if not len(model.hashes):
        return out, found
    near = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
    at = np.flatnonzero(model.hashes[near] == hashes)
    heads = np.cumsum(counts) - counts
    text = np.searchsorted(np.cumsum(counts), at, side="right")
    edges = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
    for i in np.unique(text).tolist():
        own = at[edges[i] : edges[i + 1]]
        rows = []
        best = 0.0
        for first, end, score in segments(own - heads[i], model.scores[near[own]], model.drift):
            best = max(best, score)
            expected = float(counts[i]) * math.exp(-model.scale * score)
            if expected <= significant:
                rows.append((first, end - first, score, expected))
        found[i] = rows
        out[i, 0] = model.scale * best
        out[i, 1] = model.scale * sum(r[2] for r in rows)
    return out, found


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic model with an intercept, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    squeezed = np.column_stack([np.ones(len(x)), np.log1p(x[:, :2]), x[:, 2]])
    return 1 / (1 + np.exp(-np.clip(squeezed @ weights, -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the rows that may be learnt from."""
    own = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    small = own.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.select("doc_id", "text").join(F.broadcast(own) if small else own, "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic")


def train(docs: DataFrame, labels: DataFrame, *, drift: float = 0.5, least_z: float = 2.5, least_score: float = 1.5, prior: float = 0.01, significant: float = 0.05) -> Toxicity:
    """A model from all labelled rows that are not held out; a word counts once in a text for its score, each time for lambda."""
    modest_batches(docs.sparkSession)
    rows = labelled(docs, labels)
    size = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = (size.get(1, 0), size.get(0, 0))
    if not all(n):
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0), drift, 1.0, np.array([-30.0, 0, 0, 0]))
    sorted_words = rows.select(F.sort_array(words_of(F.col("text"))).alias("w"), "toxic")
    each = F.transform("w", lambda x, i: F.struct(x.alias("term"), F.coalesce(F.get("w", i - 1) != x, F.lit(True)).cast("int").alias("new")))
    terms = sorted_words.select(F.explode(each).alias("x"), "toxic").select("x.term", "x.new", "toxic")
    # toxic and clean count texts; n counts all occurrences in clean texts.
    words = terms.groupBy("term").agg(F.sum(F.col("new") * F.col("toxic")).alias("toxic"), F.sum(F.col("new") * (1 - F.col("toxic"))).alias("clean"), F.sum(1 - F.col("toxic")).alias("n"))
    words = materialize(words, "toxic-words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    picked = log_odds(words, *n, least_z=least_z, least_score=least_score, prior=prior)
    hashes, scores = hash_of(picked.column("term").to_pylist()), picked.column("score").to_numpy()
    clean = (picked.column("n").to_numpy() + 0.5) / (total + 0.5 * len(scores)) if len(scores) else scores
    order = np.argsort(hashes)
    model = Toxicity(hashes[order], scores[order], drift, decay(scores, clean, drift), np.zeros(4))
    seen = rows.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(CALIBRATION_ROWS)
    sample = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(seen), "h").groupBy("h").agg(F.max(F.struct("toxic", "text")).alias("r")).select("r.text", "r.toxic")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), CHUNK):
                x, _ = features(sent.value, [t or b"" for t in batch.column(0).slice(a, b - a).cast(pa.binary()).to_pylist()], significant)
                yield pa.RecordBatch.from_arrays([*[pa.array(x[:, i]) for i in range(3)], batch.column(1).slice(a, b - a)], ["a", "b", "c", "toxic"])

    got = np.array([[r.a, r.b, r.c, r.toxic] for r in sample.mapInArrow(measure, "a double, b double, c double, toxic int").collect()])
    order = np.lexsort(got.T)
    got = got[order]
    model.weights = logistic(np.column_stack([np.log1p(got[:, :2]), got[:, 2]]), got[:, 3])
    return model


def score(docs: DataFrame, model: Toxicity, *, significant: float = 0.05) -> DataFrame:
    """Rows doc_id, held_out, score, passages: significant segments (first word, words, score, expected by chance)."""
    modest_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("first", pa.int32()), ("n", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), CHUNK):
                x, found = features(sent.value, [t or b"" for t in batch.column(2).slice(a, b - a).cast(pa.binary()).to_pylist()], significant)
                spans = [[dict(zip(("first", "n", "score", "expected"), r, strict=True)) for r in rows] for rows in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(probability(sent.value.weights, x)), pa.array(spans, pa.list_(span))], ["doc_id", "held_out", "score", "passages"])

    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), "text")
    return df.mapInArrow(run, f"doc_id bigint, held_out boolean, score double, passages {_SPAN}")
