import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessella.llm.toxicity import decay, fold, hash_of, log_odds, score, segments, train


def brute(values):
    """Maximal segments by their definition: take the best, then the same left and right of it."""
    best = max(((sum(values[a:b]), -(b - a), -a) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=(0,))
    if best[0] <= 1e-12:
        return []
    a, b = -best[2], -best[2] - best[1]
    return [*brute(values[:a]), (a, b, best[0]), *[(x + b, y + b, s) for x, y, s in brute(values[b:])]]


def test_segments_match_the_definition():
    rng = random.Random(8)
    for _ in range(300):
        n = rng.randint(0, 25)
        at = sorted(rng.sample(range(n), rng.randint(0, n // 2))) if n else []
        scores = [rng.choice([1.13, 2.37, 0.71, 3.01]) for _ in at]
        values = [-0.53] * n
        for i, s in zip(at, scores, strict=True):
            values[i] = s
        got = segments(np.array(at, int), np.array(scores, float), 0.53)
        expected = brute(values)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in expected]
        assert np.allclose([s for *_, s in got], [s for *_, s in expected])


def test_segments_of_many_words_in_linear_time():
    for at, scores in ((np.arange(200_000) * 3, np.full(200_000, 1.2)), (np.arange(200_000) * 2, np.linspace(4, 0.6, 200_000)), (np.cumsum(np.random.default_rng(1).integers(1, 9, 200_000)), np.random.default_rng(2).uniform(0.5, 4, 200_000))):
        began = time.process_time()
        assert segments(at, scores, 0.5)
        assert time.process_time() - began < 2


def test_significant_segments_are_rare_by_chance():
    rng = np.random.default_rng(6)
    scores, shares, drift, n = np.array([1.6, 2.4, 3.5]), np.array([0.02, 0.008, 0.002]), 0.5, 500
    scale, hits = decay(scores, shares, drift), 0
    for _ in range(600):
        drawn = rng.choice(4, n, p=[*shares, 1 - shares.sum()])
        at = np.flatnonzero(drawn < 3)
        hits += any(n * np.exp(-scale * s) <= 0.05 for *_, s in segments(at, scores[drawn[at]], drift))
    assert hits <= 0.05 * 600 * 1.5


def tables(spark, extra=()):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        words, toxic = rng.choices(plain, k=rng.randint(5, 120)), int(i % 6 == 0)
        if toxic:
            at = rng.randint(0, len(words))
            words[at:at] = rng.choices(["vile", "awful", "nasty"], k=4)
        docs.append((i, " ".join(words), "en", 0.5))
        labels.append((i, 1, toxic))
    docs = [*docs, *extra]
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score double"), spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_held_out_accuracy_and_passages(spark):
    docs, labels = tables(spark, [(1000, None, None, None), (1001, "", None, None), (None, "so vile and awful nasty vile", None, None), (1002, "w1 " * 5000 + "vile awful nasty vile " + "w2 " * 5000, None, None)])
    got = {r.doc_id: r for r in score(docs, train(docs, labels)).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i in range(400) if got[i].held_out} == set(held)
    assert np.mean([(got[i].score >= 0.5) == (i % 6 == 0) for i in held]) > 0.97
    assert got[1000].score < 0.5 and got[1001].score < 0.5 and got[None].score > 0.5 and got[None].held_out
    assert [(p["first"], p["n"]) for p in got[1002].passages] == [(5000, 4)]


def test_fold(spark):
    rows = spark.range(50).select("id", fold(F.col("id")).alias("f")).collect()
    assert all(r.f == zlib.crc32(str(r.id).encode()) % 5 for r in rows)


def test_no_labels_and_empty(spark):
    docs, labels = tables(spark)
    assert all(r.score < 1e-6 for r in score(docs, train(docs, labels.limit(0))).collect())
    assert score(docs.limit(0), train(docs.limit(0), labels)).collect() == []


def test_lambda_by_occurrences_in_clean_texts(spark):
    docs, labels = tables(spark)
    docs = docs.unionByName(spark.createDataFrame([(i, "vile w1 w2 vile w3", "en", 0.5) for i in range(5000, 5020)], docs.schema))
    labels = labels.unionByName(spark.createDataFrame([(i, 1, 0) for i in range(5000, 5020)], labels.schema))
    model = train(docs, labels)
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None}
    words = [w for r in docs.collect() if not toxic.get(r.doc_id, 1) and zlib.crc32(str(r.doc_id).encode()) % 5 for w in r.text.split()]
    counts = {int(h): words.count(w) for w in set(words) | {"vile", "awful", "nasty"} for h in hash_of([w])}
    k = len(model.hashes)
    shares = np.array([(counts.get(int(h), 0) + 0.5) / (len(words) + 0.5 * k) for h in model.hashes])
    assert k and abs(model.scale - decay(model.scores, shares, model.drift)) < 1e-9


def test_all_words_with_evidence_stay(spark):
    words = spark.range(20_050).select(F.concat(F.lit("w"), "id").alias("term"), F.lit(50).alias("toxic"), F.lit(0).alias("clean"), F.lit(0).alias("n"))
    assert log_odds(words, 1000, 1000, least_z=2.5, least_score=1.5, prior=0.01).num_rows == 20_050
