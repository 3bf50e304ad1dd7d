import random
import re

from tessella.llm.decontamination import decontaminate, proximity_matches
from tessella.llm.queries import QUERIES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    windows = []
    for i, t in items:
        w = words(t)
        windows += [(str(i), tuple(w[s : s + k])) for s in range(max(1, len(w) - k + 1)) if w]
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for i, x in windows:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit.update(range(s, s + len(x)))
                    found.add(i)
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id bigint, text string, id int, term string")
    b = spark.createDataFrame([(*x, "q") for x in items], "item_id bigint, text string, w string")
    return sorted(((r.doc["doc_id"], r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(d, b).collect()), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    vocab = ["the", "The", "of", "ÉTÉ", "été", "a1", "rare", "in", "Ünder", "x"]
    prose = lambda n: " ".join(rng.choice(vocab) + rng.choice(["", ",", "-"]) for _ in range(n))
    items = [(i, prose(rng.randint(1, 25))) for i in range(12)] + [(50, ""), (51, None), (52, "alone"), (53, "the the the the the the the the the the the"), (0, "unseen words here")]
    docs = []
    for i in range(60):
        t = prose(rng.randint(0, 40))
        if rng.random() < 0.6:
            t += " " + rng.choice(items)[1].__str__() + " " + prose(rng.randint(0, 20))
        docs.append((i, t))
    docs += [(5, docs[5][1]), (5, "Alone"), (None, items[3][1]), (None, None), (70, ""), (71, "the " * 300)]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [(1, 2, 0, [])]


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x y beta"), (2, "beta " + "x " * 30 + "alpha"), (3, "beta alpha")], "doc_id bigint, text string")
    b = spark.createDataFrame([(9, "alpha beta")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.first, r.last) for r in proximity_matches(d, b, within=5).collect()) == [(1, 0, 3), (3, 0, 1)]


def test_proximity_of_reworded_passages(spark, tmp_path):
    item = "one two three four five six seven eight nine ten"
    texts = [(1, "so one two three four five sixth seven eight nine ten so"), (2, "ten two nine one three eight seven four five"), (3, "one two " + "x " * 40 + "three four"), (4, "lonely"), (None, "one two and ten")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    item = item.replace("six", "zzz")
    spark.createDataFrame([(9, item), (8, "lonely")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r["items"], r.found) for r in QUERIES["op7_proximity"](spark, str(tmp_path)).collect()}
    assert got == {(1, "9", 9), (2, "9", 9), (4, "8", 1)}
