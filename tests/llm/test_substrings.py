import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import substrings
from tessella.llm.substrings import remove_repeated

SCHEMA = "doc_id bigint, text string, id string, bucket string"


def brute(texts, k):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def run(spark, rows, k=35):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    return sorted(((r.doc["doc_id"], r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in remove_repeated(df, window=k, keep=("doc_id", "id")).collect()), key=str)


def expected(rows, k=35):
    return sorted(((i, *x) for (i, _), x in zip(rows, brute([t for _, t in rows], k), strict=True)), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    vocab = ["a", "é", "the", "ofofofofofof", "x" * 70, "ß", "in", "zz"]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [prose(n) for n in (35, 36, 60, 200)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(shared), prose(rng.randint(0, 50))]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(parts)))
    rows += [(3, rows[3][1]), (100, None), (101, ""), (102, " \n "), (None, shared[2]), (None, None), (103, "w " * 500), (104, "only once " * 17 + "end"), (105, " ".join(["nbsp"] * 40))]
    assert run(spark, rows) == expected(rows)
    assert run(spark, rows, k=6) == expected(rows, 6)


def test_null_ids_of_equal_32_bit_hashes_stay_apart(spark):
    one, two = (" ".join(f"k{j}x{i}" for j in range(6)) for i in (171520, 344593))
    rows = [(None, one), (None, two), (1, f"more {one}")]
    assert run(spark, rows, k=6) == expected(rows, 6)


@pytest.mark.parametrize("places", [18, 2])
def test_chunks_of_a_task_share_what_was_sent(places, monkeypatch):
    monkeypatch.setattr(substrings, "PLACES", places)
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choices([f"w{i}" for i in range(40)], k=n))
    shared, k, buckets = [prose(n) for n in (12, 20, 50)], 8, 5
    texts = [" ".join([prose(rng.randint(0, 30)), rng.choice(shared), prose(rng.randint(0, 30)), rng.choice([*shared, ""])]) for _ in range(120)]
    found, parts, n_sent = defaultdict(set), defaultdict(list), 0
    for task in range(2):
        sent = substrings.Sent()
        for a in range(60 * task, 60 * (task + 1), 6):
            ids = np.arange(a, a + 6)
            for bucket, kind, packed in substrings._super_kmers(ids, ids, [t.encode() for t in texts[a : a + 6]], k, buckets, sent):
                if kind:
                    for i, _, first, n, *_ in zip(*substrings._unpack(packed)[:4], strict=True):
                        found[int(i)] |= set(range(first, first + n + k - 1))
                else:
                    parts[bucket].append(packed)
                    n_sent += len(substrings._unpack(packed)[0])
    for packed in parts.values():
        for ids, _, first, n in substrings._count(packed, k):
            for i, f, m in zip(ids.tolist(), first.tolist(), n.tolist(), strict=True):
                found[i] |= set(range(f, f + m + k - 1))
    assert [len(found[i]) for i in range(120)] == [n for _, n, _ in brute(texts, k)]
    assert places == 2 or n_sent < 2400


def test_empty_table(spark):
    assert run(spark, []) == []
