import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import jaccard
from tessella.llm.jaccard import keep_one, links_of, needed_prefix, prefix_length, similar_documents, subtree_links


def sets_of(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(rows, threshold=0.8):
    """Similar rows of each row, and the classes that they connect, as lists of row numbers."""
    sets = [sets_of(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9] for i, a in enumerate(sets)]
    out, done = [], set()
    for i in range(len(rows)):
        if i not in done:
            queue, seen = [i], {i}
            while queue:
                new = [y for y in near[queue.pop()] if y not in seen]
                seen.update(new)
                queue += new
            done |= seen
            out.append(sorted(seen))
    return near, out


def brute(rows):
    near, found = classes(rows)
    least = {i: min((rows[x][0] for x in c), key=lambda d: -(2**63) if d is None else d) for c in found for i in c}
    return sorted(((rows[i][0], least[i], len(near[i])) for i in range(len(rows))), key=str)


def rows_of(seed, n=40):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(50)]
    rows = []
    for family in range(n):
        base = rng.choices(vocab, k=rng.randint(3, 90))
        for _ in range(rng.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows) + 10, " ".join(words)))
    rows += [(500, ""), (501, None), (502, "one two"), (503, " one\ttwo "), (11, rows[1][1]), (12, "other"), (None, rows[3][1]), (None, None)]
    return rows


def parts(n, pairs):
    """The sets of rows that pairs connect."""
    root = list(range(n))
    for i, j in pairs:
        root = [root[i] if r == root[j] else r for r in root]
    return {tuple(k for k in range(n) if root[k] == r) for r in root}


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "n", 2) for r in rows], "doc_id bigint, text string, id int, node string, weight int")
    null = lambda x: None if x == jaccard.NO_ID else x
    return df, sorted(((null(r["id"]), null(r.label["id"]), r.n_links) for r in similar_documents(df).collect()), key=str)


@pytest.mark.parametrize("block", [jaccard.BLOCK, 150])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = rows_of(1)
    df, got = run(spark, rows)
    assert got == brute(rows)


def test_one_of_each_class_stays(spark):
    rows = [*rows_of(2, 15), *rows_of(2, 15)[:3]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, row string")
    kept = [r.text for r in keep_one(df).collect()]
    found = [[rows[i][1] for i in c] for c in classes(rows)[1]]
    assert len(kept) == len(found) and all(sum(t in c for t in kept) >= 1 for c in found)


def test_equal_rows_but_for_other_columns_keep_the_same_one(spark):
    rows = [(1, "a b c d e f g", str(i)) for i in range(20)] + [(None, None, "x"), (None, None, "y")]
    kept = {tuple(keep_one(spark.createDataFrame(rows[::step], "doc_id bigint, text string, note string").repartition(n)).collect()) for step in (1, -1) for n in (1, 5)}
    assert len({frozenset(k) for k in kept}) == 1 and all(len(k) == 3 for k in kept)


def test_null_ids_of_equal_32_bit_hashes_stay_apart(spark):
    one, two = (" ".join(f"k{j}x{i}" for j in range(6)) for i in (171520, 344593))
    df = spark.createDataFrame([(None, one), (None, two), (7, two)], "doc_id bigint, text string")
    assert df.select(F.hash("text")).distinct().count() == 1
    assert {r.text for r in keep_one(df.limit(2)).collect()} == {one, two}
    assert sorted(r.n_links for r in similar_documents(df).collect()) == [0, 1, 1]


def test_common_shingles_counted_by_absence():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, rng.integers(0, 60, 4)), rng.integers(0, 9, 3).astype(np.uint64)])) for _ in range(80)]
    total, label = links_of(sets, np.ones(80, int), None, 0.8)
    near = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    assert total.tolist() == [sum(near(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    assert all(label[i] == label[j] for i, a in enumerate(sets) for j, b in enumerate(sets) if near(a, b))


def test_subtrees_link_what_similar_pairs_of_each_prefix_connect():
    rng = np.random.default_rng(3)
    n, shortest, width = 120, 5, jaccard.TREES * jaccard.DEPTH
    bases = rng.integers(0, 256, (6, width)).astype(np.uint8)
    minima = np.where(rng.random((n, width)) < 0.12, rng.integers(0, 256, (n, width)), bases[rng.integers(0, 6, n)]).astype(np.uint8)
    labels = rng.integers(0, 2, (n, jaccard.DEPTH)).astype(np.uint8)
    labels[:, :shortest] = 0
    task = np.sort(rng.integers(0, 4, n))
    order = np.lexsort((*labels.T[::-1], task))
    labels, minima = labels[order], minima[order]
    a, b, prefix, _ = subtree_links(task, labels, minima, shortest, 0.65)
    for least in range(shortest, jaccard.DEPTH + 1):
        same = lambda i, j: task[i] == task[j] and (labels[i, :least] == labels[j, :least]).all()
        pairs = [(i, j) for i in range(n) for j in range(i) if same(i, j) and (minima[i] == minima[j]).mean() >= 0.65]
        assert pairs and parts(n, pairs) == parts(n, zip(a[prefix >= least].tolist(), b[prefix >= least].tolist(), strict=True))


def test_prefix_is_shortened_until_the_recall_is_met(spark):
    links = lambda *alike: spark.createDataFrame([(x,) for x in alike], "alike int")
    assert needed_prefix(links(97, 99, 98), 5, 0.8, 0.9999) == 8
    assert needed_prefix(links(80, 81, 80), 5, 0.8, 0.9999) == 5
    assert needed_prefix(links(*[99] * 50, 86), 5, 0.8, 0.9999) in (7, 8)
    assert needed_prefix(links(), 5, 0.8, 0.9999) == 5


def test_subtrees_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SUBTREE", 2)
    rows = rows_of(5, 15)
    df, got = run(spark, rows)
    assert got == brute(rows)


def test_prefix_and_empty(spark):
    assert prefix_length(0.8, 0.9999) == 5 and prefix_length(0.95, 0.9999) == 8
    assert run(spark, [])[1] == []
