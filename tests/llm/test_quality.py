import random
import re
from collections import Counter
from math import log2, sqrt

import pytest

from tessella.llm.quality import CLASSES, COMMON, quality_rules, upper_fence

SCHEMA = "doc_id bigint, text string, lang string, chars int, w string"


def counts(text, k=8):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    cover = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def rows():
    rng = random.Random(6)
    words = {x: [*COMMON[x], *[f"{x}w{i}" for i in range(30)]] for x in COMMON}
    out = []
    for i in range(80):
        x = list(COMMON)[i % 4]
        out.append((i, "\n".join(" ".join(rng.choices(words[x], k=rng.randint(1, 30))) for _ in range(rng.randint(1, 12))), x))
    out += [(100, None, "en"), (101, "", None), (102, " \n\t", "en"), (103, "a b c d e f g h " * 9, "en"), (104, "### $$$ @@@ ~~~ ^^^ " * 60, "en"), (105, "x", "zz"), (106, "same line\n" * 5, None), (107, "w " * 20000, "en"), (3, out[3][1], "es"), (None, "é ß nbsp \U0001f642", "fr")]
    return out


def run(spark, data):
    return quality_rules(spark.createDataFrame([(*r, 1, "x") for r in data], SCHEMA)).collect()


def test_base_rules_match_brute_force(spark):
    data = rows()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in run(spark, data)), key=str)
    expected = [(d, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]) for d, c in ((d, counts(t)) for d, t, _ in data)]
    assert got == sorted(expected, key=str)


def test_verdict_follows_divergence(spark):
    data = rows()
    got = {r.doc_id: r for r in run(spark, data)}
    assert not got[104].kept and got[104].chars_distance > 0.33
    assert all(got[i].kept != got[i].base_failed for i in range(80))
    assert got[105].chars_distance is None and got[105].common_distance is None
    own = got[0]
    sums = {}
    for r in got.values():
        if r.lang in COMMON:
            sums[r.lang] = [a + b for a, b in zip(sums.get(r.lang, [0] * (len(CLASSES) + 1)), r.chars, strict=True)]
    sums["es"] = [a + b for a, b in zip(sums["es"], got[3].chars, strict=True)]

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        part = lambda a, b: a * log2(a / ((a + b) / 2)) if a else 0
        return sqrt(max(0, sum(part(a, b) + part(b, a) for a, b in zip(p, q, strict=True)) / 2))

    if own.chars_distance is not None:
        assert own.chars_distance == pytest.approx(min(distance(own.chars, q) for q in sums.values()), abs=1e-9)


def test_thresholds_follow_the_distances(spark):
    rng = random.Random(9)
    prose = lambda i: " ".join(rng.choices([*COMMON["en"], *[f"w{j}" for j in range(25)]], k=200))
    bare = " | ".join(f"piece{j} part{j}" for j in range(60))
    got = {r.doc_id: r for r in run(spark, [*[(i, prose(i), "en") for i in range(60)], (100, bare, "en")])}
    mild = got[100].common_distance
    assert not got[100].base_failed and 0.1 < mild < 0.5 and not got[100].kept and sum(got[i].kept for i in range(60)) >= 57
    df = spark.createDataFrame([(x / 100,) for x in [*range(10, 21), 45]] + [(None,)], "d double")
    assert upper_fence(df, "d", 1.5) == pytest.approx(0.18 + 1.5 * (0.18 - 0.12)) and upper_fence(df.limit(0), "d", 1.5) == 1.0


def test_empty_table(spark):
    assert run(spark, []) == []
