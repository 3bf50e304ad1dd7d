import random
import re

from tessella.llm.license_texts import TEXTS
from tessella.llm.licenses import BASE, GRAM, NOTICES, scan_licenses
from tessella.llm.queries import license_digest


def brute(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for p, label in BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


def test_base_phrases_match_brute_force(spark):
    rng = random.Random(2)
    vocab = ["MIT", "License", "cc", "BY", "apache", "GNU", "general", "public", "the", "été"]
    rows = [(i, " ".join(rng.choice(vocab) + rng.choice(["", ",", "-", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    rows += [(4, rows[4][1]), (None, "MIT license"), (90, None), (91, ""), (92, "mit"), (93, "CC-BY " * 400)]
    df = spark.createDataFrame([(*r, 0.0, "t") for r in rows], "doc_id bigint, text string, score double, template string")
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_digest(scan_licenses(df)).collect()), key=str)
    assert got == sorted(((i, *brute(t)) for i, t in rows), key=str)


def test_notices(spark):
    notice = NOTICES[1][0].split()
    edited = " ".join(notice[:6] + ["strange"] + notice[6:12] + notice[13:])
    rows = [(1, "Foo. " + NOTICES[0][0].upper()), (2, edited), (3, " ".join(sorted(notice))), (4, "plain words of the text")]
    got = {r.doc_id: (r.labels, r.score) for r in license_digest(scan_licenses(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert got[1] == ("mit-text", 1.0) and got[2][0] == "bsd-text" and 0.6 < got[2][1] < 1 and got[3] == ("", 0.0) and got[4] == ("", 0.0)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_spans(text, templates, share=0.6, gap=3):
    """Spans of whole templates by trying every pair of places."""
    w, out = words_of(text), []
    for t, label in templates:
        v = words_of(t)
        votes = sorted((i - j, j) for i in range(len(w) - GRAM + 1) for j in range(len(v) - GRAM + 1) if w[i : i + GRAM] == v[j : j + GRAM])
        runs = []
        for d, j in votes:
            if not runs or d - runs[-1][-1][0] > gap:
                runs.append([])
            runs[-1].append((d, j))
        for run in runs:
            covered = len({j for _, j in run}) / (len(v) - GRAM + 1)
            first, end = min(d + j for d, j in run), max(d + j for d, j in run) + GRAM
            if covered >= share and end - first <= 2 * len(v):
                out.append((label, first, end - first, round(covered, 9)))
    return sorted(out)


def test_labels_match_brute_force(spark):
    rng = random.Random(4)
    templates = [*NOTICES, *TEXTS]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 3)):
            words = words_of(rng.choice(templates)[0])
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                at = rng.randrange(len(words))
                words[at : at + rng.randint(0, 2)] = rng.choices(["odd", "words", "software"], k=rng.randint(0, 2))
            parts += [*rng.choices(["filler", "text", "the", "software"], k=rng.randint(0, 30)), *words]
        rows.append((i, " ".join(x.upper() if rng.random() < 0.2 else x for x in parts)))
    rows += [(100, " ".join([TEXTS[0][0]] * 40)), (101, None), (102, ""), (None, NOTICES[0][0]), (None, NOTICES[1][0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, sorted((s.label, s.first, s.n, round(s.share, 9)) for s in r.spans if not s.base)) for r in scan_licenses(df).collect()), key=str)
    assert got == sorted(((i, brute_spans(t, templates)) for i, t in rows), key=str)
    assert sum(len(x) for _, x in got) > 80


def test_own_templates(spark):
    own = [("one two three four five six seven eight", "mine"), ("too short", "never")]
    df = spark.createDataFrame([(1, "x one two three four five six seven eight y, cc by"), (2, "too short")], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in license_digest(scan_licenses(df, templates=own)).collect()}
    assert got == {1: "cc-by,mine", 2: ""}


def test_empty_table(spark):
    assert license_digest(scan_licenses(spark.createDataFrame([], "doc_id bigint, text string"))).collect() == []
