import random
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

VOCAB = {x: [f"{p}{q}" for p in s.split() for q in t.split()] for x, (s, t) in {"en": ("th wh in ou ser", "e ing at ould tion ly"), "de": ("sch ver un zei ge", "en ung keit licht ach er")}.items()}


def shingles(text, n=5):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, items, k=35):
    """Stages 2 to 5 over rows (doc_id, text) that the first stage keeps."""
    kept = []
    for d, t in sorted(docs):
        s = shingles(t)
        kept = kept if any(len(s & o) >= 0.8 * len(s | o) for *_, o in kept) else [*kept, (d, t, s)]
    words = {d: t.split() for d, t, _ in kept}
    seen = Counter(tuple(w[i : i + k]) for w in words.values() for i in range(len(w) - k + 1))
    texts = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        texts[d] = " ".join(x for i, x in enumerate(w) if i not in gone)
    plain = lambda t: f" {' '.join(re.findall(r'[a-z0-9]+', t.lower()))} "
    windows = [f" {' '.join(w[i : i + 10])} " for t in items for w in [plain(t).split()] for i in range(max(1, len(w) - 9))]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items() if not any(w in plain(t) for w in windows)}


def test_pipeline_matches_brute_force(spark, tmp_path):
    rng = random.Random(9)
    prose = lambda x, n: " ".join(rng.choices(VOCAB[x], k=n))
    shared, items = prose("en", 60), [prose("en", 25) for _ in range(4)]
    rows = []
    for i in range(60):
        x = rng.choice(["en", "de"])
        parts = [prose(x, 80), *([shared] if i % 7 == 0 else []), *([items[i % 4]] if i % 11 == 3 else []), prose(x, 40)]
        rows.append((i, "\n".join(parts), x))
    for i in range(60, 70):
        words = rows[i - 60][1].split(" ")
        words[5] = "changed"
        rows.append((i, " ".join(words), rows[i - 60][2]))
    noise = [(100, None, "en"), (101, "", "de"), (102, "123 !!! 456", "en")]
    spark.createDataFrame([(i, t, x, "src", len(t or "")) for i, t, x in rows + noise], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == brute([(i, t) for i, t, _ in rows], items)
    assert 40 < len(got) < 60


def test_null_ids_and_repeated_rows(spark, tmp_path):
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choices(VOCAB["en"], k=n))
    texts = [prose(60) for _ in range(6)]
    rows = [(i, t, "en") for i, t in enumerate(texts)] * 2 + [(None, texts[0], "en"), (None, prose(60), "en"), (None, prose(60), None), (None, None, None), (9, None, "en")]
    rows += [(i + 50, prose(60), "de" if i % 2 else "en") for i in range(20)]
    spark.createDataFrame([(i, t, x, None if i == 2 else "src", 0) for i, t, x in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = sorted((r.doc_id for r in out), key=lambda x: -1 if x is None else x)
    assert kept == [None, None, None, 1, 2, 3, 4, 5, *range(50, 70)]
    assert {r.decoded for r in out} == {t for _, t, _ in rows if t}


def test_stages_pass_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, "a b")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes and out.count() == 0
