import random

import numpy as np

from tessella.llm.language import fit, identify, page_evidence, trigrams
from tessella.llm.queries import QUERIES

VOCAB = {"en": "the of and to that with from have this which".split(), "de": "der die und nicht mit werden durch über schön auch".split(), "fr": "le la et dans pour avec être où déjà très".split()}


def text(language, n, seed):
    return " ".join(random.Random(seed).choices(VOCAB[language], k=n))


def corpus(spark, extra=()):
    rows = [(i, text(x, 5 + i % 40, i), x, f"{x}{i % 3}.example.{x}", "junk") for i, x in enumerate(list(VOCAB) * 40)]
    return spark.createDataFrame([*rows, *extra], "doc_id bigint, text string, lang string, source string, language string")


def run(df, languages=("de", "en", "fr"), **more):
    return {r.doc["doc_id"]: r for r in identify(df, languages=languages, **more).collect()}


def test_accuracy_and_rejections(spark):
    extra = [(1000, None, "en", None, None), (1001, "", "en", "a", None), (1002, "12 34 !!", None, "a", None), (1003, "это совсем другой язык " * 9, None, None, None), (1004, text("fr", 30, 1), None, "unseen.example.de", "x")]
    got = run(corpus(spark, extra))
    assert all(got[i].language == list(VOCAB)[i % 3] and got[i].accepted for i in range(120))
    assert all(got[i].language == "und" and not got[i].accepted for i in (1000, 1001, 1002, 1003))
    assert got[1004].language == "fr" and got[1004].accepted


def test_host_and_declaration_decide_short_texts(spark):
    rows = [(1000, "an", None, "de0.example.de", None), (1001, "an", None, "fr0.example.fr", None)]
    got = run(corpus(spark, rows), ("de", "fr"), full=1.0)
    assert (got[1000].language, got[1001].language) == ("de", "fr")
    same = [(1000, "an", None, None, "de"), (1001, "an", None, None, "fr")]
    got = run(corpus(spark, same), ("de", "fr"), host=None, declared="language", full=1.0)
    assert (got[1000].language, got[1001].language) == ("de", "fr")


def test_trigrams_follow_texts():
    texts = [b"abc", b"", b"zz top", b"abc"]
    bucket, heads, letters = trigrams(texts)
    assert list(letters) == [3, 0, 5, 3] and heads[1] == heads[2]
    assert list(bucket[heads[0] : heads[1]]) == list(bucket[heads[3] : heads[4]])


def test_pages_and_empty(spark):
    pages = spark.createDataFrame([(1, "https://a.example.de/x", '<html lang="de"><script>no</script><p>und</p>'), (2, None, None)], "page_id bigint, url string, html string")
    got = {r.page_id: r for r in page_evidence(pages).collect()}
    assert (got[1].host, got[1].declared, got[1].text.split()) == ("a.example.de", "de", ["und"]) and got[2].text == ""
    assert run(corpus(spark).limit(0)) == {}
    assert np.isfinite(fit(corpus(spark).limit(0), ("en",), text="text", label="lang", rows=5)).all()


def test_query_of_pages_uses_declaration_and_suffix(spark, tmp_path):
    page = lambda i, said, url, body: (i, url, f'<html lang="{said}"><p>{body}</p></html>' if said else f"<p>{body}</p>")
    pages = [page(i, "", f"http://h{i}.example.{x}/", text(x, 60, i)) for i, x in enumerate(["de", "fr"] * 40)]
    pages += [page(100, "de", "http://a.example.org/", "zq"), page(101, "fr", "http://a.example.org/", "zq"), page(102, "", "http://new1.example.de/", "zq"), page(103, "", "http://new2.example.fr/", "zq")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.page_id: r.language for r in QUERIES["op5_pages"](spark, str(tmp_path)).collect()}
    assert len(got) == len(pages) and [got[i] for i in (100, 101, 102, 103)] == ["de", "fr", "de", "fr"]
