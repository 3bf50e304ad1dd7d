"""Quality rules by distribution divergence, as DataFrame expressions only.

Each text becomes two histograms: characters by class, and occurrences of common function words. Both are
compared with a reference per language, summed over all documents of that language, by Jensen-Shannon distance.
Texts too short for a histogram to mean anything are not judged by it (minimum-length guards).

Defined cases: a null or empty text has no words, counts of 0 and fails the base rule; repeated rows are judged
one by one; other columns of the input are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Function words of the reference languages: fixed values.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
}
#: Classes in the order in which they are taken out of the text; what is left counts as other.
CLASSES = [("lower", r"[\p{Ll}\p{Lo}\p{M}]+"), ("space", r"\s+"), ("upper", r"[\p{Lu}\p{Lt}]+"), ("digit", r"\p{N}+"), ("sentence", r"[.,;:!?'\"()\-]+"), ("symbol", SYMBOLS + "+")]

#: How many quartile ranges above the third quartile a distance may lie. Character classes vary so little between texts
#: that theirs reaches further.
CHARS_REACH, COMMON_REACH = 40.0, 1.5


def words_of(text: Column) -> Column:
    """The text's words: runs of anything but ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def window_hashes(words: Column, k: int) -> Column:
    """A 64-bit hash of every k-word window, in order."""
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(1), F.size(words) - (k - 1)), lambda i: F.xxhash64(F.slice(words, i, k)))).otherwise(F.array().cast("array<bigint>"))


def with_repeated_cover(df: DataFrame, hashes: str, k: int, to: str) -> DataFrame:
    """Add as column `to` the number of words inside windows that stand twice or more in the row's own array of hashes.

    Each step is a column of its own: within a lambda an inlined step would run again for each element.
    """
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = df.withColumn("_at", F.when(repeated, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("_n", F.size("_at"))
    same = lambda j, other: F.when((other >= 0) & (other < F.col("_n")), F.get("_at", other)["h"] == F.get("_at", j)["h"]).otherwise(False)
    df = df.withColumn("_twice", F.filter("_at", lambda x, j: same(j, j - 1) | same(j, j + 1)))
    df = df.withColumn("_starts", F.array_sort(F.transform("_twice", lambda x: x["i"])))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    merged = F.aggregate("_starts", zero, lambda acc, i: F.struct((i + k).alias("end"), (acc["n"] + i + k - F.greatest(acc["end"], i)).alias("n")))
    return df.withColumn(to, F.coalesce(merged["n"], F.lit(0))).drop("_at", "_n", "_twice", "_starts")


def quality_counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of each text: the base rules' and both histograms (chars, common)."""
    listed = sorted({w for ws in COMMON.values() for w in ws})
    k = 8
    df = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("t")).withColumn("w", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("h", window_hashes(F.col("w"), k)).withColumn("ls", lines).withColumn("common_words", F.filter("w", lambda x: F.lower(x).isin(listed)))
    left, chars = "t", []
    for name, pattern in CLASSES:
        df = df.withColumn(f"without_{name}", F.regexp_replace(left, pattern, ""))
        chars.append(F.length(left) - F.length(f"without_{name}"))
        left = f"without_{name}"
    chars.append(F.length(left))
    df = with_repeated_cover(df.withColumn("low", F.transform("common_words", F.lower)), "h", k, "repeated")
    return df.select(
        "doc_id",
        "lang",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        chars[[n for n, _ in CLASSES].index("symbol")].cast("long").alias("n_symbols"),
        (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.col("repeated").cast("long").alias("n_repeat_words"),
        F.array(*[c.cast("long") for c in chars]).alias("chars"),
        F.array(*[(F.size("low") - F.size(F.array_remove("low", w))).cast("long") for w in listed], (F.size("w") - F.size("low")).cast("long")).alias("common"),
    )


def jensen_shannon(counts: Column, total: Column, reference: list[float]) -> Column:
    """Square root of the divergence in bits, 0 to 1, between counts (of a sum above 0) and a distribution."""
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def one(x: Column, q: Column) -> Column:
        p = x / total
        m = (p + q) / 2
        return (part(p, m) + part(q, m)) / 2

    both = F.zip_with(counts, F.array(*map(F.lit, reference)), one)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x)))


def language_references(counts: DataFrame, languages: tuple[str, ...]) -> dict[str, tuple[list[float], list[float]]]:
    """Per language the summed histograms of all its documents as distributions: a row per listed language."""
    n_chars, n_common = len(CLASSES) + 1, len({w for ws in COMMON.values() for w in ws}) + 1
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(n_chars)] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(n_common)]
    out = {}
    for r in counts.where(F.col("lang").isin(*languages)).groupBy("lang").agg(*sums).collect():
        chars, common = [r[f"c{i}"] for i in range(n_chars)], [r[f"w{i}"] for i in range(n_common)]
        if sum(chars) and sum(common):
            out[r["lang"]] = ([x / sum(chars) for x in chars], [x / sum(common) for x in common])
    return out


def upper_fence(judged: DataFrame, column: str, reach: float) -> float:
    """The third quartile of a distance plus `reach` times what lies between the quartiles; 1 if nothing has one.

    Quartiles come from counts of ten-thousandths, so that they do not depend on the order of tasks.
    """
    bins = judged.where(F.col(column).isNotNull()).groupBy(F.ceil(F.col(column) * 10_000).cast("int").alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    total, seen, quartile = sum(r["n"] for r in bins), 0, {}
    for r in bins:
        seen += r["n"]
        for q in (1, 3):
            if 4 * seen >= q * total:
                quartile.setdefault(q, r["bin"] / 10_000)
    return quartile[3] + reach * (quartile[3] - quartile[1]) if quartile else 1.0


def quality_rules(docs: DataFrame, *, languages: tuple[str, ...] = ("de", "en", "es", "fr"), min_chars: int = 200, min_words: int = 60, max_chars_distance: float | None = None, max_common_distance: float | None = None) -> DataFrame:
    """Counts, distances to the nearest reference, base_failed and kept of each document.

    A text of fewer than min_chars characters has no chars_distance and one of fewer than min_words words no
    common_distance (null); a missing distance never rejects. References exist for the listed languages only. A largest
    distance that is not given is derived from all documents' distances (see upper_fence).
    """
    counts = materialize(quality_counts(docs), "quality-counts")
    references = language_references(counts, languages)
    nearest = lambda of, total, i: F.least(*[jensen_shannon(F.col(of), F.col(total), r[i]) for r in references.values()], F.lit(1.0)) if references else F.lit(None).cast("double")
    out = counts.withColumn("n_chars", F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x))
    out = out.withColumn("chars_distance", F.when(F.col("n_chars") >= min_chars, nearest("chars", "n_chars", 0)))
    out = out.withColumn("common_distance", F.when(F.col("n_words") >= min_words, nearest("common", "n_words", 1)))
    out = out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    out = materialize(out, "quality-distances")
    if max_chars_distance is None:
        max_chars_distance = upper_fence(out, "chars_distance", CHARS_REACH)
    if max_common_distance is None:
        max_common_distance = upper_fence(out, "common_distance", COMMON_REACH)
    diverges = F.coalesce(F.col("chars_distance") > max_chars_distance, F.lit(False)) | F.coalesce(F.col("common_distance") > max_common_distance, F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~diverges)
