"""Benchmark decontamination over a positional inverted index, with DataFrame operations only.

Every benchmark item falls into windows of consecutive words (one window if it is shorter). The training corpus is
indexed by term: postings (term, document, position) of the terms that the windows need, stored in the shared folder.
A window's lists are intersected from its rarest terms: positions less the term's offset must agree on a start in
the same document. Starts that survive are checked word by word against the text, so matches are exact phrases.

Defined cases: a null text has no words; an item without words has no window; items of equal id count once; a null
item_id reads "null"; documents that repeat, even with the same doc_id, are each reported; a null doc_id is an id
like any other; an empty documents table gives no rows and an empty benchmark table no hits. Only doc_id and text,
item_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.session import materialize

#: What stands between words; A-Z is not in it, since it becomes a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NO_ID = -(2**63)
#: Rows of the benchmark's side that are broadcast at most; a larger side is joined by a shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words of letters, digits and all beyond ASCII, with A-Z in lower case."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_remove(F.split(low, BETWEEN), "")


def bounded(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its counted rows stay under the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """wid, n, words, items of each distinct window; items are the sorted ids that have it."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1)))
    each = words.select("item", "w", F.explode(starts).alias("s")).select("item", F.slice("w", F.col("s"), size).alias("words"))
    grouped = each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grouped.select(F.sha2(F.array_join("words", " "), 256).alias("wid"), F.size("words").alias("n"), "words", "items")


def keyed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Documents with a join key: the id and a hash of the text, which tells rows of one id apart."""
    return docs.select(F.struct(*keep).alias("doc"), "text", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.hash("text").alias("tag"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """How often each listed term stands in all texts; terms that never do are missing."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    return tokens.join(bounded(terms), "term").groupBy("term").agg(F.count("*").alias("n_corpus"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index over the listed terms: term, id, tag, pos (words from 0), stored."""
    tokens = docs.select("id", "tag", F.posexplode(words_of(F.col("text"))).alias("pos", "term"))
    return materialize(tokens.join(bounded(terms), "term").select("term", "id", "tag", "pos"), "postings")


def rarest_terms(docs: DataFrame, windows: DataFrame, keep: int) -> DataFrame:
    """wid, term, off, rank of each window's rarest places, the rarest first; a window with an unseen term has none."""
    places = windows.select("wid", "n", F.posexplode("words").alias("off", "term"))
    known = places.join(term_counts(docs, places.select("term").distinct()), "term")
    by = Window.partitionBy("wid")
    ranked = known.withColumn("rank", F.row_number().over(by.orderBy("n_corpus", "off"))).withColumn("seen", F.count("*").over(by))
    return ranked.where((F.col("seen") == F.col("n")) & (F.col("rank") <= keep)).select("wid", "term", "off", "rank")


def phrase_starts(index: DataFrame, rare: DataFrame) -> DataFrame:
    """wid, id, tag, start where the lists of the window's two rarest places agree (of its only one, if it is one word)."""
    at = lambda rank: index.join(bounded(rare.where(F.col("rank") == rank).select("wid", "term", "off")), "term").select("wid", "id", "tag", (F.col("pos") - F.col("off")).alias("start")).where(F.col("start") >= 0)
    single = rare.groupBy("wid").agg(F.max("rank").alias("most")).where(F.col("most") == 1).select("wid")
    first = at(1)
    return first.join(at(2), ["wid", "id", "tag", "start"]).unionByName(first.join(bounded(single), "wid", "left_semi").select("wid", "id", "tag", "start"))


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows doc (a struct of the columns in keep), text, n_words, hits, n_hit, items: each document with its exact matches.

    hits: sorted structs (start, n, items), one a place; n_hit counts the words inside any; items are the sorted
    distinct ids of items with a window there.
    """
    docs = keyed(docs, keep)
    windows = materialize(benchmark_windows(items, window), "windows")
    rare = materialize(rarest_terms(docs, windows, 2), "rare-terms")
    index = postings(docs, rare.select("term").distinct())
    starts = phrase_starts(index, rare).join(bounded(windows), "wid")
    per_doc = starts.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n", "words", "items")).alias("may")).withColumnsRenamed({"id": "found_id", "tag": "found_tag"})
    df = docs.join(per_doc, (F.col("id") == F.col("found_id")) & (F.col("tag") == F.col("found_tag")), "left").select("doc", "text", "may", words_of(F.col("text")).alias("w"))
    exact = F.filter(F.coalesce("may", F.array().cast(df.schema["may"].dataType)), lambda c: F.slice(F.col("w"), c["start"] + 1, c["n"]) == c["words"])
    df = df.withColumn("hits", F.when(F.col("may").isNotNull(), F.array_sort(F.transform(exact, lambda c: F.struct(c["start"].alias("start"), c["n"].alias("n"), c["items"].alias("items"))))))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    cover = F.aggregate("hits", zero, lambda a, h: F.struct(F.greatest(a["end"], h["start"] + h["n"]).alias("end"), (a["n"] + F.greatest(F.lit(0), h["start"] + h["n"] - F.greatest(a["end"], h["start"]))).alias("n")))
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    return df.select("doc", "text", F.size("w").cast("long").alias("n_words"), "hits", F.coalesce(cover["n"], F.lit(0)).cast("long").alias("n_hit"), F.coalesce(found, F.array().cast("array<string>")).alias("items"))


def rarest_known(docs: DataFrame, windows: DataFrame, keep: int) -> DataFrame:
    """wid, term of the rarest distinct terms of each window that the corpus has, even if it lacks others."""
    terms = windows.select("wid", F.explode(F.array_distinct("words")).alias("term"))
    known = terms.join(term_counts(docs, terms.select("term").distinct()), "term")
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy("wid").orderBy("n_corpus", "term")))
    return ranked.where(F.col("rank") <= keep).select("wid", "term")


def proximity_matches(docs: DataFrame, items: DataFrame, *, within: int = 8, window: int = 10, anchors: int = 4, share: float = 0.7) -> DataFrame:
    """Rows doc_id, wid, items, first, last, found: places near which most of a window's distinct words stand.

    Order and distance are free. Two of the window's rarest known words (its `anchors`), next to each other among
    these and at most `within` words apart, make a place first to last; a window of one distinct word has each of its
    occurrences. found is the number of the window's distinct words in the text from a window's length before first to
    as far behind last: `share` of them, rounded up, and two at least if the window has two.
    """
    docs = keyed(docs)
    windows = materialize(benchmark_windows(items, window).withColumn("different", F.size(F.array_distinct("words"))), "windows")
    rare = materialize(rarest_known(docs, windows, anchors), "rare-terms")
    index = postings(docs, rare.select("term").distinct())
    placed = index.join(bounded(rare), "term").join(bounded(windows.select("wid", "different")), "wid")
    by = Window.partitionBy("wid", "id", "tag").orderBy("pos")
    # Rows that repeat have each place as often.
    paired = placed.select("wid", "id", "tag", "term", "pos", "different").distinct().withColumns({"before": F.lag("pos").over(by), "other": F.lag("term").over(by)})
    single = F.col("different") == 1
    near = paired.where(single | (F.col("other") != F.col("term")) & (F.col("pos") - F.col("before") <= within))
    spans = near.select("wid", "id", "tag", F.when(single, F.col("pos")).otherwise(F.col("before")).alias("first"), F.col("pos").alias("last"))
    full = spans.join(bounded(windows.select("wid", "n", "words", "items", "different")), "wid")
    texts = docs.dropDuplicates(["id", "tag"]).select("id", "tag", "text")
    per_doc = full.groupBy("id", "tag").agg(F.collect_list(F.struct("wid", "items", "first", "last", "n", "words", "different")).alias("may"))
    split = per_doc.join(texts, ["id", "tag"]).select("id", "may", words_of(F.col("text")).alias("w"))
    each = split.select("id", "w", F.explode("may").alias("c")).select("id", "c.*", F.slice("w", F.greatest(F.lit(1), F.col("c.first") - F.col("c.n") + 1), F.col("c.last") - F.col("c.first") + 2 * F.col("c.n") + 1).alias("around"))
    found = each.withColumn("found", F.size(F.array_intersect("words", "around")))
    enough = F.least(F.col("different"), F.greatest(F.lit(2), F.ceil(F.lit(share) * F.col("different"))))
    return found.where(F.col("found") >= enough).select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "wid", "items", "first", "last", "found").distinct()
