"""Substring dedup by super-k-mer partitioning.

Consecutive windows of k words that share their minimiser (the least hash of m words inside the window) travel as
one packed string to the minimiser's bucket, so equal windows always meet. A bucket sorts its windows and counts
them; windows found twice or more go back to their documents, whose covered words are removed.

Super-k-mers that a task meets twice are known to repeat at once: their places are settled there, and one copy
without places goes on, so a passage in a third of all rows reaches its bucket once or twice a task. A task remembers
what it has sent in a table of fixed size; what the table has lost is sent again. Windows are
told apart by 128 bits of two independent hashes.

Defined cases: a null or empty text has no words, nothing is removed and the kept text is empty; a text shorter
than the window is kept whole; rows that repeat, even with the same doc_id, are occurrences of each other; a null
doc_id is an id like any other; an empty table gives an empty result. Only doc_id and text are read, and the
columns asked for are passed on inside a struct, so that no name can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.textbits import K4, Rolling, binaries, mix, modest_batches, ragged, slices, sliding_min, tidy, word_hashes

NO_ID = -(2**63)
#: Words of a minimiser.
MINIMISER = 4
#: Bytes of text that a task works on at once, and of packed strings that a bucket should get.
CHUNK, BUCKET = 4_500_000, 4_500_000
#: Bits of the places in which a task remembers super-k-mers.
PLACES = 18


def _table(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the words of texts joined by newlines, with single spaces between words."""
    raw = np.frombuffer(buf, np.uint8)
    cut = np.flatnonzero((raw == 32) | (raw == 10))
    starts = np.concatenate([np.zeros(1, np.int64), cut + 1])
    return starts, np.append(cut, len(buf)) - starts


def _windows(counts: np.ndarray, k: int) -> np.ndarray:
    """Places of all k-word windows that stay inside a text, given each text's number of words."""
    first = np.cumsum(counts) - counts
    return ragged(first, np.maximum(counts - k + 1, 0))


def _twice(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal (a, b) together, and a group number of each place in that order."""
    order = np.argsort(a, kind="stable")
    same = a[order][1:] == a[order][:-1]
    if np.any(same & (b[order][1:] != b[order][:-1])):
        order = np.lexsort((b, a))
        same = a[order][1:] == a[order][:-1]
    same &= b[order][1:] == b[order][:-1]
    return order, np.concatenate([np.zeros(min(1, len(a)), np.int64), np.cumsum(~same)])


def _pack(ids: np.ndarray, tags: np.ndarray, starts: np.ndarray, n: np.ndarray, text: bytes) -> bytes:
    """n is a count of windows in a verdict, and 0 in a super-k-mer without places."""
    head = b"".join((np.int64(len(ids)).tobytes(), ids.astype("<i8").tobytes(), tags.astype("<i8").tobytes(), starts.astype("<i4").tobytes(), n.astype("<i4").tobytes()))
    return zstandard.ZstdCompressor(level=3).compress(head + text)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, out, at = int(np.frombuffer(raw, "<i8", 1)[0]), [], 8
    for kind, width in (("<i8", 8), ("<i8", 8), ("<i4", 4), ("<i4", 4)):
        out.append(np.frombuffer(raw, kind, n, at))
        at += width * n
    return (*out, raw[at:])


class Sent:
    """The super-k-mers that a task has sent, by two hashes: 1 once with its places, 2 also without places."""

    def __init__(self) -> None:
        self.one, self.two = np.zeros(1 << PLACES, np.uint64), np.zeros(1 << PLACES, np.uint64)
        self.state = np.zeros(1 << PLACES, np.int8)

    def meet(self, one: np.ndarray, two: np.ndarray, twice: np.ndarray) -> np.ndarray:
        """How distinct super-k-mers were sent before (0: not), and remember them; twice: which stand twice here."""
        at = (one >> np.uint64(64 - PLACES)).view(np.int64)
        before = np.where((self.one[at] == one) & (self.two[at] == two), self.state[at], 0)
        # Of several in one place the last stays.
        self.one[at], self.two[at], self.state[at] = one, two, np.where(twice | (before > 0), 2, 1)
        return before


def _super_kmers(ids: np.ndarray, tags: np.ndarray, texts: list[bytes], k: int, buckets: int, sent: Sent) -> Iterator[tuple[int, int, bytes]]:
    """Rows (bucket, kind, packed) of one chunk: kind 0 has super-k-mers, kind 1 settled verdicts."""
    words = [t.split() for t in texts]
    long = [i for i, w in enumerate(words) if len(w) >= k]
    if not long:
        return
    buf = b"\n".join([b" ".join(words[i]) for i in long])
    counts = np.array([len(words[i]) for i in long])
    of = np.repeat(np.array(long), counts)
    del words
    starts, lens = _table(buf)
    one, two = (Rolling(word_hashes(buf, starts, lens, seed), seed) for seed in (1, 2))
    least = sliding_min(mix(one.windows(MINIMISER) ^ K4), k - MINIMISER + 1)
    at = _windows(counts, k)
    value = least[at]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1])]))
    first, n = at[new], np.diff(np.append(new, len(at)))
    bucket = (value[new] % np.uint64(buckets)).astype(np.int64)
    end = first + n + k - 1
    all_one, all_two = one.ranges(first, end), two.ranges(first, end)
    order, group = _twice(all_one, all_two)
    copies = np.bincount(group)
    leader = order[np.concatenate([[True], group[1:] != group[:-1]])]
    before = sent.meet(all_one[leader], all_two[leader], copies > 1)
    twice = (copies > 1) | (before > 0)
    settled = order[twice[group]]
    doc, place = of[first], first - (np.cumsum(counts) - counts)[np.searchsorted(np.cumsum(counts), first, side="right")]
    if len(settled):
        yield int(bucket[settled[0]]), 1, _pack(ids[doc[settled]], tags[doc[settled]], place[settled], n[settled], b"")
    go = before < 2
    leader, twice = leader[go], twice[go]
    if not len(leader):
        return
    order = np.argsort(bucket[leader], kind="stable")
    leader, twice = leader[order], twice[order]
    cut = np.flatnonzero(np.diff(bucket[leader])) + 1
    lo, hi = starts[first[leader]].tolist(), (starts[end[leader] - 1] + lens[end[leader] - 1]).tolist()
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(leader)], strict=True):
        own = leader[a:b]
        text = b"\n".join([buf[lo[i] : hi[i]] for i in range(a, b)])
        yield int(bucket[own[0]]), 0, _pack(ids[doc[own]], tags[doc[own]], place[own], np.where(twice[a:b], 0, n[own]), text)


def _count(parts: list[bytes], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Ranges of windows (id, tag, first window, windows) that the bucket has twice or more."""
    ids, tags, places, ns, texts = (list(x) for x in zip(*map(_unpack, parts), strict=True))
    ids, tags, places, ns, buf = np.concatenate(ids), np.concatenate(tags), np.concatenate(places), np.concatenate(ns), b"\n".join(texts)
    starts, lens = _table(buf)
    raw = np.frombuffer(buf, np.uint8)
    ends = np.append(np.flatnonzero(raw == 10), len(buf))
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, ends, side="left")]))
    one, two = (Rolling(word_hashes(buf, starts, lens, seed), seed).windows(k) for seed in (1, 2))
    at = _windows(counts, k)
    own = np.repeat(np.arange(len(counts)), counts - k + 1)
    order, group = _twice(one[at], two[at])
    weight = np.bincount(group, weights=np.where(ns[own[order]] == 0, 2, 1))
    found = np.zeros(len(at), bool)
    found[order] = weight[group] > 1
    found &= ns[own] > 0
    hit = np.flatnonzero(found)
    if not len(hit):
        return
    new = np.flatnonzero(np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(own[hit]) != 0)]))
    s, head = own[hit[new]], np.cumsum(counts - k + 1) - (counts - k + 1)
    yield ids[s], tags[s], places[s] + (hit[new] - head[s]), np.diff(np.append(new, len(hit)))


def _kept(words: list[bytes], first: np.ndarray, n: np.ndarray, k: int) -> tuple[bytes, int]:
    if not len(first):
        return b" ".join(words), 0
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + n + k - 1, -1)
    keep = np.cumsum(change)[:-1] == 0
    return b" ".join(compress(words, keep.tolist())), int(len(words) - keep.sum())


def repeated_windows(docs: DataFrame, k: int) -> DataFrame:
    """Rows id, tag, ranges: each document's ranges of repeated windows; a document without any has no row."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = max(1, math.ceil(3 * total / BUCKET))

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent()
        for batch in batches:
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in slices(batch.column(2), CHUNK):
                rows = list(_super_kmers(ids[a:b], tags[a:b], binaries(batch.column(2).slice(a, b - a)), k, buckets, sent))
                if rows:
                    bucket, kind, packed = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(kind, pa.int8()), pa.array(packed, pa.binary())], ["bucket", "kind", "packed"])

    @tidy
    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids: np.ndarray, tags: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tags, pa.int64()), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32))], ["id", "tag", "first", "n"])

        now, parts = None, []
        for batch in batches:
            for bucket, kind, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    yield out(*_unpack(packed)[:4])
                    continue
                if bucket != now and parts:
                    yield from (out(*x) for x in _count(parts, k))
                    parts = []
                now = bucket
                parts.append(packed)
        if parts:
            yield from (out(*x) for x in _count(parts, k))

    packed = docs.select("id", "tag", "text").mapInArrow(pack, "bucket int, kind tinyint, packed binary")
    met = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verdicts, "id bigint, tag bigint, first int, n int")
    return met.groupBy("id", "tag").agg(F.collect_list(F.struct("first", "n")).alias("ranges"))


def remove_repeated(docs: DataFrame, *, window: int = 35, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows doc (a struct of the columns in keep), n_words, n_removed, kept_text.

    A word goes if a window of that many consecutive words of its document covers it and the same words also start
    anywhere else; windows are judged on the input. Kept words are joined by one space.
    """
    modest_batches(docs.sparkSession)
    keyed = docs.select(F.struct(*keep).alias("doc"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tag"), "text")
    found = repeated_windows(keyed, window)
    joined = keyed.join(found.withColumnsRenamed({"id": "found_id", "tag": "found_tag"}), (F.col("id") == F.col("found_id")) & (F.col("tag") == F.col("found_tag")), "left").select("doc", "text", "ranges")

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, kept, sizes, gone = batch.column(2), [], [], []
            flat = lists.flatten()
            first, n = (flat.field(i).to_numpy() for i in (0, 1))
            lengths = np.array(lists.value_lengths().fill_null(0))
            ends = np.cumsum(lengths).tolist()
            for text, end, count in zip(binaries(batch.column(1)), ends, lengths.tolist(), strict=True):
                words = text.split()
                left, removed = _kept(words, first[end - count : end], n[end - count : end], window)
                kept.append(left)
                sizes.append(len(words))
                gone.append(removed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc", "n_words", "n_removed", "kept_text"])

    schema = T.StructType([joined.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(cut, schema)
