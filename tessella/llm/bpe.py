"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words stand in one flat array. Each round looks every neighbouring pair up by binary search over
the sorted pair keys, takes the lowest rank of each word and merges its places from the left; words without a known
pair leave the array. Words are encoded once a batch and looked up in a bounded table of recent ones.

Defined cases: null and empty texts have no ids and decode to the empty text; the added token's string in a text is
that token; ids that are no token decode to nothing; invalid UTF-8 after decoding becomes U+FFFD; repeated rows are
encoded one by one. Only the text is read, and the columns asked for are passed on inside a struct.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.textbits import modest_batches, ragged, slices, spread, tidy

#: The pre-tokenizer's pattern: fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters worked on at once, and words that a worker remembers with their ids.
CHUNK, REMEMBERED = 1_000_000, 250_000


def byte_characters() -> dict[str, int]:
    """The byte that each character of the vocabulary stands for: printable ones as they are, others from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """The tables of one vocabulary: byte ids, sorted pair keys with rank and result, and each id's bytes."""

    def __init__(self, definition: dict):
        model, chars = definition["model"], byte_characters()
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in definition["added_tokens"]}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.byte_ids[b] = vocab[c]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        table = [b""] * self.size
        for token, i in vocab.items():
            table[i] = bytes(chars[c] for c in token)
        for token, i in self.added.items():
            table[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.token_lens = np.array([len(t) for t in table], np.int64)
        self.token_at = np.cumsum(self.token_lens) - self.token_lens
        self.pieces = regex.compile(PATTERN)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.known: dict[str, bytes] = {}

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        none = len(self.keys)
        lens = np.array([len(w) for w in words], np.int64)
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), lens)
        ids, owners = [], []
        while len(symbols):
            inner = of[1:] == of[:-1]
            rank = np.full(len(symbols), none, np.int64)
            at = np.flatnonzero(inner)
            rank[at] = self.rank_of(symbols[at], symbols[at + 1])
            heads = np.flatnonzero(np.concatenate([[True], ~inner]))
            least = np.minimum.reduceat(rank, heads)
            going = np.repeat(least < none, np.diff(np.append(heads, len(symbols))))
            if not going.all():
                ids.append(symbols[~going])
                owners.append(of[~going])
                symbols, of, rank = symbols[going], of[going], rank[going]
                least = least[least < none]
                if not len(symbols):
                    break
                heads = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            chosen = rank == np.repeat(least, np.diff(np.append(heads, len(symbols))))
            # Of overlapping places, as in "aaa", every second one counts, from the left of its run.
            run = np.flatnonzero(chosen & np.concatenate([[True], ~(chosen[:-1] & (of[1:] == of[:-1]))]))
            place = np.flatnonzero(chosen)
            chosen[place] = (place - run[np.searchsorted(run, place, side="right") - 1]) % 2 == 0
            place = np.flatnonzero(chosen)
            symbols[place] = self.merged[rank[place]]
            keep = np.ones(len(symbols), bool)
            keep[place + 1] = False
            symbols, of = symbols[keep], of[keep]
        if not ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        owner = np.concatenate(owners)
        return np.concatenate(ids)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def learn(self, words: list[str]) -> None:
        flat, lens = self.merge_words([w.encode() for w in words if w not in self.added])
        flat, ends = flat.astype(np.int32), np.cumsum(lens)
        runs = zip((ends - lens).tolist(), ends.tolist(), strict=True)
        for w in words:
            self.known[w] = np.int32(self.added[w]).tobytes() if w in self.added else flat[slice(*next(runs))].tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        pieces: list[str] = []
        counts = []
        for text in texts:
            before = len(pieces)
            if self.split_added and any(a in text for a in self.added):
                for i, part in enumerate(self.split_added.split(text)):
                    pieces += [part] if i % 2 else self.pieces.findall(part)
            else:
                pieces += self.pieces.findall(text)
            counts.append(len(pieces) - before)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return spread(pieces, counts, self.known, self.learn)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each run of ids; what is no valid UTF-8 is replaced."""
        ok = (ids >= 0) & (ids < self.size)
        safe = np.where(ok, ids, 0)
        lens = np.where(ok, self.token_lens[safe], 0)
        raw = self.token_bytes[ragged(self.token_at[safe], lens)].tobytes()
        edges = np.concatenate([[0], np.cumsum(lens)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(edges, edges[1:], strict=False)]


@lru_cache(maxsize=2)
def loaded(definition: str) -> ByteBpe:
    return ByteBpe(json.loads(definition))


def read_definition(path: str) -> str:
    """The tokenizer file's text, read on the driver and sent along with the tasks (a few MB, a fixed size)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_texts(docs: DataFrame, definition: str, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", decode: bool = False) -> DataFrame:
    """Rows doc (a struct of the columns in keep), ids array<int> and, if asked for, decoded, the text of these ids."""
    modest_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(definition)
    df = docs.select(F.struct(*keep).alias("doc"), F.col(text).alias("text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(sent.value)
        for batch in batches:
            for a, b in slices(batch.column(1), CHUNK):
                ids, counts = model.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                columns = [batch.column(0).slice(a, b - a), lists]
                if decode:
                    columns.append(pa.array(model.decode(ids, counts), pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc", "ids", "decoded"][: len(columns)])

    fields = [df.schema["doc"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return df.mapInArrow(run, T.StructType(fields if decode else fields[:2]))


def decode_ids(encoded: DataFrame, definition: str) -> DataFrame:
    """Add decoded, the text of stored ids."""
    modest_batches(encoded.sparkSession)
    sent = encoded.sparkSession.sparkContext.broadcast(definition)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(sent.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(1)
            counts = np.array(lists.value_lengths().fill_null(0), np.int64)
            out = model.decode(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()).cast(pa.string())], ["doc", "ids", "decoded"])

    return encoded.select("doc", "ids").mapInArrow(run, T.StructType([*encoded.select("doc", "ids").schema, T.StructField("decoded", T.StringType())]))
