"""Words, word hashes and window hashes of many texts at once, as flat numpy arrays."""

from __future__ import annotations

import ctypes
import time
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_LIBC = ctypes.CDLL(None)
K1, K2, K3, K4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_ROLL = 0x5851F42D4C957F2D


def mix(x: np.ndarray) -> np.ndarray:
    x = x * K2
    x ^= x >> np.uint64(31)
    x *= K3
    x ^= x >> np.uint64(29)
    return x


def binaries(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about `most` bytes together; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


#: Bytes of an Arrow batch; the session's default of 64 MB is held several times over by each Python worker.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864", 8 << 20


def modest_batches(spark: SparkSession) -> None:
    """Ask for small Arrow batches, unless the session has a size of its own."""
    if spark.conf.get(BATCH_SETTING, BATCH_DEFAULT).rstrip("b") == BATCH_DEFAULT:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system; workers are kept between stages, and so is what they hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_LIBC, "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, releasing memory every second and at the task's end."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        then = time.monotonic()
        for batch in run(batches):
            yield batch
            if time.monotonic() - then > 1:
                release()
                then = time.monotonic()
        release()

    return tidied


def slices(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes together; a longer text stands alone."""
    sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).tolist()
    first = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(sizes):
        yield first, len(sizes)


def spread(pieces: list[str], counts: list[int], ids: dict[str, bytes], learn: Callable[[list[str]], None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts given as runs of pieces, and how many each text has. ids: each piece's as 32-bit integers; learn adds pieces."""
    number: dict[str, int] = defaultdict(count().__next__)
    which = np.fromiter(map(number.__getitem__, pieces), np.int64, len(pieces))
    if unseen := [p for p in number if p not in ids]:
        learn(unseen)
    found = [ids[p] for p in number]
    lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
    per_piece = lens[which]
    out = np.frombuffer(b"".join(found), np.int32)[ragged((np.cumsum(lens) - lens)[which], per_piece)]
    edges = np.concatenate([[0], np.cumsum(per_piece)])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
    return out, np.diff(edges)


def word_hashes(buf: bytes, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each byte slice, eight bytes a step."""
    eight = np.ndarray((len(buf) + 1,), "<u8", buffer=buf + bytes(8), strides=(1,))
    out = mix(lens.astype(np.uint64) * K1 + np.uint64(seed))
    out = mix(out ^ (eight[starts] & _MASKS[np.minimum(lens, 8)]))
    go = np.flatnonzero(lens > 8)
    at, left = starts[go] + 8, lens[go] - 8
    while len(go):
        out[go] = mix(out[go] ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
        more = left > 8
        go, at, left = go[more], at[more] + 8, left[more] - 8
    return out


class Rolling:
    """Hashes of ranges of words in O(1) from running sums."""

    def __init__(self, hashes: np.ndarray, seed: int = 0):
        n = len(hashes)
        r = (_ROLL + 2 * seed) % 2**64 | 1
        powers = np.full(n + 1, r, dtype=np.uint64)
        powers[0] = 1
        inverse = np.full(n + 1, pow(r, -1, 2**64), dtype=np.uint64)
        inverse[0] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(powers)[:n], dtype=np.uint64)])
        self.inverse = np.cumprod(inverse)

    def windows(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)

    def ranges(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.inverse[first])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values."""
    cur, span, n = x, 1, len(x) - w + 1
    while span * 2 <= w:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    return np.minimum(cur[:n], cur[w - span : w - span + n])


def ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), first[1], ..."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(first - (ends - counts), counts)


_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_LETTER = (_BYTES >= 128) | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 48) & (_BYTES <= 57))


def letter_words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a-z, 0-9 and all beyond ASCII after A-Z became a-z: buffer, starts, lengths, words of each text."""
    low = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    inside = np.concatenate([[False], _LETTER[low], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, lens = edge[::2], edge[1::2] - edge[::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return low.tobytes(), starts, lens, np.diff(np.searchsorted(starts, ends, side="left"), prepend=0)
