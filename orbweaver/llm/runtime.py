"""Arrow batches, the package on the executors, and ids kept from batch to batch."""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import drop_written, local_table, shared_dir, written

__all__ = ["BATCH_BYTES", "CHUNK_CHARS", "Memo", "PackedMemo", "chunks", "drop_written", "local_table", "map_batches", "ragged", "shared_dir", "ship", "written"]

#: Bytes of one Arrow batch; rows here can hold long texts, and larger batches are heavy on a Python worker.
BATCH_BYTES = 4 << 20
#: Characters that a Python worker takes on at a time.
CHUNK_CHARS = 1_000_000


def ship(spark: SparkSession) -> None:
    """Give the executors this package once for each context, so that their Python workers can import it."""
    context = spark.sparkContext
    if getattr(context, "_orbweaver_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = f"{context._temp_dir}/orbweaver-{uuid.uuid4().hex}.zip"  # Spark serves it from there and removes it at the end
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    z.write(f"{at}/{f}", os.path.relpath(f"{at}/{f}", os.path.dirname(top)))
    context.addPyFile(name)
    context._orbweaver_shipped = True


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow in batches of bounded bytes, since rows here hold whole texts; a bound that the session has set stays."""
    ship(df.sparkSession)
    conf, bound = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if bound not in conf.getAll:
        conf.set(bound, BATCH_BYTES)
    return df.mapInArrow(function, schema)


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters; a longer text stands alone."""
    at = held = 0
    for k, text in enumerate(texts):
        if held and held + len(text) > most:
            yield at, k
            at, held = k, 0
        held += len(text)
    if at < len(texts):
        yield at, len(texts)


def ragged(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + length], one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


#: Characters of all pieces that a memo keeps, at most.
MEMO_CHARS = 16_000_000


class Memo:
    """Token ids of pieces of text, kept from one batch to the next.

    It is emptied when it holds `most` pieces or MEMO_CHARS characters, so memory is bounded where pieces are long, too.

    encode: gives the pieces in an order of its own, all their ids in that order, and how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], most: int = 600_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.starts, self.lengths, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint16)
        self.used = self.chars = 0

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])

    def places(self, pieces: list[str]) -> np.ndarray:
        """For each piece where its ids are in `starts`, `lengths` and `flat`, until the next call."""
        if len(self.at) > self.most or self.chars > MEMO_CHARS:
            self._clear()
        new = list(set(pieces).difference(self.at))
        if new:
            new, flat, lengths = self.encode(new)
            n, k = len(self.at), len(new)
            self.starts, self.lengths = self._grown(self.starts, n + k), self._grown(self.lengths, n + k)
            self.flat = self._grown(self.flat, self.used + len(flat))
            self.lengths[n : n + k] = lengths
            self.starts[n : n + k] = self.used + np.cumsum(lengths) - lengths
            self.flat[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            self.chars += sum(map(len, new))
            self.at.update(zip(new, range(n, n + k), strict=True))
        return np.fromiter(map(self.at.__getitem__, pieces), np.int64, len(pieces))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces at the places, and how many ids each piece has."""
        lengths = self.lengths[places]
        return ragged(self.starts[places], lengths, self.flat), lengths

    def ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.gather(self.places(pieces))


#: Bytes of a piece above which it is compared alone.
LONG_PIECE = 256


class PackedMemo:
    """A Memo without Python objects, for very many pieces: some 50 bytes a piece, where a dictionary takes over 200.

    The pieces' bytes lie in one array. A piece is found by its XXH64 in a sorted array and then compared byte by byte; of
    pieces with the same XXH64 one is found, the others are encoded anew whenever they come. It is emptied when it holds
    `most` pieces or MEMO_CHARS bytes.

    encode: gives the places of the pieces in an order of its own, all their ids in that order, and how many each has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int, digest: Callable[[bytes], int] = xxhash.xxh64_intdigest):
        self.encode, self.most, self.digest = encode, most, digest
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.place_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.starts, self.lengths, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint16)
        self.text_starts, self.text_lengths, self.text = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 20, np.uint8)
        self.n = self.used = self.chars = 0

    @staticmethod
    def _put(a: np.ndarray, at: int, more: np.ndarray) -> np.ndarray:
        """a with `more` from `at` on, in a larger array if need be, whose rest takes no memory yet."""
        if at + len(more) > len(a):
            a, old = np.zeros(max(at + len(more), 3 * len(a) // 2), a.dtype), a
            a[:at] = old[:at]
        a[at : at + len(more)] = more
        return a

    @staticmethod
    def _bytes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and the bytes they lie in."""
        _, offsets, data = pieces.buffers()
        ends = np.frombuffer(offsets, np.int32)[pieces.offset : pieces.offset + len(pieces) + 1]
        return ends[:-1].astype(np.int64), np.diff(ends), np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)

    def _kept(self, pieces: pa.Array, hashed: np.ndarray) -> np.ndarray:
        """For each piece its place, or -1."""
        if not len(self.hashes):
            return np.full(len(pieces), -1, np.int64)
        starts, lengths, data = self._bytes(pieces)
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        places = self.place_of[at].astype(np.int64)
        same = (self.hashes[at] == hashed) & (self.text_lengths[places] == lengths)
        short = np.flatnonzero(same & (lengths <= LONG_PIECE))
        size = lengths[short].astype(np.int64)
        differ = ragged(starts[short], size, data) != ragged(self.text_starts[places[short]], size, self.text)
        so_far, ends = np.concatenate([[0], np.cumsum(differ)]), np.cumsum(size)
        same[short] = so_far[ends] == so_far[ends - size]
        for k in np.flatnonzero(same & (lengths > LONG_PIECE)).tolist():
            own = self.text_starts[places[k]]
            same[k] = np.array_equal(data[starts[k] : starts[k] + lengths[k]], self.text[own : own + lengths[k]])
        return np.where(same, places, -1)

    def _add(self, pieces: pa.Array, hashed: np.ndarray) -> np.ndarray:
        """Encode pieces and keep them; their places."""
        order, flat, lengths = self.encode(pieces.cast(pa.string()).to_pylist())
        starts, text_lengths, data = self._bytes(pieces := pieces.take(pa.array(order)))
        n, k = self.n, len(pieces)
        self.lengths, self.starts = self._put(self.lengths, n, lengths), self._put(self.starts, n, self.used + np.cumsum(lengths) - lengths)
        self.flat = self._put(self.flat, self.used, flat)
        self.text_lengths, self.text_starts = self._put(self.text_lengths, n, text_lengths), self._put(self.text_starts, n, self.chars + starts - starts[0])
        size = int(text_lengths.sum(dtype=np.int64))
        self.text = self._put(self.text, self.chars, data[starts[0] : starts[0] + size])
        self.n, self.used, self.chars = n + k, self.used + len(flat), self.chars + size
        fresh, first = np.unique(hashed[order], return_index=True)
        at = np.searchsorted(self.hashes, fresh)
        free = np.ones(len(fresh), bool) if not len(self.hashes) else self.hashes[np.minimum(at, len(self.hashes) - 1)] != fresh
        self.hashes = np.insert(self.hashes, at[free], fresh[free])
        self.place_of = np.insert(self.place_of, at[free], (n + first[free]).astype(np.int32))
        places = np.empty(k, np.int64)
        places[order] = np.arange(n, n + k)
        return places

    def places(self, pieces: pa.Array) -> np.ndarray:
        """For each piece where its ids are, until the next call; pieces that differ, as strings of Arrow."""
        if self.n > self.most or self.chars > MEMO_CHARS:
            self._clear()
        pieces = pieces.cast(pa.binary())
        hashed = np.fromiter(map(self.digest, pieces.to_pylist()), np.uint64, len(pieces))
        places = self._kept(pieces, hashed)
        new = np.flatnonzero(places < 0)
        if len(new):
            places[new] = self._add(pieces.take(pa.array(new)), hashed[new])
        return places

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces at the places, and how many ids each piece has."""
        lengths = self.lengths[places].astype(np.int64)
        return ragged(self.starts[places], lengths, self.flat), lengths
