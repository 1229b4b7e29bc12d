"""SimHash near-dedup: a byte-position inverted index with count filtering.

A fingerprint has 64 bits, a bit being 1 where over half of the XXH64 values (seed 42) of the text's word shingles have
it. Two fingerprints that differ in at most d bits differ in at most d of their eight bytes: 8 - d positional bytes is
the guaranteed minimum that they share. The positions are cut into d + 2 groups, of which two at least are then equal
whole, so the index has a posting for every two groups and the bytes there, and every link meets in one. In a posting the
shared positional bytes of each pair are tallied; pairs that reach the minimum are verified bit by bit, and the posting
passes on a spanning forest of the links. Fingerprints are made distinct first.

A posting of over CROWD members is not compared whole: its members go on to postings by the bytes of 8 - d positions, for
every choice of so many that holds the first ones. There d bytes at most vary, so a posting has at most 256^d members
whatever the corpus, and each looks up the values within the distance: work grows with rows, not with pairs.

Near copies of a shingle similarity of 0.8 differ in about 15 % of the bits, too many for eight bytes to promise much:
`near_texts` has longer fingerprints for them.

Words are what stands between ASCII white space, A-Z in lower case; a text of fewer words than a shingle has is one
shingle, and a null, empty or blank text has fingerprint zero, which links like any other. Rows with equal keys are
each returned, with what their own text gives; their links count for the key. Null keys have a fingerprint but a null
component, and link nothing. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, forest
from .runtime import drop_written, map_batches, written

#: Members of a posting up to which all its pairs are tallied.
CROWD = 4096
#: Values whose bits are summed at a time, in bytes.
_PIECE = 255


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 values (seed 42) of the text's shingles, repeats included."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[:-words] + 1).tolist()]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64)


def spread(h: np.ndarray, count: int) -> np.ndarray:
    """A row of `count` words for each value: the value itself, then others that follow from it."""
    out = np.repeat(h[:, None], count, 1)
    x = out[:, 1:]
    x += np.arange(1, count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    x ^= x >> np.uint64(31)
    return out


def majority(h: np.ndarray, count: int = 1) -> np.ndarray:
    """`count` 64-bit words: the bits that over half of the values' words have; zeros where there are no values."""
    total = np.zeros(64 * count, np.int64)
    for k in range(0, len(h), _PIECE):
        part = spread(h[k : k + _PIECE], count)
        # bits as bytes, eight of which are added at once: 255 ones fit a byte
        total += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").view(np.uint64).sum(0).view(np.uint8)
    return np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """The signed 64-bit fingerprint."""
    return int(majority(shingle_hashes(text, words)).view(np.int64)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp): the fingerprint of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], pa.int64())], ["key", "fp"])

    return map_batches(df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")), run, "key long, fp long")


def _masks(choices: list[tuple[int, ...]]) -> list[int]:
    return np.array([sum(0xFF << 8 * k for k in x) for x in choices], np.uint64).astype(np.int64).tolist()


def pair_choices(distance: int) -> list[tuple[int, ...]]:
    """The positions of every two of the distance + 2 groups that the eight positions are cut into."""
    groups = np.array_split(np.arange(8), min(8, distance + 2))
    return [tuple(np.concatenate(x).tolist()) for x in combinations(groups, 2)]


def full_choices(distance: int) -> list[list[tuple[int, ...]]]:
    """For each of pair_choices() the choices of 8 - distance positions that hold its positions."""
    return [[x for x in combinations(range(8), 8 - distance) if set(c) <= set(x)] for c in pair_choices(distance)]


def tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many positional bytes the words of a and b share, along the last axis."""
    return (a.view(np.uint8) == b.view(np.uint8)).sum(-1)


def _small(fp: np.ndarray, x: np.ndarray, y: np.ndarray, distance: int) -> np.ndarray:
    """Which of the pairs x, y share the minimum of bytes and then differ in few enough bits."""
    hit = np.flatnonzero(tally(fp[x, None], fp[y, None]) >= 8 - distance)
    return hit[np.bitwise_count(fp[x[hit]] ^ fp[y[hit]]) <= distance]


def _lookup(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among members that differ in `distance` bytes only: each looks up every value within the distance."""
    varying = int(np.bitwise_or.reduce(fp ^ fp[0]))
    places = [b for b in range(64) if varying >> b & 1]
    order = np.argsort(fp)
    ordered = fp[order]
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(1, distance + 1):
        for change in combinations(places, n):
            wanted = fp ^ np.uint64(sum(1 << k for k in change))
            at = np.minimum(np.searchsorted(ordered, wanted), len(fp) - 1)
            hit = np.flatnonzero(ordered[at] == wanted)
            a.append(hit)
            b.append(order[at[hit]])
    return np.concatenate(a), np.concatenate(b)


def _links(fp: np.ndarray, first: np.ndarray, sizes: np.ndarray, distance: int, crowd: int) -> np.ndarray | None:
    """A spanning forest of the links within each posting fp[first : first + size]; None if there are none."""
    parent = None
    for size in np.unique(sizes[sizes > 1]).tolist():
        at = first[sizes == size]
        if size <= 64:  # many small postings at a time
            i, j = np.triu_indices(size, 1)
            for k in range(0, len(at), step := max(1, (1 << 18) // len(i))):
                x, y = (at[k : k + step, None] + i).ravel(), (at[k : k + step, None] + j).ravel()
                hit = _small(fp, x, y, distance)
                parent = forest(len(fp), x[hit], y[hit], parent)
        elif size <= crowd:
            for k in at.tolist():
                for row in range(0, size, step := max(1, (1 << 18) // size)):
                    x, y = (v.ravel() for v in np.meshgrid(np.arange(k + row, k + min(size, row + step)), np.arange(k + row, k + size), indexing="ij"))
                    x, y = x[x < y], y[x < y]
                    hit = _small(fp, x, y, distance)
                    parent = forest(len(fp), x[hit], y[hit], parent)
        else:
            for k in at.tolist():
                x, y = _lookup(fp[k : k + size], distance)
                parent = forest(len(fp), k + x, k + y, parent)
    return parent


_OUT = ["a", "b", "which", "fp"]


def _postings(batches: Iterator[pa.RecordBatch], masks: np.ndarray, distance: int, crowd: int, split: bool) -> Iterator[pa.RecordBatch]:
    """From rows (which, rep, fp) sorted by posting: links (a, b), and with `split` the members (rep as a, which, fp) of crowds."""

    def members(which: np.ndarray, rep: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.nulls(len(rep), pa.int64()), pa.array(which), pa.array(fp)], _OUT)

    def links(which: np.ndarray, rep: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        bytes_ = fp & masks[which]
        first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (bytes_[1:] != bytes_[:-1])]))
        sizes = np.diff(np.concatenate([first, [len(rep)]]))
        if split and (large := sizes > crowd).any():
            go = np.repeat(large, sizes)
            yield members(which[go], rep[go], fp[go])
            sizes = np.where(large, 0, sizes)
        parent = _links(fp.view(np.uint64), first, sizes, distance, crowd)
        if parent is not None and len(child := np.flatnonzero(parent != np.arange(len(rep)))):
            yield pa.RecordBatch.from_arrays([pa.array(rep[child]), pa.array(rep[parent[child]]), pa.nulls(len(child), pa.int32()), pa.nulls(len(child), pa.int64())], _OUT)

    rest, crowded = None, None  # the rows of the last posting so far, and that posting if it is a crowd that was sent on
    for batch in batches:
        now = [np.asarray(c) for c in batch.columns]
        if crowded is not None and len(now[0]):
            n = int(((now[0] == crowded[0]) & ((now[2] & masks[now[0]]) == crowded[1])).sum())
            yield members(*(x[:n] for x in now))
            now = [x[n:] for x in now]
        if not len(now[0]):
            continue
        crowded = None
        now = now if rest is None else [np.concatenate([x, y]) for x, y in zip(rest, now, strict=True)]
        last = now[0][-1], now[2][-1] & masks[now[0][-1]]
        cut = len(now[0]) - int(((now[0] == last[0]) & ((now[2] & masks[now[0]]) == last[1])).sum())
        rest = [x[cut:].copy() for x in now]  # it may go on in the next batch
        if split and len(rest[0]) > crowd:
            yield members(*rest)
            rest, crowded = None, last
        if cut:
            yield from links(*(x[:cut] for x in now))
    if rest is not None:
        yield from links(*rest)


def _met(index: DataFrame, choices: list[tuple[int, ...]], distance: int, crowd: int, split: bool) -> DataFrame:
    """_postings() of the rows (which, rep, fp), dealt by posting."""
    masks = _masks(choices)
    key: Column = F.col("fp").bitwiseAND(F.element_at(F.array(*map(F.lit, masks)), F.col("which") + 1))
    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = index.select("which", "rep", "fp").repartition(parts, "which", key).sortWithinPartitions("which", key)
    held = np.array(masks, np.int64)
    return map_batches(dealt, lambda batches: _postings(batches, held, distance, crowd, split), "a long, b long, which int, fp long")


def near_links(same: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) of (rep, fp), whose fp all differ, that join all that links of up to `distance` bits join."""
    pairs, full = pair_choices(distance), full_choices(distance)
    index = same.select(F.explode(F.sequence(F.lit(0), F.lit(len(pairs) - 1))).alias("which"), "rep", "fp")
    met = written(_met(index, pairs, distance, crowd, True), "links")
    choices = sorted({x for some in full for x in some})
    number = F.array(*(F.array(*(F.lit(choices.index(x)) for x in some)) for some in full))
    crowds = met.where("which is not null").select(F.explode(F.element_at(number, F.col("which") + 1)).alias("which"), F.col("a").alias("rep"), "fp").distinct()
    more = _met(crowds, choices, distance, crowd, False)
    return met.where("which is null").select("a", "b").union(more.select("a", "b"))


def near_groups(fps: DataFrame, distance: int = 2, crowd: int = CROWD) -> DataFrame:
    """Every row of (key, fp) with component_id: the smallest key reachable over links of at most `distance` differing bits."""
    same = written(fps.where("key is not null").groupBy("fp").agg(F.min("key").alias("rep")), "fingerprints")
    joined = components(near_links(same, distance, crowd))
    group = written(same.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id")), "groups")
    drop_written(same)
    return fps.join(group, ["fp"], "left").select("key", "fp", F.when(F.col("key").isNotNull(), F.col("component_id")).alias("component_id"))


def components_of(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """Per row: key, fingerprint in 16 hex digits, component_id."""
    out = near_groups(written(fingerprints(df, key, text, words), "simhash"), distance)
    return out.select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
