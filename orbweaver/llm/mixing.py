"""Mixing sources to target weights in fixed-length blocks.

The words of each source, in the order of its documents' keys, are packed into blocks of one length: `block` words, or a
256th of the source where that is shorter, so that whole blocks make any source's target. Every source has a number of
output slots that makes its target; output shards draw how many of their slots each source gets from a
multinomial distribution over what the sources have left, so that the last shard makes the targets whole. A source's
slots are numbered on over the shards, and slot k takes block p(k mod blocks), p being a pseudorandom permutation of the
source's block numbers for each round through them (a Feistel network that walks past numbers out of range). So each
block is taken in every full round and in a share of the last one, and never more than `most` times. Blocks are joined
to slots by source and index. Everything follows from the seed and the data; runs agree.

The plan on the driver has a row for each source and for each shard, and PLAN numbers at most: shards grow where there are
many sources. More than SOURCES sources raise ValueError. Word offsets come from sums over sorted partitions, of which the
driver sees one row for each partition and source that meet.

A null or empty text has size 0 and is taken 0 times. A null source is a source, the last; rows with null keys come
first; rows with equal keys stand in order of their sizes. Repeated rows are documents of their own. An empty table
gives an empty result. Only key, text and source are read by take(); mix() keeps other columns, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import local_table, map_batches, written

#: Words of a block, and blocks that any source has if it has so many words; slots of an output shard; shards at most.
BLOCK, PARTS, SLOTS, SHARDS = 256, 256, 4096, 20_000
#: Sources, and numbers of a plan, at most.
SOURCES, PLAN = 10_000, 4_000_000
WEIGHTS = (5, 2, 1)
MOST = 3

_WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> list[float]:
    """Words for each source: the share of all words by weight, none above `most` times its size; the excess goes to the others by weight."""
    w = [float(weights[k % len(weights)]) for k in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), share * sum(sizes)
    while open_:
        total = sum(w[k] for k in open_)
        full = [k for k in open_ if left * w[k] / total > most * sizes[k]]
        if not full:
            for k in open_:
                out[k] = left * w[k] / total
            break
        for k in full:
            out[k] = float(most * sizes[k])
        open_.difference_update(full)
        left = share * sum(sizes) - sum(out[k] for k in range(len(sizes)) if k not in open_)
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def permuted(index: np.ndarray, n: int, tweak: np.ndarray, rounds: int = 6) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n - 1 for each tweak, at the indices given."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, left = index.astype(np.uint64), np.arange(len(index))
    while len(left):
        l, r = out[left] >> half, out[left] & mask
        for k in range(rounds):
            l, r = r, l ^ (_mixed(r + _mixed(tweak[left].astype(np.uint64) * np.uint64(rounds) + np.uint64(k))) & mask)
        out[left] = l << half | r
        left = left[out[left] >= n]
    return out.astype(np.int64)


def _offsets(df: DataFrame, key: str, text: str, source: str, whole: bool) -> DataFrame:
    """part, row, __source, __size and the words of the source before the document within its partition; with df's columns if whole."""
    names = df.columns if whole else []

    kind = df.schema[key].dataType.simpleString()
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in df.schema if whole)
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    rows = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{source}`").cast("string").alias("__source"), size.alias("__size"), *(F.col(f"`{c}`") for c in names))
    if not whole:  # a range is dealt after a sample of it: small rows are written first, not counted twice
        rows = written(rows, "sizes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row, total = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            starts = []
            for s, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                starts.append(total.get(s, 0))
                total[s] = starts[-1] + n
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * k, pa.int32()), pa.array(range(row, row + k), pa.int64()), *batch.columns[:3], pa.array(starts, pa.int64()), *batch.columns[3:]], ["__part", "__row", "__key", "__source", "__size", "__start", *names])
            row += k

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, "__source", "__key", "__size").sortWithinPartitions("__source", "__key", "__size")
    return written(map_batches(ordered, run, f"__part int, __row long, __key {kind}, __source string, __size long, __start long{fields}"), "offsets")


class Plan:
    """What the driver knows of a mix: sources in order, their sizes, targets, blocks and slots, and the partitions' offsets."""

    def __init__(self, offsets: DataFrame, block: int, seed: int, weights: tuple[float, ...], most: int, slots: int, shards: int):
        ends = offsets.groupBy("__part", "__source").agg(F.max(F.col("__start") + F.col("__size")).alias("n")).collect()
        self.sources = sorted({r["__source"] for r in ends}, key=lambda s: (s is None, s or ""))
        self.number = {s: k for k, s in enumerate(self.sources)}
        self.sizes = [0] * len(self.sources)
        self.before: dict[tuple[int, str | None], int] = {}
        for r in sorted(ends, key=lambda r: r["__part"]):
            k = self.number[r["__source"]]
            self.before[r["__part"], r["__source"]] = self.sizes[k]
            self.sizes[k] += r["n"]
        if len(self.sources) > SOURCES:
            raise ValueError(f"{len(self.sources)} sources, more than {SOURCES}")
        self.targets = targets(self.sizes, weights, 1.0, most)
        self.seed, self.slots = seed, slots
        self.lengths = [max(1, min(block, n // PARTS)) for n in self.sizes]
        self.blocks = [-(-n // b) for n, b in zip(self.sizes, self.lengths, strict=True)]
        rounds = [min(most, int(t // n)) if n else 0 for t, n in zip(self.targets, self.sizes, strict=True)]
        self.quota = [e * b + (round((t - e * n) / n * b) if n and e < most else 0) for e, b, t, n in zip(rounds, self.blocks, self.targets, self.sizes, strict=True)]
        self.slots = max(slots, -(-sum(self.quota) // max(1, min(shards, PLAN // max(1, len(self.sources))))))

    def draws(self) -> list[tuple[int, list[int], list[int]]]:
        """For each output shard, the slots of each source and the number of the first."""
        draw, left, done, out = np.random.default_rng(self.seed), np.array(self.quota, np.int64), np.zeros(len(self.quota), np.int64), []
        while (total := int(left.sum())):
            n = min(self.slots, total)
            got = np.minimum(draw.multinomial(n, left / total), left)
            while (short := n - int(got.sum())):  # what a source had no slots left for goes to the others
                room = left - got
                got += np.minimum(draw.multinomial(short, room / room.sum()), room)
            out.append((len(out), got.tolist(), done.tolist()))
            done, left = done + got, left - got
        return out


def slots(df: DataFrame, plan: Plan) -> DataFrame:
    """(shard, slot, source number, block index) of every output slot. df: any DataFrame of the session."""
    spark, blocks, seed = df.sparkSession, plan.blocks, plan.seed
    drawn = plan.draws()
    rows = local_table(spark, drawn, "shard int, n array<long>, first array<long>")
    rows = rows.repartition(max(1, min(len(drawn), int(spark.conf.get("spark.sql.shuffle.partitions")))), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                source = np.repeat(np.arange(len(n)), n)
                index = np.zeros(len(source), np.int64)
                at = 0
                for k, (count, start) in enumerate(zip(n, first, strict=True)):
                    if count:
                        k_th = np.arange(start, start + count)
                        tweak = (k_th // blocks[k] * len(n) + k).astype(np.uint64) * np.uint64(1_000_003) + np.uint64(seed)
                        index[at : at + count] = permuted(k_th % blocks[k], blocks[k], tweak)
                    at += count
                where = np.random.default_rng([seed, shard]).permutation(len(source))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(source), shard, np.int32)), pa.array(where), pa.array(source.astype(np.int32)), pa.array(index)], ["shard", "slot", "source_number", "block"])

    return map_batches(rows, run, "shard int, slot long, source_number int, block long")


def _pieces(offsets: DataFrame, plan: Plan) -> DataFrame:
    """A row for each document and block that meet: the document's place, and the words of it in the block."""
    before, number, lengths = plan.before, plan.number, np.array([*plan.lengths, 1], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, row, source, size, start = (c.to_pylist() for c in batch.columns)
            begin = np.array([a + before[p, s] for a, p, s in zip(start, part, source, strict=True)], np.int64)
            size = np.array(size, np.int64)
            own = np.array([number[s] for s in source], np.int64)
            block = lengths[own]
            first = begin // block
            count = np.where(size > 0, (begin + size - 1) // block - first + 1, 0)
            which = np.repeat(np.arange(len(size)), count)
            b = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            block = block[which]
            a = np.maximum(b * block, begin[which]) - begin[which]
            z = np.minimum((b + 1) * block, begin[which] + size[which]) - begin[which]
            columns = [np.array(part, np.int32)[which], np.array(row, np.int64)[which], own[which].astype(np.int32), b, a, z]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "row", "source_number", "block", "a", "z"])

    return map_batches(offsets.select("__part", "__row", "__source", "__size", "__start"), run, "part int, row long, source_number int, block long, a long, z long")


def _taken(offsets: DataFrame, plan: Plan) -> DataFrame:
    """_pieces() with how often the mix takes each."""
    times = written(slots(offsets, plan).groupBy("source_number", "block").agg(F.count("*").alias("times")), "times")
    # Spark cannot tell how many rows come out of Python, and must not take either side for small
    return _pieces(offsets, plan).join(times.hint("merge"), ["source_number", "block"])


def take(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, slots_: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Per row: key, size, source_size, target (of its source) and taken (its words in the mix, repeats counted)."""
    offsets = _offsets(df, key, text, source, False)
    plan = Plan(offsets, block, seed, weights, most, slots_, shards)
    taken = _taken(offsets, plan).groupBy("part", "row").agg(F.sum(F.col("times") * (F.col("z") - F.col("a"))).alias("taken"))
    # SOURCES rows at most
    per_source = local_table(df.sparkSession, zip(plan.sources, plan.sizes, plan.targets, strict=True), "source string, source_size long, target double")
    rows = offsets.join(taken.hint("merge"), (F.col("__part") == F.col("part")) & (F.col("__row") == F.col("row")), "left").join(F.broadcast(per_source), F.col("__source").eqNullSafe(F.col("source")))
    return rows.select(F.col("__key").alias(key), F.col("__size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, seed: int = 0, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, slots_: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """The mix as rows of df: a row for each time that words of a document are taken, its text those words.

    Words next to each other keep what stands between them; a line feed stands where words were left out.
    """
    offsets = _offsets(df, key, text, source, True)
    plan = Plan(offsets, block, seed, weights, most, slots_, shards)
    pieces = _taken(offsets, plan).groupBy(F.col("part").alias("__p"), F.col("row").alias("__r")).agg(F.sort_array(F.collect_list(F.struct("a", "z", "times"))).alias("__pieces"))
    joined = offsets.join(pieces.hint("merge"), (F.col("__part") == F.col("__p")) & (F.col("__row") == F.col("__r"))).select("__pieces", *(F.col(f"`{c}`") for c in df.columns))
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], []
            for k, (found, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1 + at).to_pylist(), strict=True)):
                texts_k = copies(t, [(p["a"], p["z"], p["times"]) for p in found])
                rows += [k] * len(texts_k)
                texts += texts_k
            which = pa.array(rows, pa.int64())
            columns = [pa.array(texts, pa.string()) if k == at else c.take(which) for k, c in enumerate(batch.columns[1:])]
            yield pa.RecordBatch.from_arrays(columns, df_columns)

    df_columns = list(df.columns)
    return map_batches(joined, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))


def copies(text: str, pieces: list[tuple[int, int, int]]) -> list[str]:
    """The texts of the first, second, ... time that words [a, z) of the text are taken, each `times` often."""
    spans, out = [m.span() for m in _WORD.finditer(text)], []
    for c in range(1, max(n for _, _, n in pieces) + 1):
        runs: list[list[int]] = []
        for a, z, n in pieces:
            if n >= c:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = z
                else:
                    runs.append([a, z])
        out.append(text if runs == [[0, len(spans)]] else "\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in runs))
    return out
