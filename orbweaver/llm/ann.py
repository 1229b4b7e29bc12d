"""Approximate nearest neighbours by a hash-prefix forest.

Nearness is the inner product. Rows are indexed in shards of about SHARD vectors whose norms lie within a factor of
sqrt(2). In a shard, vectors are scaled by its largest norm and get one more coordinate that makes all norms equal, so that
the nearest are those of the smallest angle. A tree hashes a vector to a long string of bits, the sides of random planes it
lies on, and keeps the strings sorted. A query descends in every tree to its longest matching prefix, by binary search, and
then ascends in all trees together, a bit at a time: the candidates of a level are the vectors that share the query's
prefix of that length in any tree. Their inner products are computed in double precision from the vectors as they are.

A vector at angle t shares a prefix of n bits with the query in any of TREES trees with probability
1 - (1 - (1 - t / pi)^n)^TREES. A query ascends until this is 1 - MISS for the angle of its own neighbours: of the rank
that the last of the k would have in one shard of as many as there are. So how much is searched follows from the data, by
one rule at every size: near neighbours that stand out are found early, and where nothing stands out most is searched.

The forest of a shard is built once, by the task that has its rows; queries, which stand after them, stream past it in
batches. So no vector but a query's is sent to more than one task. The best of all shards are merged. Every row is indexed.

A vector that is null, empty or zero, or holds null, NaN or infinity, takes no part, nor does one of another length than
the query. A query's own id is no candidate; among equal scores the smaller id comes first. Rows with a null id take no
part. Rows with equal ids are rows of their own. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .embed_dedup import _VALID, _matrix
from .runtime import map_batches, ragged, written

#: Trees of a forest, bits of a string, vectors of a shard.
TREES, BITS, SHARD = 256, 18, 16384
#: Of the rows of a shard the share that the first level searched has, at least; bits up to which prefixes are looked up in a table.
FIRST, TABLE = 1 / 32, 12
#: Queries that ascend together.
QUERIES = 128
#: The chance with which the last of a query's neighbours may be missed.
MISS = 0.15


class Forest:
    """Trees over the rows of x."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 0):
        self.trees, self.bits, self.size = trees, bits, len(x)
        self.scale = np.abs(x).max()
        norms = np.sqrt(((x / self.scale) ** 2).sum(1))
        self.top = norms.max() * (1 + 1e-12)
        self.planes = np.random.default_rng(seed).standard_normal((trees * bits, x.shape[1] + 1))
        rest = np.sqrt(np.maximum(0.0, 1.0 - (norms / self.top) ** 2))
        codes = self.strings(np.concatenate([x / self.scale / self.top, rest[:, None]], 1))
        codes = np.ascontiguousarray(codes.T)
        self.order = np.argsort(codes, 1).astype(np.int32)
        self.codes = np.take_along_axis(codes, self.order, 1)
        # where each prefix of that many bits starts in each tree
        self.short = min(TABLE, bits)
        edges = np.arange((1 << self.short) + 1) << bits - self.short
        self.starts = np.stack([np.searchsorted(c, edges) for c in self.codes])

    def strings(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.trees), np.int32)
        for k in range(0, len(x), 512):
            side = (x[k : k + 512] @ self.planes.T > 0).reshape(-1, self.trees, self.bits)
            for b in range(self.bits):
                out[k : k + 512] = out[k : k + 512] << 1 | side[:, :, b]
        return out

    def nearest(self, x: np.ndarray, data: np.ndarray, rank: int, least: int, miss: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the candidates, `least` at least, and their inner products."""
        n, least = len(x), min(max(rank, least, int(FIRST * self.size)), self.size)
        norm = np.sqrt(((x / np.abs(x).max(1, keepdims=True)) ** 2).sum(1)) * np.abs(x).max(1)
        strings = self.strings(np.concatenate([x / norm[:, None], np.zeros((n, 1))], 1))
        score, order = np.full((n, self.size), -np.inf), self.order.ravel()
        base = np.arange(self.trees)[:, None] * self.size
        best, going, marked = [np.zeros(0)] * n, np.arange(n), np.zeros(self.size, bool)
        for length in range(self.bits, -1, -1):  # all queries ascend a bit at a time, in all trees
            shift = self.bits - length
            prefix = (strings[going] >> shift).T
            if length <= self.short:
                low, high = (self.starts[np.arange(self.trees)[:, None], prefix + k << self.short - length] for k in (0, 1))
            else:
                low, high = (np.stack([np.searchsorted(c, p + k << shift) for c, p in zip(self.codes, prefix, strict=True)]) for k in (0, 1))
            sizes, low = high - low, low + base
            stay = np.ones(len(going), bool)
            # fewer rows than that met in all cannot be enough different ones
            for at in np.flatnonzero(sizes.sum(0) >= least).tolist():
                q = going[at]
                marked[order_of(order, low[:, at], sizes[:, at])] = True
                new = np.flatnonzero(marked & (score[q] == -np.inf))
                marked[:] = False
                score[q, new] = found = data[new] @ x[q]
                best[q] = np.concatenate([best[q], found])
                if length == 0 or len(best[q]) == self.size:
                    stay[at] = False
                elif len(best[q]) >= least:
                    last = -np.partition(-best[q], rank - 1)[rank - 1]
                    share = 1 - np.arccos(np.clip(last / self.scale / self.top / norm[q], -1, 1)) / np.pi
                    stay[at] = (1 - share**length) ** self.trees > miss
            going = going[stay]
            if not len(going):
                break
        return [(at, row[at]) for row in score for at in [np.flatnonzero(row != -np.inf)]]


def order_of(order: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The rows that stand in those stretches of the trees."""
    some = sizes > 0
    return ragged(starts[some], sizes[some], order)


def _searched(batches: Iterator[pa.RecordBatch], k: int, miss: float, trees: int, bits: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of its shard for each query; rows (shard, query, id, rank, embedding) stand by shard, data (query is -1) first."""
    shard, held, forest, data, ids = None, [], None, None, None
    names = ["query", "query_id", "id", "score", "scored"]
    for batch in batches:
        shards, query = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        cuts = np.flatnonzero(np.concatenate([[True], (shards[1:] != shards[:-1]) | ((query[1:] < 0) != (query[:-1] < 0)), [True]])).tolist() if len(shards) else []
        for a, z in zip(cuts, cuts[1:]):
            part = batch.slice(a, z - a)
            if shards[a] != shard:
                shard, held, forest = shards[a], [], None
            if query[a] < 0:
                held.append((np.asarray(part.column(2)), _matrix(part.column(4))))
                continue
            if not held:
                continue
            if forest is None:
                ids, data = (np.concatenate(x) for x in zip(*held, strict=True))
                forest = Forest(data, trees, bits)
            own, rank, x = np.asarray(part.column(2)), int(part.column(3)[0].as_py()), _matrix(part.column(4))
            for at in range(0, len(own), QUERIES):
                out: list[list] = [[], [], [], [], []]
                for q, (found, score) in enumerate(forest.nearest(x[at : at + QUERIES], data, min(rank, len(data)), k + 1, miss), at):
                    scored = len(found)
                    other = ids[found] != own[q]
                    found, score = found[other], score[other]
                    if len(found) > k:  # with all that tie with the last
                        found, score = (v[score >= -np.partition(-score, k - 1)[k - 1]] for v in (found, score))
                    best = np.lexsort((ids[found], -score))[:k]
                    for column, v in zip(out, ([int(query[a + q])] * len(best), [int(own[q])] * len(best), ids[found[best]].tolist(), score[best].tolist(), [scored] * len(best)), strict=True):
                        column += v
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], names)


def search(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", embedding: str = "embedding", miss: float = MISS, shard: int = SHARD, trees: int = TREES, bits: int = BITS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score and scored of the k nearest rows found for every row of df that `queries` holds for.

    scored: how many rows of the shard were compared with the query.
    """
    rows = df.withColumn("__asked", F.coalesce(queries, F.lit(False))).select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("embedding"), "__asked")
    rows = rows.where("id is not null").where(_VALID).withColumn("size", F.size("embedding"))
    most = F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + F.pow(v.cast("double") / most, F.lit(2.0)))
    # the half is for vectors of unit length, which rounding is not to part
    band = F.floor(2 * F.log2(most) + F.log2(norm) + 0.5).cast("int")
    rows = written(rows.withColumn("band", band).withColumn("row", F.monotonically_increasing_id()), "vectors")
    # a row for each length and band that there is
    bands = rows.groupBy("size", "band").agg(F.ceil(F.count("*") / shard).cast("int").alias("parts"))
    bands = written(bands.withColumn("shards", F.sum("parts").over(Window.partitionBy("size"))), "bands")
    number = F.xxhash64("size", "band", "part")
    data = rows.join(bands, ["size", "band"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    data = data.select(number.alias("shard"), F.lit(-1).cast("long").alias("query"), "id", F.lit(0).alias("rank"), "embedding")
    every = bands.select("size", "band", "shards", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    asked = rows.where("__asked").select("size", "row", "id", "embedding").join(every, "size")
    asked = asked.select(number.alias("shard"), F.col("row").alias("query"), "id", (F.ceil(k / F.col("shards")) + 1).cast("int").alias("rank"), "embedding")
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = data.union(asked).repartition(parts, "shard").sortWithinPartitions("shard", "query")
    found = map_batches(dealt, lambda batches: _searched(batches, k, miss, trees, bits), "query long, query_id long, id long, score double, scored long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score", "scored")
