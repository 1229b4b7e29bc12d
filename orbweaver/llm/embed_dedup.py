"""Embedding near-dedup: an exact metric range join by pivots.

Vectors of equal direction and length are made one first. On the unit sphere a cosine of at least c is a distance of at
most e = sqrt(2 - 2c). Pivots are vectors of a sample by hash, each the farthest from those before it, so that clusters get
pivots of their own; every vector lives in the cell of its nearest pivot. By the
triangle inequality a vector v can only have a link into another cell j if d(v, pivot j) - d(v, own pivot) <= 2e and
d(v, pivot j) <= radius of j + e; it is also sent there, to cells of lower number only, so that a pair of two cells meets
once. The distance of v to the plane between the two pivots, which the same inequality bounds, tightens this further.
Cells are joined independently: as products of blocks of BLOCK vectors, each a task of its own, so that no cell is too
large for one task. Of its links a block passes on the number for each vector and a spanning forest, never the pairs.

Cosines are computed in double precision from the vectors as they are; those within 1e-9 of the threshold are computed
again one by one. The result is exact whatever the pivots: they decide the work alone. Cells are meant to have the least
of CELLS vectors with which the sample's vectors go to SENT cells on average, or else the most: in clustered data many
small cells, in data without clusters, where few can be left out, few large ones, and the join is all blocks against all.
There are PIVOTS pivots at most (beyond that cells grow, and with them the blocks of each), so that what is broadcast is
bounded. Vectors of a length that few have need no pivots; those of all such lengths are joined in one plan.

A vector that is null, empty or zero, or holds null, NaN or infinity, links with nothing; so do vectors of different
lengths with each other. Rows with equal ids are rows of their own, and their links count for the id. A null id has
links counted but no component. An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, forest
from .runtime import local_table, map_batches, ship, written

#: Vectors that a cell is meant to have, cells that a vector may go to for it, and pivots at most.
CELLS, SENT, PIVOTS = (512, 2048, 8192), 4.0, 1024
#: Vectors of a block at most, and numbers of its vectors.
BLOCK, BLOCK_NUMBERS = 16384, 1 << 21
#: Vectors that pivots are taken from, at most.
SAMPLE = 4096

_VALID = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    # first by the largest part, as squares of very large or small numbers are out of range
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distinct(df: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """The rows (key, embedding), and a row for each different usable vector: rep (smallest key), n (how many), embedding."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{embedding}`").alias("embedding"))
    usable = rows.where(_VALID)
    return rows, written(usable.groupBy("embedding").agg(F.min("key").alias("rep"), F.count("*").alias("n")).withColumn("v", F.xxhash64("embedding")), "vectors")


def _goes(far: np.ndarray, between: np.ndarray, radius: np.ndarray, distance: float) -> np.ndarray:
    """Which cells each vector goes to, from its distances to the pivots, theirs to each other and the cells' radii."""
    own, each = far.argmin(1), np.arange(len(far))
    near = far[each, own]
    slack = 1e-7  # more than rounding can add
    go = (far - near[:, None] <= 2 * distance + slack) & (far <= radius + distance + slack) & (np.arange(far.shape[1]) < own[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (far**2 - near[:, None] ** 2) / (2 * between[own])
    # between pivots of nearly one direction the plane is a matter of rounding
    go &= ~((plane > distance + slack) & (between[own] > 1e-3))
    go[each, own] = True
    return go


def _far(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))


def _pivots(vectors: DataFrame, size: int, count: int, cells: tuple[int, ...], most: int, distance: float) -> np.ndarray:
    """Unit vectors of one length: as many as the cell size asks for that suits a sample."""
    share = min(1.0, 2 * SAMPLE / count)
    few = vectors.where((F.size("embedding") == size) & (F.pmod(F.col("v"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1))
    sample = _unit(np.array([r["embedding"] for r in few.orderBy("v", "rep").limit(SAMPLE).collect()], np.float64))
    wanted = [max(1, min(most, -(-count // c), len(sample))) for c in cells]
    chosen, nearest = [0], _far(sample, sample[:1])[:, 0]
    while len(chosen) < wanted[0]:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _far(sample, sample[chosen[-1:]])[:, 0])
    for n in wanted:  # the first n are what n alone would be
        points = sample[chosen[:n]]
        far = _far(sample, points)
        own = far.argmin(1)
        radius = np.full(n, -1.0)
        np.maximum.at(radius, own, far[np.arange(len(far)), own])
        if n == wanted[-1] or _goes(far, _far(points, points), radius, distance).sum(1).mean() <= SENT:
            return points


def _dealt(vectors: DataFrame, size: int, pivots: np.ndarray, distance: float, radius: np.ndarray | None) -> DataFrame:
    """A row for each vector and cell it goes to: cell, inner (it lives there), and its distance there. radius: of the cells; without it only own cells."""
    between = _far(pivots, pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _far(_unit(_matrix(batch.column(0))), pivots)
            own = far.argmin(1)
            rows, cells = (np.arange(len(far)), own) if radius is None else np.nonzero(_goes(far, between, radius, distance))
            columns = [pa.array(cells.astype(np.int32)), pa.array(cells == own[rows]), pa.array(far[rows, cells])]
            yield pa.RecordBatch.from_arrays([*columns, *(c.take(pa.array(rows)) for c in batch.columns[1:]), *([batch.column(0).take(pa.array(rows))] if radius is not None else [])], names)

    names = ["cell", "inner", "far", "v", "rep", "n", *(["embedding"] if radius is not None else [])]
    kind = vectors.schema["embedding"].dataType.simpleString()
    return map_batches(vectors.where(F.size("embedding") == size).select("embedding", "v", "rep", "n"), run, "cell int, inner boolean, far double, v long, rep long, n long" + f", embedding {kind}" * (radius is not None))


def _blocked(dealt: DataFrame, counts: dict[tuple[int, bool], int], block: int) -> DataFrame:
    """Rows of dealt, one for each product of two blocks that the row takes part in: cell, left and right block, side."""
    cells = sorted({cell for cell, _ in counts})
    blocks = local_table(dealt.sparkSession, [(c, *(-(-counts.get((c, inner), 0) // block) for inner in (True, False))) for c in cells], "cell int, ni int, no int")
    # a row for each pivot
    rows = dealt.join(F.broadcast(blocks), "cell").withColumn("b", F.pmod(F.xxhash64("v", "rep"), F.when(F.col("inner"), F.col("ni")).otherwise(F.col("no"))).cast("int"))
    pair = lambda left, right, side: F.struct(left.cast("int").alias("left"), right.cast("int").alias("right"), F.lit(side).alias("side"))
    upto = lambda a, z: F.when(z >= a, F.sequence(a.cast("int"), z.cast("int"))).otherwise(F.array().cast("array<int>"))
    zero, one = F.lit(0), F.lit(1)
    # inner block b meets inner blocks from b on, and all outer blocks (numbered after the inner ones)
    as_left = F.transform(upto(F.col("b"), F.col("ni") + F.col("no") - one), lambda k: pair(F.col("b"), k, 0))
    as_right = F.transform(upto(zero, F.col("b") - one), lambda k: pair(k, F.col("b"), 1))
    as_outer = F.transform(upto(zero, F.col("ni") - one), lambda k: pair(k, F.col("ni") + F.col("b"), 1))
    meets = F.when(F.col("inner"), F.concat(as_left, as_right)).otherwise(as_outer)
    return rows.select("cell", F.explode(meets).alias("p"), "rep", "n", "embedding").select("cell", "p.left", "p.right", "p.side", "rep", "n", "embedding")


def _product(table: pa.Table, least: float, same: bool) -> pa.Table:
    """(rep, links, to): the weights that each vector links to in this product, and a spanning forest of the links."""
    side = np.asarray(table["side"])
    rep, n, x = np.asarray(table["rep"].to_numpy()), np.asarray(table["n"]), _matrix(table["embedding"])
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    norm = np.sqrt((x * x).sum(1))
    left = np.flatnonzero(side == 0)
    right = left if same else np.flatnonzero(side == 1)
    links, parent = np.zeros(len(rep), np.int64), None
    for k in range(0, len(left), 512):
        a = left[k : k + 512]
        cosine = (x[a] @ x[right].T) / (norm[a, None] * norm[right])
        i, j = np.nonzero(cosine >= least - 1e-9)
        value, i, j = cosine[i, j], a[i], right[j]
        if same:
            good = i < j
            value, i, j = value[good], i[good], j[good]
        close = np.flatnonzero(np.abs(value - least) < 1e-9)
        for c in close.tolist():
            u, v = x[i[c]], x[j[c]]
            value[c] = float(np.dot(u, v)) / float(np.sqrt(np.dot(u, u) * np.dot(v, v)))
        good = value >= least
        i, j = i[good], j[good]
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        parent = forest(len(rep), i, j, parent)
    linked = np.flatnonzero(links)
    return pa.table({"rep": pa.array(rep[linked]), "links": pa.array(links[linked]), "to": pa.array(rep[parent[linked]] if len(linked) else np.zeros(0, np.int64))})


def near_links(vectors: DataFrame, least: float, cells: tuple[int, ...] = CELLS, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """(rep, links, to) from all products of blocks: links add up over products; rep and to are linked or equal."""
    ship(vectors.sparkSession)
    distance = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def joined(key: tuple, table: pa.Table) -> pa.Table:
        return _product(table, least, key[1].as_py() == key[2].as_py())

    sized = vectors.withColumn("size", F.size("embedding"))
    sizes = written(sized.groupBy("size").agg(F.count("*").alias("count")), "sizes")
    # a cell, and a block, for each length that few have
    few = sizes.where(F.col("count") <= cells[-1]).select("size")
    small = sized.join(few, "size").select(F.col("size").alias("cell"), F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("side"), "rep", "n", "embedding")
    out = small.groupBy("cell", "left", "right").applyInArrow(joined, "rep long, links long, to long")
    for r in sizes.where(F.col("count") > cells[-1]).orderBy("size").collect():
        points = _pivots(vectors, r["size"], r["count"], cells, pivots, distance)
        radius = np.full(len(points), -1.0)
        if len(points) > 1:
            for c in _dealt(vectors, r["size"], points, distance, None).groupBy("cell").agg(F.max("far").alias("far")).collect():
                radius[c["cell"]] = c["far"]
        dealt = written(_dealt(vectors, r["size"], points, distance, radius), "cells")
        counts = {(c["cell"], c["inner"]): c["count"] for c in dealt.groupBy("cell", "inner").count().collect()}
        own = max(1, min(block, BLOCK_NUMBERS // r["size"]))
        out = out.union(_blocked(dealt, counts, own).groupBy("cell", "left", "right").applyInArrow(joined, "rep long, links long, to long"))
    return out


def dedup(df: DataFrame, key: str = "vec_id", embedding: str = "embedding", least: float = 0.95, cells: tuple[int, ...] = CELLS, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """Per row: key, n_links (other vectors linked directly), component_id (smallest key reachable), kept (it is that key)."""
    rows, vectors = distinct(df, key, embedding)
    # a vector without any key still has links to count: it stands under a number of its own
    named = vectors.withColumn("rep", F.coalesce("rep", F.monotonically_increasing_id() - F.lit(1 << 62)))
    named = written(named, "named")
    links = written(near_links(named, least, cells, block, pivots), "links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    groups = named.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    groups = written(groups.select(F.col("embedding").alias("vector"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component")), "groups")
    # null and unusable vectors find no group and stand alone
    out = rows.withColumn("usable", F.expr(_VALID)).join(groups, F.col("usable") & (F.col("embedding") == F.col("vector")), "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("key") == component).alias("kept"))


def oracle(least: float = 0.95) -> str:
    """DuckDB SQL for the rows of dedup() over embeddings: all pairs, and components by walking links."""
    bad = "x IS NULL OR isnan(x) OR isinf(x)"
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: {bad})) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, a.e AS x, b.e AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
l AS (SELECT a, b FROM pairs WHERE list_cosine_similarity(x, y) >= {least}),
r(node, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.node = l.a),
c AS (SELECT node, min(c) AS c FROM r GROUP BY node), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, vec_id = c.c AS kept FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
