"""Closure by strata: rules told apart by the sorts of vertices they can join, each closed once all it reads is closed.

Two ends of labels (the sources of a, the targets of d) are of one sort if a vertex has both; vertices without edges are a
sort of their own. From the sorts alone it follows which of a rule's cases can hold at all, so that a label that leads
back to itself by its name often does not by its sorts. A label that does not is one join and one distinct; one that only
goes on from itself is closed by powers; only the others take passes. Labels that are just (v, v) at every vertex of a
sort drop out of joins. Everything but the sorts is known on the driver from the rules.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.grammar import Grammar
from ..sources.tables import drop_written
from ..sources.tables import written as _written
from .graph import EDGE, LabeledGraph

#: Labels of a grammar, each with a bit for its sources and one for its targets.
LABELS = 31

#: Joins hash one side where none of its partitions has more bytes than this, and sort both otherwise.
HASHED = 16 << 20

Symbol = tuple[str, int, int]
Bodies = dict[Symbol, list[tuple[Symbol, ...]]]


def cases(grammar: Grammar, given: dict[str, tuple[int, int]], sorts: list[int]) -> Bodies:
    """The rules by the sorts of their ends: what each (label, sort, sort) may be made of. given: the sorts of the graph's labels; sorts: all that have vertices."""
    kinds: dict[str, set[tuple[int, int]]] = {x: {given[x]} if x in given else set() for x in grammar.labels}

    def of(r) -> list[tuple[Symbol, tuple[Symbol, ...]]]:
        if r.rhs1 is None:
            return [((r.lhs, k, k), ()) for k in sorts]
        if r.rhs2 is None:
            return [((r.lhs, *k), ((r.rhs1, *k),)) for k in sorted(kinds[r.rhs1])]
        return [((r.lhs, s, z), ((r.rhs1, s, y), (r.rhs2, y, z))) for s, y in sorted(kinds[r.rhs1]) for x, z in sorted(kinds[r.rhs2]) if x == y]

    grown = True
    while grown:
        grown = False
        for r in grammar.rules:
            new = {head[1:] for head, _ in of(r)} - kinds[r.lhs]
            kinds[r.lhs] |= new
            grown |= bool(new)
    out: Bodies = {}
    for r in grammar.rules:
        for head, body in of(r):
            out.setdefault(head, []).append(body)
    return out


def without_loops(bodies: Bodies, given: set[Symbol]) -> Bodies:
    """The same without symbols that are (v, v) for each vertex of a sort and nothing else; all vertices must be declared."""
    same: set[Symbol] = set()
    while more := {h for h, own in bodies.items() if h not in given | same and all(x in same for body in own for x in body)}:
        same |= more
    out: Bodies = {}
    for head, own in bodies.items():
        short = dict.fromkeys(tuple(x for x in body if x not in same) for body in own)
        out[head] = [body for body in short if body != (head,)]
    return out


def strata(bodies: Bodies, wanted: set[str] | None) -> list[list[Symbol]]:
    """The heads that matter, those that need each other together, after all that they need."""
    needs: dict[Symbol, set[Symbol]] = {h: {x for body in own for x in body if x in bodies} for h, own in bodies.items()}

    def reached(start: set[Symbol]) -> set[Symbol]:
        seen, left = set(start), list(start)
        while left:
            new = needs[left.pop()] - seen
            seen |= new
            left += new
        return seen

    live = reached({h for h in bodies if wanted is None or h[0] in wanted})
    below = {h: reached(needs[h]) for h in bodies if h in live}
    groups, done = [], set()
    for h in sorted(below, key=lambda h: len(below[h] | {h})):
        if h not in done:
            groups.append([h, *(x for x in below if x != h and x in below[h] and h in below[x])])
            done.update(groups[-1])
    return groups


def written(df: DataFrame, name: str) -> DataFrame:
    """A written table; sides of joins that are small in all partitions are hashed, not sorted."""
    conf, before = df.sparkSession.conf, {}
    for key in ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"):
        before[key] = conf.get(key, None)
        conf.set(key, HASHED)
    try:
        return _written(df, name)
    finally:
        for key, value in before.items():
            conf.set(key, value) if value is not None else conf.unset(key)


def closed(graph: LabeledGraph, grammar: Grammar, wanted: list[str] | None, counted: Callable[[int, float], None], passes: Callable) -> DataFrame:
    """All edges of the closure. passes: gives (symbol -> edges) of symbols that need each other, from what they start with and need."""
    began = time.perf_counter()
    edges = written(graph.edges.select(*EDGE).distinct(), "edges")
    numbers = {r["label"]: r["n"] for r in edges.where(F.col("label").isin(grammar.labels)).groupBy("label").agg(F.count("*").alias("n")).collect()}
    counted(edges.count(), began)
    began = time.perf_counter()
    vertices, given, held, whole = _sorts(edges, graph if grammar.epsilon else None, [x for x in grammar.labels if x in numbers])
    bodies = cases(grammar, given, sorted(held))
    start = {(x, *kind) for x, kind in given.items()}
    if whole:
        bodies = without_loops(bodies, start)
    found: dict[Symbol, DataFrame] = {x: edges.where(F.col("label") == x[0]).select("src", "dst") for x in start}
    count: dict[Symbol, int] = {x: numbers[x[0]] for x in start}

    def part(body: tuple[Symbol, ...], sort: int) -> DataFrame:
        if not body:
            return vertices.where((F.col("sort") == sort) & F.col("declared")).select(F.col("id").alias("src"), F.col("id").alias("dst"))
        return found[body[0]] if len(body) == 1 else _joined(found[body[0]], found[body[1]])

    def base(head: Symbol, own: list[tuple[Symbol, ...]]) -> DataFrame | None:
        parts = ([found[head]] if head in start else []) + [part(body, head[1]) for body in own]
        if not parts:
            return None
        if len(parts) == 1 and (not own or len(own[0]) < 2):
            return parts[0]
        return written(reduce(DataFrame.union, parts).distinct(), "stratum")

    # closures of a label's edges by their ends: those of its inverses, if it has no others, are the same turned
    turned = {x: y for pair in graph.inverses if pair[0] in given and numbers.get(pair[0]) == numbers.get(pair[1]) for x, y in (pair, pair[::-1])}
    paths: dict[tuple[str, int], DataFrame] = {}
    heads = []
    for group in strata(bodies, None if wanted is None else set(wanted)):
        head, began = group[0], time.perf_counter()
        again = [body for body in bodies[head] if set(body) & set(group)]
        first = [body for body in bodies[head] if body not in again]
        if len(group) == 1 and (not again or len(again) == 1 and sum(x == head for x in again[0]) == 1):
            own = base(head, first)
            if again and own is not None:
                step, loops = found[again[0][again[0][0] == head]], first == [()] and head not in start
                label = next((x[0] for x in start if loops and found[x] is step), None)
                if (other := paths.get((turned.get(label), head[1]))) is not None:
                    own = other.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
                else:
                    own = _powers(own, step, again[0][0] == head, loops)
                    if label is not None:
                        paths[label, head[1]] = own
            if own is None:
                own = edges.limit(0).select("src", "dst")
            n = held[head[1]] if first == [()] and not again and head not in start else count[first[0][0]] if len(first) == 1 and len(first[0]) == 1 and not again and head not in start else own.count()
            counted(n - count.get(head, 0), began)
            found[head], count[head] = own, n
        else:
            outside = {x for h in group for body in bodies[h] for x in body} - set(group)
            begin = {h: base(h, [body for body in bodies[h] if not set(body) & set(group)]) for h in group} | {x: found[x] for x in outside}
            rules = {h: [body for body in bodies[h] if set(body) & set(group)] for h in group}
            made = passes({x: df for x, df in begin.items() if df is not None}, rules, sum(count.get(h, 0) for h in group), began)
            for h in group:
                found[h], count[h] = made[h], made[h].count()
        heads += group
    over = {h[0] for h in heads if h in start}
    kept = edges.where(F.coalesce(~F.col("label").isin(sorted(over)), F.lit(True)))
    return reduce(DataFrame.union, [kept, *(found[h].select("src", F.lit(h[0]).alias("label"), "dst") for h in heads)])


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("src", F.col("dst").alias("y")).join(right.select(F.col("src").alias("y"), "dst"), "y").select("src", "dst")


def _sorts(edges: DataFrame, graph: LabeledGraph | None, labels: list[str]) -> tuple[DataFrame | None, dict[str, tuple[int, int]], dict[int, int], bool]:
    """(id, sort, declared) of all vertices, each label's two sorts, the declared vertices of each sort, and whether all are declared.

    graph: what declares vertices, None if none matter. Where they are those of its edges, these are not made again.
    """
    touched = graph is not None and graph.touched
    bit = lambda at: reduce(lambda c, k: c.when(F.col("label") == labels[k], F.lit(1 << 2 * k + at)), range(len(labels)), F.when(F.lit(False), F.lit(0))).cast("long")
    ends = (edges if touched else edges.where(F.col("label").isin(labels))).select(F.explode(F.array(F.struct(F.col("src").alias("id"), bit(0).alias("m")), F.struct(F.col("dst").alias("id"), bit(1).alias("m")))).alias("e"))
    masks = ends.groupBy("e.id").agg(F.bit_or("e.m").alias("mask"))
    if touched:
        masks = masks.withColumn("declared", F.col("id").isNotNull())
    elif graph is not None:
        masks = masks.join(graph.vertices.select("id", F.lit(True).alias("declared")), "id", "full")
    masks = written(masks, "vertices")
    if touched:  # null is a vertex, but none that edges meet at
        masks = masks.union(masks.where("id is null").select("id", F.lit(None).cast("long"), F.lit(True)))
    bits = range(2 * len(labels))
    met = masks.agg(*(F.bit_or(F.when(F.col("mask").bitwiseAND(F.lit(1 << k).cast("long")) != 0, F.col("mask"))).alias(f"b{k}") for k in bits)).first() if labels else []
    groups: list[int] = []
    for m in met:
        touching = [g for g in groups if g & m]
        groups = [g for g in groups if not g & m] + [reduce(int.__or__, touching, m)]
    sort_of = lambda k: next(n for n, g in enumerate(groups) if g >> k & 1)
    given = {x: (sort_of(2 * k), sort_of(2 * k + 1)) for k, x in enumerate(labels)}
    if graph is None:
        return None, given, {}, True
    sort = reduce(lambda c, n: c.when(F.col("mask").bitwiseAND(F.lit(groups[n]).cast("long")) != 0, F.lit(n)), range(len(groups)), F.when(F.col("mask").isNull(), F.lit(-1)))
    sorted_ = masks.select("id", sort.alias("sort"), F.coalesce("declared", F.lit(False)).alias("declared"))
    held = sorted_.groupBy("sort", "declared").agg(F.count("*").alias("n")).collect()
    return sorted_, given, {r["sort"]: r["n"] for r in held if r["declared"]}, all(r["declared"] for r in held)


def _powers(own: DataFrame, step: DataFrame, onward: bool, loops: bool) -> DataFrame:
    """own, and all that goes on from it (or leads to it) by steps: what is known goes on by paths of just 2^k steps.

    loops: own is (v, v) at all vertices, so that own and the steps themselves start.
    """
    def longer(power: DataFrame) -> DataFrame:
        return written(_joined(power, power).distinct(), "power")

    tables, power = [own], step
    if loops:
        tables = [written(own.union(step).distinct(), "stratum")]
        power = longer(step)
    while not power.isEmpty():
        known = reduce(DataFrame.union, tables)
        more = _joined(known, power) if onward else _joined(power, known)
        # of both together those that are not known: neither is sorted
        both = more.withColumn("known", F.lit(False)).union(known.withColumn("known", F.lit(True)))
        new = written(both.groupBy("src", "dst").agg(F.bool_or("known").alias("known")).where("not known").select("src", "dst"), "stratum")
        if new.isEmpty():
            break
        tables.append(new)
        before, power = power, longer(power)
        if before is not step:
            drop_written(before)
    if power is not step:
        drop_written(power)
    return reduce(DataFrame.union, tables)
