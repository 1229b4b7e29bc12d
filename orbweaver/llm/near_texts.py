"""Near copies of texts by long SimHash fingerprints: a byte-position inverted index, count filtering, exact verification.

A text's fingerprint has WORDS words of 64 bits, 8 * WORDS positional bytes: each bit is 1 where over half of its
different shingles' words have it, a shingle's words following from its XXH64 value (seed 42). Texts of a shingle
similarity of 0.8 share a fourth of the bytes, others nearly none. The index has postings of four positions and their
bytes, for KEYS choices of four positions, each position in equally many. Of the pairs that meet in a posting the shared
positional bytes are tallied; pairs that reach SHARED, and differ in BITS bits at most, are retained (99.8 % of pairs of
0.8), and verified: linked if their shingle sets, taken anew from the texts, have the similarity. So nothing below it is
ever linked. Of pairs at 0.8 some 95 % meet, of those at 0.85 over 99.9 % (simulated; README).

Texts of equal sets are made one first. The index is made of TURN choices at a time, and its shuffle files go before the
next are dealt, so that the disk never holds it whole. Entries are dealt by hash over tasks of bounded size, packed as
arrays: six to fifteen bytes an entry, the more the fewer a text has for one task; of a posting's texts in one block of a
table only the first goes on, with the others noted as met by it, so that a hot posting does not gather. What turns before
have found for a text goes with it, and a task names it again only for a smaller one. A first round joins each text with
the smallest one that it met so. Then the index is made again, for texts that met others, with their
components: it gives the entries of postings that hold several components, and only these are dealt with fingerprints, to
be compared in blocks; pairs in one component already are passed over. The second round takes each text's nearest partner,
the third every pair that is retained, in the first posting that it shares: components only grow, so it has the entries
it needs among the second's. So of any two texts that meet and end in different components the pair was tallied and
verified, while a large group of copies takes a few pairs of each text, not all its pairs.

Words are what stands between ASCII white space, A-Z in lower case; a text of fewer words than a shingle has is one
shingle. Null, empty and blank texts have the empty set and are copies of each other. Rows with equal keys go together.
Other columns are kept, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .runtime import drop_written, local_table, map_batches, written
from .simhash import majority, shingle_hashes, tally

#: Words of a fingerprint, choices of four of its positions, and pairs retained: least shared bytes, most differing bits.
WORDS, KEYS, SHARED, BITS = 16, 960, 20, 192
#: Texts of a sender's block; index entries of a task, and of one that compares, where each may bring a fingerprint; choices at a time.
BLOCK, ENTRIES, COMPARED, TURN = 4096, 1 << 20, 1 << 16, 120
#: Pairs compared at a time.
_PAIRS = 1 << 15


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The different hashes of the text's shingles, in order."""
    return np.unique(shingle_hashes(text, words))


@lru_cache(4)
def choices(words: int = WORDS, keys: int = KEYS) -> np.ndarray:
    """Four positions for each key: permutations of all positions, cut into fours."""
    draw, n = np.random.default_rng(0), 8 * words
    return np.concatenate([draw.permutation(n).reshape(-1, 4) for _ in range(-(-4 * keys // n))])[:keys]


def entries(prints: np.ndarray, words: int = WORDS, keys: int = KEYS, some: range | None = None) -> np.ndarray:
    """For each fingerprint (a row of bytes) the hash of each choice (of some of them) with the bytes there."""
    some = range(keys) if some is None else some
    four = np.take(prints, choices(words, keys)[some.start : some.stop].ravel(), 1).view(np.uint32).astype(np.uint64)
    x = (four | np.arange(some.start, some.stop, dtype=np.uint64) << np.uint64(32)) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _prints(df: DataFrame, words: int, size: int) -> DataFrame:
    """(key, digest of the set, fingerprint) of every row of (key, text); the fingerprint of the empty set is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column(1).to_pylist()]
            columns = [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array([majority(x, size).tobytes() if len(x) else None for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "digest", "print"])

    return map_batches(df, run, "key long, digest binary, print binary")


def _bytes(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


_BLOB = ["route", "texts", "counts", "low", "high", "extra"]
_BLOBS = "route int, texts binary, counts binary, low binary, high binary, extra binary"
#: The bits of an entry that say its posting, besides its first route.
_OWN = np.uint64((1 << 40) - 1)


def _dealt(batches: Iterator[pa.RecordBatch], routes: int, keys: int, some: range, labelled: bool) -> Iterator[pa.RecordBatch]:
    """Rows (rep, print, component) as blobs of the index entries of some choices, some for each route.

    Unless `labelled`, where components go with the texts, the third column is the smallest text met in turns before (null:
    none) and goes with those that have one; of a posting's texts in this block only the first goes to its route, and the
    others' pairs with it that say more than was known go as a blob of pairs (counts is null).
    """
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            rep, prints, label = np.asarray(part.column(0)), _bytes(part.column(1)), np.asarray(part.column(2).fill_null(0))
            n, has = len(rep), np.asarray(part.column(2).is_valid())
            h = entries(prints, prints.shape[1] // 8, keys, some).ravel()
            text = np.repeat(np.arange(n, dtype=np.int32), len(some))
            if not labelled:
                order = np.argsort(h, kind="stable")
                new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
                if not new.all():
                    first = order[np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))][~new]
                    a, b = _closer(*_least(rep[text[first]], rep[text[order[~new]]]), rep[has], label[has])
                    if len(a):
                        yield _blob(int(rep[0] % routes), a.tobytes(), None, b.tobytes(), b"", b"")
                    stay = np.ones(len(h), bool)
                    stay[order[~new]] = False
                    h, text = h[stay], text[stay]
                del order, new
            route = ((h >> np.uint64(40)) % np.uint64(routes)).astype(np.int32)
            extra = (lambda who: label[who].tobytes()) if labelled else lambda who: np.packbits(has[who]).tobytes() + label[who[has[who]]].tobytes()
            yield from _packed(route, text, h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint8), rep, extra)


def _dealt_again(batches: Iterator[pa.RecordBatch], routes: int) -> Iterator[pa.RecordBatch]:
    """Rows (rep, print, component, postings) as blobs of these entries with the texts' components and fingerprints."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            counts, h = np.asarray(part.column(3).value_lengths()), np.asarray(part.column(3).flatten()).view(np.uint64)
            extra = np.concatenate([np.asarray(part.column(2))[:, None].view(np.uint8), _bytes(part.column(1))], 1)
            route = ((h & _OWN) % np.uint64(routes)).astype(np.int32)
            yield from _packed(route, np.repeat(np.arange(len(counts), dtype=np.int32), counts), h, np.zeros(len(h), np.uint8)[:0], np.asarray(part.column(0)), lambda who: extra[who].tobytes())


def _packed(route: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, rep: np.ndarray, extra: Callable[[np.ndarray], bytes]) -> Iterator[pa.RecordBatch]:
    """Entries in the order of their texts, as a blob for each route; extra gives what goes with some of the texts."""
    order = np.argsort(route, kind="stable")  # by text within a route
    low, text, route = low[order], text[order], route[order]
    high = high[order] if len(high) else high
    cuts = np.flatnonzero(np.concatenate([[True], route[1:] != route[:-1], [True]])).tolist() if len(route) else []
    for a, z in zip(cuts, cuts[1:]):
        own = text[a:z]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        who = own[starts]
        counts = np.diff(np.concatenate([starts, [z - a]])).astype(np.uint16)
        yield _blob(int(route[a]), rep[who].tobytes(), counts.tobytes(), low[a:z].tobytes(), high[a:z].tobytes(), extra(who))


def _blob(route: int, *parts: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([route], pa.int32()), *(pa.array([x], pa.binary()) for x in parts)], _BLOB)


def _postings(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the entries that has those of two or more of a posting together; the postings' firsts in it, and sizes."""
    order = np.argsort(h, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
    sizes = np.diff(np.concatenate([cuts, [len(h)]]))
    several = sizes > 1
    order = order[np.repeat(several, sizes)]
    sizes = sizes[several]
    return order, np.cumsum(sizes) - sizes, sizes


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray, bytes]]:
    for batch in batches:
        for route, texts, counts, low, high, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if counts is None:
                yield route, np.frombuffer(texts, np.int64), None, np.frombuffer(low, np.int64), np.zeros(0, np.uint64), b""
            else:
                h = np.uint64(route << 40) | np.frombuffer(high, np.uint8).astype(np.uint64) << np.uint64(32) | np.frombuffer(low, np.uint32)
                yield route, np.frombuffer(texts, np.int64), np.frombuffer(counts, np.uint16), h, h, extra


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of texts the smallest other one (or itself) that each text met, and that text."""
    x, y = np.concatenate([np.minimum(a, b), np.minimum(a, b)]), np.concatenate([a, b])
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    new = np.concatenate([[True], y[1:] != y[:-1]])[: len(y)]
    return x[new], y[new]


def _closer(a: np.ndarray, b: np.ndarray, texts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) where b is none of the texts, or a smaller than what is known of it."""
    if not len(texts):
        return a, b
    texts, place = np.unique(texts, return_index=True)
    at = np.minimum(np.searchsorted(texts, b), len(texts) - 1)
    says = (texts[at] != b) | (a < known[place][at])
    return a[says], b[says]


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): for each text b of a task's postings of several the smallest text a that is first in one of them, b itself perhaps.

    What turns before have found as small goes no more, so a text of a large group is not named by every task of every turn.
    """
    none = np.zeros(0, np.int64)
    h, rep, a, b, old, known = [np.zeros(0, np.uint64)], [none], [none], [none], [none], [none]
    for _, texts, counts, own, _, extra in _blobs(batches):
        if counts is None:
            a.append(texts)
            b.append(own)
        else:
            h.append(own)
            rep.append(np.repeat(texts, counts))
            flags = -(-len(texts) // 8)
            old.append(texts[np.unpackbits(np.frombuffer(extra[:flags], np.uint8), count=len(texts)).view(bool)])
            known.append(np.frombuffer(extra[flags:], np.int64))
    reps = np.concatenate(rep)
    order, first, sizes = _postings(np.concatenate(h))
    reps = reps[order]
    if len(first):
        a.append(np.repeat(np.minimum.reduceat(reps, first), sizes))
        b.append(reps)
    x, y = _closer(*_least(np.concatenate(a), np.concatenate(b)), np.concatenate(old), np.concatenate(known))
    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, postings): the entries of a task's postings that hold several components, by text."""
    h, rep, label = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, texts, counts, own, _, extra in _blobs(batches):
        h.append(own)
        rep.append(np.repeat(texts, counts))
        label.append(np.repeat(np.frombuffer(extra, np.int64), counts))
    hs, reps, labels = np.concatenate(h), np.concatenate(rep), np.concatenate(label)
    del h, rep, label
    order, first, sizes = _postings(hs)
    if not len(first):
        return
    labels = labels[order]
    order = order[np.repeat(np.minimum.reduceat(labels, first) != np.maximum.reduceat(labels, first), sizes)]
    order = order[np.argsort(reps[order], kind="stable")]
    hs, reps = hs[order], reps[order]
    starts = np.flatnonzero(np.concatenate([[True], reps[1:] != reps[:-1]]))[: len(reps)]
    for at in range(0, len(starts), BLOCK):
        ends = np.concatenate([starts, [len(reps)]])[at : at + BLOCK + 1]
        lists = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), pa.array(hs[ends[0] : ends[-1]].view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(reps[ends[:-1]]), lists], ["rep", "postings"])


def _apart(batches: Iterator[pa.RecordBatch], keys: int, shared: int, bits: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """(a, b): retained pairs in different components of a task's postings, each in the first posting it shares; with `nearest` each text's with fewest differing bits."""
    hs, who, reps, labels, prints, n = [], [], [], [], [], 0
    for batch in batches:
        for blob, own, entry, more in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 5)), strict=True):
            texts, extra = np.frombuffer(blob, np.int64), np.frombuffer(more, np.uint8)
            extra = extra.reshape(len(texts), -1)
            hs.append(np.frombuffer(entry, np.uint64))
            who.append(np.repeat(np.arange(n, n + len(texts)), np.frombuffer(own, np.uint16)))
            reps.append(texts)
            labels.append(extra[:, :8].copy().view(np.int64)[:, 0])
            prints.append(extra[:, 8:])
            n += len(texts)
    if not n:
        return
    # a text has a place for each blob that names it, and one of all in what follows
    rep, place, number = np.unique(np.concatenate(reps), return_index=True, return_inverse=True)
    label, bytes_ = np.concatenate(labels)[place], np.concatenate(prints)[place]
    text, h, n = number[np.concatenate(who)], np.concatenate(hs), len(rep)
    del hs, who, reps, labels, prints
    order, first, sizes = _postings(h)
    text, h, word = text[order], h[order], bytes_.view(np.uint64)
    four, own = choices(bytes_.shape[1] // 8, keys), h & _OWN

    best = np.full(n, np.iinfo(np.int64).max)  # of each text the fewest differing bits, and with whom

    def retained(x: np.ndarray, y: np.ndarray, posting: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of the pairs x, y of members of that posting; x and y are texts, posting places in h."""
        apart = np.flatnonzero(label[x] != label[y])
        differ = np.bitwise_count(word[x[apart]] ^ word[y[apart]]).sum(1, dtype=np.int64)
        apart, differ = apart[differ <= bits], differ[differ <= bits]
        enough = tally(bytes_[x[apart]], bytes_[y[apart]]) >= shared
        apart, differ = apart[enough], differ[enough]
        x, y = x[apart], y[apart]
        if nearest:
            np.minimum.at(best, x, differ << 40 | y)
            np.minimum.at(best, y, differ << 40 | x)
        elif len(x):
            first_shared = (bytes_[x] == bytes_[y])[:, four].all(2).argmax(1)
            met = entries(bytes_[x], bytes_.shape[1] // 8, keys)[np.arange(len(x)), first_shared] & _OWN
            x, y = (rep[v[met == own[posting[apart]]]] for v in (x, y))
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(np.zeros(len(x), np.int64))], ["a", "b", "differ"])

    for size in np.unique(sizes).tolist():
        at = first[sizes == size]
        if size <= 64:  # many small postings at a time
            i, j = np.triu_indices(size, 1)
            for k in range(0, len(at), step := max(1, _PAIRS // len(i))):
                some = at[k : k + step, None]
                yield from retained(text[(some + i).ravel()], text[(some + j).ravel()], np.repeat(some[:, 0], len(i)))
        else:
            for k in at.tolist():
                member = text[k : k + size]
                named, number = np.unique(label[member], return_inverse=True)
                if len(named) > 1:
                    outside = member[number != np.bincount(number).argmax()]
                    for row in range(0, len(outside), step := max(1, _PAIRS // size)):
                        x, y = (v.ravel() for v in np.meshgrid(outside[row : row + step], member, indexing="ij"))
                        yield from retained(x, y, np.full(len(x), k))
    if nearest and len(found := np.flatnonzero(best < np.iinfo(np.int64).max)):
        # the best of all tasks is taken later
        x, y = rep[found], rep[best[found] & (1 << 40) - 1]
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(best[found] >> 40)], ["a", "b", "differ"])


def _index(texts: DataFrame, count: int, keys: int, some: range, labelled: bool) -> DataFrame:
    """_dealt() of (rep, print, component), by route: as many routes as keep a task's entries bounded."""
    parts = max(1, -(-count * len(some) // ENTRIES), 1 if labelled else int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blobs = map_batches(texts.select("rep", "print", "component"), lambda batches: _dealt(batches, parts, keys, some, labelled), _BLOBS)
    return blobs.repartition(parts, "route")


def _turns(keys: int) -> list[range]:
    """The choices of each turn: only one turn's index is on the disks at a time."""
    return [range(k, min(k + TURN, keys)) for k in range(0, keys, TURN)]


def _met(texts: DataFrame, count: int, keys: int) -> DataFrame:
    """(b, a): every text of (rep, print) that shares a posting, with the smallest that it met in one (itself perhaps), written."""
    met = local_table(texts.sparkSession, [], "b long, a long")
    for some in _turns(keys):
        now = texts.join(met.select(F.col("b").alias("rep"), F.col("a").alias("component")), "rep", "left")
        found = map_batches(_index(now, count, keys, some, False), _meetings, "a long, b long")
        before, met = met, written(met.union(found.select("b", "a")).groupBy("b").agg(F.min("a").alias("a")), "met")
        drop_written(before)
    return met


def _tallied(pairs: DataFrame, same: DataFrame, shared: int, bits: int) -> DataFrame:
    """(a, b, differ): the pairs whose fingerprints share enough positional bytes and differ in few enough bits."""
    own = lambda name, value: same.select(F.col("rep").alias(name), F.col("print").alias(value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = _bytes(batch.column(2)), _bytes(batch.column(3))
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            kept = pa.array((tally(x, y) >= shared) & (differ <= bits))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(1).filter(kept), pa.array(differ).filter(kept)], ["a", "b", "differ"])

    both = pairs.select("a", "b").hint("merge").join(own("a", "x"), "a").join(own("b", "y"), "b")
    return map_batches(both.select("a", "b", "x", "y"), run, "a long, b long, differ long")


def _sets(df: DataFrame, words: int) -> DataFrame:
    """(rep, shingles) of every row of (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words).view(np.int64) for t in batch.column(1).to_pylist()], pa.list_(pa.int64()))], ["rep", "shingles"])

    return map_batches(df, run, "rep long, shingles array<long>")


def _alike(pairs: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b), of a written table, whose texts' sets have that similarity, written; only their texts are looked at."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    few = docs.join(ends, F.col("key") == F.col("rep"), "left_semi").select(F.col("key").alias("rep"), "text")
    sets = written(_sets(few, words).distinct(), "shingles")
    left = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    found = written(both.where(common / (F.size("x") + F.size("y") - common) >= least).select("a", "b"), "alike")
    drop_written(sets)
    return found


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8, size: int = WORDS, keys: int = KEYS, shared: int = SHARED, bits: int = BITS) -> DataFrame:
    """(key, component_id) of every row with a key: the smallest key reachable over pairs of that similarity."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).where("key is not null")
    found = written(_prints(docs, words, size), "prints")
    same = written(found.groupBy("digest", "print").agg(F.min("key").alias("rep")), "sets")
    texts = same.where("print is not null")
    met = _met(texts, same.count(), keys)
    active = written(texts.select("rep", "print").join(met.select(F.col("b").alias("rep")), "rep"), "active")

    def labelled(links: DataFrame) -> DataFrame:
        joined = components(links).withColumnRenamed("node", "rep")
        return written(active.join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "labelled")

    def meeting(now: DataFrame, nearest: bool) -> DataFrame:
        dealt = map_batches(several.join(now, "rep").select("rep", "print", "component", "postings"), lambda batches: _dealt_again(batches, parts), _BLOBS)
        return map_batches(dealt.repartition(parts, "route"), lambda batches: _apart(batches, keys, shared, bits, nearest), "a long, b long, differ long")

    pairs = written(_tallied(met.where("a < b"), active, shared, bits), "pairs")
    links = _alike(pairs, docs, words, least)
    now = labelled(links)
    count = active.count()
    turns = [written(map_batches(_index(now, count, keys, some, True), _several, "rep long, postings array<long>"), "turn") for some in _turns(keys)]
    several = written(reduce(DataFrame.union, turns).groupBy("rep").agg(F.flatten(F.collect_list("postings")).alias("postings")), "several")
    for table in turns:
        drop_written(table)
    count = several.agg(F.sum(F.size("postings"))).first()[0] or 0
    parts = max(1, -(-count // COMPARED))
    nearest = meeting(now, True).groupBy("a").agg(F.min(F.struct("differ", "b")).alias("p")).select(F.least("a", "p.b").alias("a"), F.greatest("a", "p.b").alias("b")).distinct()
    nearest = written(nearest, "pairs")
    links = links.union(_alike(nearest, docs, words, least))
    drop_written(now)
    now = labelled(links)
    rest = written(meeting(now, False).select("a", "b").distinct(), "pairs")
    links = links.union(_alike(rest, docs, words, least))
    for table in (met, active, now, pairs, nearest, rest, several):
        drop_written(table)
    joined = components(links)
    own = found.join(same.select("digest", "rep"), "digest").select("key", "rep")
    return own.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of df that have the smallest key of their group; rows with a null key all stay, rows with equal keys go together."""
    gone = groups(df, key, text, words, least).where("key <> component_id").select(F.col("key").alias("__gone")).distinct()
    return df.join(gone, df[key] == gone["__gone"], "left_anti")
