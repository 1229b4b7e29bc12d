"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs.

Each pre-token has a segment tree whose leaf p holds the rank of the pair that starts at symbol p (with p itself, so
that equal ranks go to the left). The root is the leftmost merge of lowest rank. A merge changes three leaves, each
brought up to the root in logarithmic steps, until no pair can be merged. The trees of many pre-tokens of like length
are rows of one array, and each step runs over all rows at once. A pre-token of over LONG bytes has a tree of its own,
whose steps take all pairs of the root's rank: they are found from the root down, and would be merged one after another,
from the left, as long as a merge makes no pair of lower rank (it cannot, unless a token is made in two ways).

Null texts count as empty; an empty text has no ids and decodes to an empty text. Texts of any length are encoded whole.
Rows are independent: repeated rows, ties and other columns change nothing, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Memo, chunks, map_batches

#: The pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_NONE = np.int64(1 << 62)
#: Bytes from which on a pre-token has a tree of its own.
LONG = 256


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones for themselves, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class SegmentTreeBPE:
    """A byte-level BPE vocabulary in the tokenizers library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocabulary = data["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        left, right = (np.array([vocabulary[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        # a pair listed twice keeps its last rank, as a map filled in order does
        ranks = dict(zip((left << 20 | right).tolist(), range(len(pairs)), strict=True))
        keys = np.fromiter(ranks, np.int64, len(ranks))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(ranks.values(), np.int64, len(ranks))[order]
        rank = self.ranks
        first = np.full(1 + max(vocabulary.values()), _NONE)  # of the pairs that a token is part of, the lowest rank
        for part in (self.keys >> 20, self.keys & (1 << 20) - 1):
            np.minimum.at(first, part, rank)
        self.alone = first[self.merged] <= np.arange(len(self.merged))  # ranks whose merges can make a pair that comes before
        self.double = left == right
        self.byte_id = np.array([vocabulary[c] for c in symbols], np.int64)
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for token, k in vocabulary.items():
            self.bytes_of[k] = bytes(byte_of[c] for c in token)
        for token, k in self.special.items():
            self.bytes_of[k] = token.encode()
        self.decimal = [str(k) for k in range(size)]
        self._find = regex.compile(PATTERN).findall
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo = Memo(self._encode_pieces)

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens; the string of a special token is one of its own."""
        if self._special is None or not any(s in text for s in self.special):
            return self._find(text)
        return [p for part in self._special.split(text) for p in ([part] if part in self.special else self._find(part))]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)

    def _encode_pieces(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        words = [p.encode() for p in pieces]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out: list = [None] * len(words)
        special = {k for k, p in enumerate(pieces) if p in self.special} if any(s in pieces for s in self.special) else set()
        classes = np.where(sizes < 2, 1, 1 << np.ceil(np.log2(np.maximum(sizes, 2))).astype(np.int64))
        for width in np.unique(classes).tolist():
            rows = [k for k in np.flatnonzero(classes == width).tolist() if k not in special]
            if width > LONG:
                for k in rows:
                    out[k] = self.merge_long(words[k], width)
                continue
            step = max(1, (1 << 17) // width)
            for at in range(0, len(rows), step):
                part = rows[at : at + step]
                for k, ids in zip(part, self.merge([words[k] for k in part], width), strict=True):
                    out[k] = ids
        for k in special:
            out[k] = np.array([self.special[pieces[k]]])
        return pieces, np.concatenate(out).astype(np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    def merge(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of byte strings of at most `width` (a power of two) bytes, merged in step."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n, places = len(words), np.arange(width)
        filled = places < sizes[:, None]
        # one place more at the end: the "no symbol" that a last symbol is followed by
        ids = np.full((n, width + 1), -1, np.int64)
        ids[:, :width][filled] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        shift = np.int64(width.bit_length())
        tree = np.full((n, 2 * width), _NONE)
        ranks = self._rank(ids[:, :-1], ids[:, 1:])
        tree[:, width:] = np.where(ranks >= 0, ranks << shift | places, _NONE)
        level = width >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1

        rows = np.arange(n)
        while True:
            root = tree[rows, 1]
            going = root < _NONE
            rows, root = rows[going], root[going]
            if not len(rows):
                break
            here, rank = root & ((np.int64(1) << shift) - 1), root >> shift
            gone = after[rows, here]
            then = after[rows, gone]
            ids[rows, here] = self.merged[rank]
            ids[rows, gone] = -1
            after[rows, here] = then
            before[rows, np.minimum(then, width)] = here
            first = before[rows, here]
            tree[rows, width + gone] = _NONE
            self._set(tree, rows, width, here, ids[rows, here], ids[rows, np.minimum(then, width)], shift)
            has = first >= 0
            first = np.where(has, first, here)
            self._set(tree, rows[has], width, first[has], ids[rows[has], first[has]], ids[rows[has], here[has]], shift)
            for leaf in (gone, here, first):
                node = width + leaf >> 1
                while node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
        kept = ids >= 0
        return np.split(ids[kept], np.cumsum(kept.sum(1))[:-1])

    def merge_long(self, word: bytes, width: int) -> np.ndarray:
        """Ids of one byte string of at most `width` (a power of two) bytes."""
        n = len(word)
        ids = np.full(n + 1, -1, np.int64)
        ids[:n] = self.byte_id[np.frombuffer(word, np.uint8)]
        after, before = np.arange(1, n + 3), np.arange(-1, n + 1)
        after[n:] = n
        tree = np.full(2 * width, _NONE)

        def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            found = self._rank(ids[a], ids[b])
            return np.where(found >= 0, found, _NONE)

        tree[width : width + n] = ranks(np.arange(n), np.arange(1, n + 1))
        level = width >> 1
        while level:
            tree[level : 2 * level] = np.minimum(tree[2 * level : 4 * level : 2], tree[2 * level + 1 : 4 * level : 2])
            level >>= 1
        while (rank := tree[1]) < _NONE:
            node = np.array([1])
            while node[0] < width:
                node = (2 * node[:, None] + np.arange(2)).ravel()
                node = node[tree[node] == rank]
            here = node - width
            if self.alone[rank]:
                here = here[:1]
            elif self.double[rank] and len(here) > 1:  # of pairs that overlap, every second one
                new = np.concatenate([[True], after[here[:-1]] != here[1:]])
                at = np.arange(len(here))
                here = here[(at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0]
            gone = after[here]
            then = after[gone]
            ids[here], ids[gone] = self.merged[rank], -1
            after[here], before[then] = then, here
            first = before[here]
            has = first >= 0
            tree[width + gone] = _NONE
            tree[width + here] = ranks(here, then)
            tree[width + first[has]] = ranks(first[has], here[has])
            node = np.unique(np.concatenate([here, gone, first[has]]) + width >> 1)
            while node[0]:
                tree[node] = np.minimum(tree[2 * node], tree[2 * node + 1])
                node = node >> 1
                node = node[np.concatenate([[True], node[1:] != node[:-1]])]
        return ids[ids >= 0]

    def _set(self, tree: np.ndarray, rows: np.ndarray, width: int, leaf: np.ndarray, a: np.ndarray, b: np.ndarray, shift: np.int64) -> None:
        ranks = self._rank(a, b)
        tree[rows, width + leaf] = np.where(ranks >= 0, ranks << shift | leaf, _NONE)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.pieces(t) for t in texts]
        ids, lengths = self.memo.ids([p for x in pieces for p in x])
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, pieces)])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> SegmentTreeBPE:
    return SegmentTreeBPE(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with a column of token ids."""
    return _rows(df, path, text, f"`{ids}` array<int>", lambda bpe, texts: [pa.array([x.astype(np.int32) for x in bpe.encode(texts)], pa.list_(pa.int32()))])


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "text") -> DataFrame:
    """df with the text that the ids stand for; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = pa.array([bpe.decode(x or []) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), texts], [*names, text])

    names = [c for c in df.columns if c != text]
    keep = [df.columns.index(c) for c in names]
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text), f"`{text}` string"]
    return map_batches(df, run, ", ".join(fields))


def verified(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", n_tokens: str = "n_tokens") -> DataFrame:
    """df with token ids and their number; the text is what the ids decode to."""

    def made(bpe: SegmentTreeBPE, texts: list[str]) -> list[pa.Array]:
        found = [x.astype(np.int32) for x in bpe.encode(texts)]
        back = [bpe.decode(x.tolist()) for x in found]
        return [pa.array(back, pa.string()), pa.array(found, pa.list_(pa.int32())), pa.array(map(len, found), pa.int64())]

    return _rows(df, path, text, f"`{text}` string, `{ids}` array<int>, `{n_tokens}` long", made)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_tokens, and SHA-256 of the decimal ids joined by commas and of the decoded text."""

    def made(bpe: SegmentTreeBPE, texts: list[str]) -> list[pa.Array]:
        counts, of_ids, of_text = [], [], []
        for ids in bpe.encode(texts):
            ids = ids.tolist()
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(",".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
            of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]

    return _rows(df.select(F.col(key), F.col(text)), path, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", made, drop=(text,))


def _rows(df: DataFrame, path: str, text: str, added: str, made, drop: tuple[str, ...] = ()) -> DataFrame:
    new = [x.split()[0].strip("`") for x in added.split(", ")]
    kept = [f for f in df.schema if f.name not in drop and f.name not in new]
    keep = [df.columns.index(f.name) for f in kept]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for a, b in chunks(texts):
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in keep), *made(bpe, texts[a:b])], [*(f.name for f in kept), *new])

    return map_batches(df, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), added]))
