"""Token ids in files: frequency-ranked, in byte-aligned variable-length coding with separate control bytes.

All texts are encoded with the tokenizers library and end with the id `end_id`. Ids are replaced by their rank over the
whole corpus (the most frequent is 0; ties go to the smaller id), so most take one byte. A block holds the ranks of
consecutive documents in two byte strings: control bytes, each with the lengths (1 to 4 bytes, two bits each) of four
ranks, and the data bytes themselves, little-endian. Reading looks up the four lengths of each control byte in a table,
sums them to offsets and gathers the data bytes, all in numpy.

A file set is two Parquet tables under one path: `blocks` (first_start, doc_ids, n_tokens per document, control, data),
in ascending order of the key over its files, and `ranks` (rank, id). Spark's own writer commits them, so a lost executor
or a second attempt leaves no torn file.

Null texts count as empty: such a document is the end id alone. Rows with a null key come first; rows with equal keys
are all kept, in order of their ids. An empty table gives empty files. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import PackedMemo, drop_written, local_table, map_batches, shared_dir, written

#: Tokens after which a block ends; one document is never divided.
BLOCK_TOKENS = 1 << 18
#: Documents after which a block ends.
BLOCK_DOCUMENTS = 4096

#: Lengths of the four values that a control byte announces.
LENGTHS = (np.arange(256)[:, None] >> np.arange(0, 8, 2) & 3) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype(np.uint32)
    code = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = code
    control = (padded.reshape(-1, 4) << np.arange(0, 8, 2, dtype=np.uint8)).sum(1, dtype=np.uint8)
    data = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), data[np.arange(4) <= code[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values that pack() was given."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    bytes_ = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    at = np.cumsum(lengths) - lengths
    out = bytes_[at].astype(np.uint32)
    for k in (1, 2, 3):
        if len(longer := np.flatnonzero(lengths > k)):
            out[longer] |= bytes_[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


#: Special tokens, and letters that may compose with a mark in one case only.
_CASE_MATTERS = r"<\||[A-Z]\pM"


class _Words:
    """The library's encoding, by stretches without blank or line feed, which no token or special token crosses.

    A-Z go to lower case beforehand, as the vocabulary's normalizer has it, except in texts where case matters first. So
    fewer different stretches are left for the library. Those that are plain letters, perhaps with full stops or commas
    at the end, are one or two pre-tokens, which neither the normalizer nor the pre-tokenizer changes; they go to the
    library in long rows, without these two, and are told apart by the mark that each pre-token's last token has.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        tokenizer, lean = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for t in (tokenizer, lean):
            t.no_padding()
            t.no_truncation()
        lean.normalizer = None
        lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        if tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids are held in 16 bits here")
        mark = tokenizer.model.end_of_word_suffix
        ends = np.zeros(1 << 16, bool)
        if mark:
            ends[[k for token, k in tokenizer.get_vocab().items() if token.endswith(mark)]] = True
        plain = re.compile("([a-zß-öø-ÿ]+)([,.]*)").fullmatch

        def ids_of(tokenizer: Tokenizer, texts: list[str], step: int) -> tuple[np.ndarray, np.ndarray]:
            flat, lengths = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)]
            for k in range(0, len(texts), step):  # the library's results take some 100 bytes a token
                ids = [x.ids for x in tokenizer.encode_batch_fast(texts[k : k + step], add_special_tokens=False)]
                flat.append(np.fromiter(chain.from_iterable(ids), np.uint16))
                lengths.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            return np.concatenate(flat), np.concatenate(lengths)

        def library(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            rows, rest, pieces, counts = [], [], [], []
            for k, w in enumerate(words):
                if mark and (m := plain(w)):
                    core, tail = m.groups()
                    rows.append(k)
                    pieces.append(f"{core} {tail}" if tail else core)
                    counts.append(2 if tail else 1)
                else:
                    rest.append(k)
            flat, _ = ids_of(lean, [" ".join(pieces[k : k + 256]) for k in range(0, len(pieces), 256)], 16)
            last = np.flatnonzero(ends[flat])[np.cumsum(counts, dtype=np.int64) - 1]
            more, lengths = ids_of(tokenizer, [words[k] for k in rest], 4096)
            return np.array(rows + rest, np.int64), np.concatenate([flat, more]), np.concatenate([np.diff(last, prepend=-1), lengths])

        self.memo = PackedMemo(library, 1_500_000)

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many ids each text has. Arrow splits the texts and finds the different stretches."""
        if not len(texts):
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        texts = pc.fill_null(texts, "")
        lower = pc.if_else(pc.match_substring_regex(texts, _CASE_MATTERS), texts, pc.ascii_lower(texts))
        words = pc.split_pattern(pc.replace_substring(lower, "\n", " "), " ")
        counts = np.asarray(pc.list_value_length(words), np.int64)
        different = words.flatten().dictionary_encode()
        places = self.memo.places(different.dictionary)
        ids, lengths = self.memo.gather(places[np.asarray(different.indices)])
        del lower, words, different
        pa.default_memory_pool().release_unused()
        return ids, np.diff(np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)], prepend=0)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, lengths = self.flat(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(lengths)[:-1])


@lru_cache(maxsize=2)
def load(path: str) -> _Words:
    return _Words(path)


def _tokenized(df: DataFrame, path: str, end_id: int, key: str, text: str) -> DataFrame:
    """Rows of key, n_tokens and the ids as 16-bit bytes, and, where n_tokens is null, of how often each id occurs in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names, total = load(path), ["key", "n_tokens", "ids"], np.zeros(1 << 16, np.int64)
        for batch in batches:
            ids, lengths = words.flat(batch.column(1))
            ends = np.cumsum(lengths)
            ids = np.insert(ids, ends, end_id).astype("<u2")
            total += np.bincount(ids, minlength=1 << 16)
            offsets = np.concatenate([[0], 2 * (ends + np.arange(1, len(ends) + 1))]).astype("<i4")
            packed = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths + 1), packed], names)
        tally = zlib.compress(total.astype("<i8").tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([tally], pa.binary())], names)

    return map_batches(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")), run, "key long, n_tokens long, ids binary")


def _counts(tallies: DataFrame) -> DataFrame:
    """(id, n) of the whole corpus from the partitions' tallies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total = np.frombuffer(zlib.decompress(x), "<i8")
                found = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found], pa.int64())], ["id", "n"])

    return map_batches(tallies.select("ids"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(df: DataFrame, path: str, to: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> None:
    """Write the file set at `to`. The rank table has a row for each id of the vocabulary at most (65536)."""
    spark = df.sparkSession
    staged = written(_tokenized(df, path, end_id, key, text), "ids")
    counted = sorted(((r["n"], r["id"]) for r in _counts(staged.where("n_tokens is null")).collect()), key=lambda x: (-x[0], x[1]))
    rank_of = np.zeros(1 << 16, np.uint32)
    rank_of[[k for _, k in counted]] = np.arange(len(counted))
    local_table(spark, [(rank, k) for rank, (_, k) in enumerate(counted)], "rank int, id int").coalesce(1).write.parquet(f"{to}/ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            values = np.concatenate([np.frombuffer(x, "<u2") for _, _, x in held])
            control, data = pack(rank_of[values])
            row = [part, number, start, [k for k, _, _ in held], [n for _, n, _ in held], control, data]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], ["part", "block", "start", "keys", "n_tokens", "control", "data"])

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += row[1]
                if size >= BLOCK_TOKENS or len(held) >= BLOCK_DOCUMENTS:
                    yield block()
                    number, start, held, size = number + 1, start + size, [], 0
        if held:
            yield block()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = staged.where("n_tokens is not null").repartitionByRange(parts, "key").sortWithinPartitions("key", "ids")
    map_batches(ordered, run, "part int, block int, start long, keys array<long>, n_tokens array<long>, control binary, data binary").write.parquet(f"{to}/blocks")
    drop_written(staged)


def read(spark: SparkSession, at: str) -> DataFrame:
    """From a file set, per document: key, start (ids of all documents before it), n_tokens, ids_crc32 and the ids."""
    return _read(spark, at, True)


def digests(spark: SparkSession, at: str, key: str = "doc_id") -> DataFrame:
    """read() without the ids."""
    return _read(spark, at, False).withColumnRenamed("key", key)


def _read(spark: SparkSession, at: str, whole: bool) -> DataFrame:
    blocks = spark.read.parquet(f"{at}/blocks")
    ranks = spark.read.parquet(f"{at}/ranks").collect()
    id_of = np.zeros(max(1, len(ranks)), np.uint32)
    id_of[[r["rank"] for r in ranks]] = [r["id"] for r in ranks]
    # a row for each of the writer's partitions: where its first document starts
    ends = blocks.groupBy("part").agg(F.max(F.col("start") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    offset, total = {}, 0
    for r in ends:
        offset[r["part"]] = total
        total += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, keys, sizes, control, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ends = np.cumsum(sizes)
                values = id_of[unpack(control, data, int(ends[-1]))].astype("<u4")
                split = [values[e - n : e] for e, n in zip(ends.tolist(), sizes, strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array(offset[part] + start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in split], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([x.astype(np.int32) for x in split], pa.list_(pa.int32()))] if whole else [])], ["key", "start", "n_tokens", "ids_crc32", *(["ids"] if whole else [])])

    return map_batches(blocks.select("part", "start", "keys", "n_tokens", "control", "data"), run, "key long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * whole)


def round_trip(df: DataFrame, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the whole table's ids to files in the shared folder and give per document what the files hold."""
    to = f"{shared_dir(df.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(df, path, to, end_id, key, text)
    return digests(df.sparkSession, to, key)
