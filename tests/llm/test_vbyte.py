import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from tokenizers import Tokenizer

from orbweaver.llm import vbyte

VOCABULARY = path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=200))
def test_pack_and_unpack(values):
    control, data = vbyte.pack(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4) and vbyte.unpack(control, data, len(values)).tolist() == values


def test_as_the_library():
    t, ours, draw = Tokenizer.from_file(VOCABULARY), vbyte.load(VOCABULARY), random.Random(4)
    kinds = [lambda: draw.randint(1, 127), lambda: draw.randint(0xA0, 0x3FF), lambda: draw.randint(0x300, 0x36F), lambda: draw.choice([9, 10, 32, 32, 0x85, 0x1C, 0x2003, 0x3000])]
    some = ["", "Word, word. WORD,. it's", "<|endoftext|> <|ENDOFTEXT|>x", "a<|startoftext|>B", "ß É́, ÿ.. é."]
    some += ["".join(chr(draw.choice(kinds)()) for _ in range(draw.randint(0, 120))) for _ in range(200)]
    assert [x.tolist() for x in ours.encode(some)] == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vbyte, "BLOCK_TOKENS", 50)
    t, draw = Tokenizer.from_file(VOCABULARY), random.Random(1)
    rows = [(k, " ".join(draw.choice(["of", "the", "Whale", "sea,", "ship."]) for _ in range(draw.randint(0, 40))), "x") for k in range(200)]
    rows += [(900, None, "x"), (901, "", "x"), (902, "long words " * 5000, "x"), (-5, "first", None)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = {r["doc_id"]: r for r in vbyte.round_trip(df, VOCABULARY).collect()}
    start = 0
    for k, text, _ in sorted(rows, key=lambda r: r[0]):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    to = f"file://{tmp_path}/files"
    vbyte.write(df, VOCABULARY, to)
    whole = {r["key"]: r["ids"] for r in vbyte.read(spark, to).collect()}
    assert whole[900] == whole[901] == [2] and len(whole) == len(rows)
    ranks = {r["id"]: r["rank"] for r in spark.read.parquet(f"{to}/ranks").collect()}
    counts = np.bincount([k for ids in whole.values() for k in ids])
    order = sorted(np.flatnonzero(counts).tolist(), key=lambda k: (-counts[k], k))
    assert [ranks[k] for k in order] == list(range(len(order)))


def test_null_keys_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "c"), (3, "c"), (3, None)], "doc_id long, text string")
    rows = sorted(vbyte.round_trip(df, VOCABULARY).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["n_tokens"]) for r in rows][0] == (None, 3) and [r["start"] for r in rows] == [0, *np.cumsum([r["n_tokens"] for r in rows])[:-1]]
    assert vbyte.round_trip(df.limit(0), VOCABULARY).count() == 0


def _lengths(words):
    """An encoding that turns the words around: a word's ids are its characters."""
    order = np.arange(len(words))[::-1]
    turned = [words[k] for k in order]
    return order, np.array([ord(c) for w in turned for c in w], np.uint16), np.array([len(w) for w in turned], np.int64)


def test_memo_tells_pieces_of_one_hash_apart():
    draw = random.Random(2)
    for digest in (lambda x: 7, lambda x: len(x) % 3, xxhash.xxh64_intdigest):
        memo = vbyte.PackedMemo(_lengths, 300, digest)
        for _ in range(30):
            words = list({"".join(draw.choice("abcé") for _ in range(draw.choice([0, 1, 2, 3, 400]))) for _ in range(40)})
            draw.shuffle(words)
            ids, lengths = memo.gather(memo.places(pa.array(["x", *words]).slice(1)))
            assert lengths.tolist() == [len(w) for w in words] and "".join(map(chr, ids)) == "".join(words)
            assert len(memo.hashes) <= memo.n <= 340 and (np.diff(memo.hashes.astype(object)) > 0).all()


def test_memory_of_kept_words():
    ours, draw = vbyte._Words(VOCABULARY), random.Random(6)
    words = list({"".join(draw.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(100_000)})
    tracemalloc.start()
    try:
        for k in range(0, len(words), 10_000):
            ours.flat(pa.array([" ".join(words[k : k + 10_000])]))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 120 * len(words)
