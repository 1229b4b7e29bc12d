import hashlib
import json
import random
import time

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from orbweaver.llm import bpe

VOCABULARY = path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_padding()
    t.no_truncation()
    return t


def texts():
    draw = random.Random(5)
    kinds = [lambda: draw.randint(32, 126), lambda: draw.randint(0xA0, 0x2FF), lambda: draw.randint(0x4E00, 0x9FFF), lambda: draw.randint(0x1F300, 0x1FAFF), lambda: draw.choice([9, 10, 13, 32, 0x85, 0x3000])]
    out = ["", " ", "a", "'s we'll I'M", "x" * 3000, " " * 300 + "\n\n\t a", "<|endoftext|>a<|endoftext|><|endoftext|> b", "<|endoftext|", "é́ 日本語 😀", "ab" * 700 + "!" * 500]
    return out + ["".join(chr(draw.choice(kinds)()) for _ in range(draw.randint(0, 200))) for _ in range(150)]


def test_as_the_library(library):
    ours, some = bpe.SegmentTreeBPE(VOCABULARY), texts()
    want = [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
    assert [x.tolist() for x in ours.encode(some)] == want
    assert [ours.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def naive(ours, word):
    """Merge the leftmost pair of lowest rank, one at a time."""
    ids = ours.byte_id[np.frombuffer(word, np.uint8)].tolist()
    rank = dict(zip(ours.keys.tolist(), ours.ranks.tolist(), strict=True))
    while len(ids) > 1:
        best = min((rank.get(a << 20 | b, 1 << 40), k) for k, (a, b) in enumerate(zip(ids, ids[1:])))
        if best[0] == 1 << 40:
            break
        ids[best[1] : best[1] + 2] = [int(ours.merged[best[0]])]
    return ids


def test_tree_against_plain_merging():
    ours, draw = bpe.SegmentTreeBPE(VOCABULARY), random.Random(2)
    words = [bytes(draw.choice(b"aeinrst th") for _ in range(n)) for n in range(1, 33) for _ in range(5)]
    assert [x.tolist() for x in ours.merge(words, 32)] == [naive(ours, w) for w in words]


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefghijklmnopqrstuvwxyz", "\u65e5\u672c\u8a9e\u4e2d\u6587", "!?-"])
def test_long_pieces(library, letters):
    """Pieces with trees of their own; the longest would take minutes with a merge a step."""
    ours, draw = bpe.SegmentTreeBPE(VOCABULARY), random.Random(3)
    some = ["".join(draw.choice(letters) for _ in range(n)) for n in (255, 256, 257, 600, 100_000)]
    began = time.perf_counter()
    assert [x.tolist() for x in ours.encode(some)] == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]
    assert time.perf_counter() - began < 20


def test_merges_that_make_an_earlier_pair(tmp_path):
    """Where a merge makes a pair of lower rank, long pieces merge one pair a step."""
    made = ["ab", "abc", "abcd"]
    vocabulary = {c: k for k, c in enumerate([*bpe.byte_symbols(), *made])}
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": vocabulary, "merges": ["abc d", "a b", "ab c"]}, "added_tokens": []}))
    ours, draw = bpe.SegmentTreeBPE(str(tmp_path / "v.json")), random.Random(4)
    assert ours.alone.tolist() == [False, False, True]
    for n in (40, 700):
        word = bytes(draw.choice(b"abcd") for _ in range(n)) + b"abcabcdab"
        assert ours.merge_long(word, 1024).tolist() == ours.merge([word], 1024)[0].tolist() == naive(ours, word)


def test_memo_is_bounded_in_characters(library, monkeypatch):
    from orbweaver.llm import runtime

    monkeypatch.setattr(runtime, "MEMO_CHARS", 5000)
    ours = bpe.SegmentTreeBPE(VOCABULARY)
    for k in range(30):
        ours.encode(["x" * (1000 + k)])
    assert len(ours.memo.at) <= 7 and ours.memo.chars <= 7500


def test_memory_stays_bounded(library):
    ours = bpe.SegmentTreeBPE(VOCABULARY)
    ours.memo.most = 20
    some = texts()
    assert [x.tolist() for k in range(0, len(some), 10) for x in ours.encode(some[k : k + 10])] == [x.ids for x in library.encode_batch(some, add_special_tokens=False)]


def test_rows(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (2, "Hello world", "b"), (None, "Hello world", None), (5, "many words " * 20000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((tuple(r) for r in bpe.digests(df, VOCABULARY).collect()), key=str)
    want = []
    for k, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(df.limit(0), VOCABULARY).count() == 0
    back = bpe.decode(bpe.encode(df, VOCABULARY).drop("text"), VOCABULARY)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    assert {r["text"] for r in bpe.verified(df, VOCABULARY).collect()} == {t or "" for _, t, _ in rows}
