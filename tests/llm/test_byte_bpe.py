"""Byte-level BPE against the library, an exact round trip, and merges by hand."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from souk.llm import op13_byte_bpe as bpe
from souk.llm.queries import vocabulary

ODD = [
    "  two  spaces\n\n\n lines \t\tand tabs \n", " ", "\n", " \n", "\n ", "it's I'LL they've 'twas don''t '", "a\x1cb \x1c c\x1d\x1e\x1f d", "x\x85y z q w", "3.14 1,000 ٣٤ ½ ² ⅷ", "日本語 テキスト 한국어", "🙂🙂 👩‍👩‍👧 é",
    "<|endoftext|> <|fim|>", "ﬁ ǅ İ ß", "\x00\x01 \x7f", "a" * 3000, " " * 500 + "x", "\n" * 300, "!?" * 400, "﻿bom ​ zero", "tail ",
]


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(vocabulary("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_words_are_merged_as_the_library_does(ranks, library):
    r = random.Random(4)
    words = ["", "a", "the", " the", "x" * 700, "ab" * 500, "qzqzqz"] + ["".join(r.choice("abcdefghijé ß\n'0日") for _ in range(r.randrange(1, 60))) for _ in range(3000)]
    assert bpe.merge(b"", ranks) == []
    for w in words[1:]:
        assert bpe.merge(w.encode(), ranks) == library._core_bpe.encode_single_piece(w.encode()), w


def test_merges_by_hand():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"aa": 260, b"aaaa": 261}
    assert bpe.merge(b"abc", ranks) == [258]
    assert bpe.merge(b"abcd", ranks) == [258, 100]
    assert bpe.merge(b"cdcd", ranks) == [259, 259]
    assert bpe.merge(b"xabcx", ranks) == [120, 258, 120]
    assert bpe.merge(b"aaaaaaa", ranks) == [261, 260, 97]
    assert bpe.merge(b"bcbc", ranks) == [257, 257]


def expected(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("size,part,rows", [(48_000_000, 8_000_000, 100_000), (3000, 700, 5), (1, 1, 1)])
def test_round_trip_of_odd_rows(spark, odd_docs, ranks, library, monkeypatch, size, part, rows):
    """Nulls, empty and long texts, white space of all kinds, repeated rows, clashing columns; one slice, many of some parts, or very many."""
    for name, value in (("SLICE_BYTES", size), ("PART_BYTES", part), ("PART_ROWS", rows), ("SLICE_ROWS", 10 * rows)):
        monkeypatch.setattr(bpe, name, value)
    r = random.Random(5)
    texts = ODD + ["".join(r.choice(["a", "B", "é", "1", " ", " ", "\n", "\t", "'s", ".", "　", "\x1c", "日"]) for _ in range(r.randrange(80))) for _ in range(300)]
    base = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()] + [(100 + i, t) for i, t in enumerate(texts)] + [(100, texts[0]), (None, texts[1])]
    docs = spark.createDataFrame(base, "doc_id long, body string").selectExpr("*", "1 as ids", "'x' as word", "2 as slice", "3 as _text")
    got = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, text_col="body").collect()
    assert sorted([tuple(x) for x in got], key=repr) == sorted([(i, *expected(library, t)) for i, t in base], key=repr)


def test_small_documents(small_docs, ranks, library):
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.round_trip(small_docs, ranks, public_tokenizers.PATTERN).collect()}
    rows = small_docs.select("doc_id", "text").collect()
    assert len(got) == len(rows) and all(got[r["doc_id"]] == expected(library, r["text"]) for r in rows)


def test_text_ids_and_empty_tables(spark, empty_docs, ranks, library):
    assert bpe.round_trip(empty_docs, ranks, public_tokenizers.PATTERN).count() == 0
    named = spark.createDataFrame([("a", "one two"), (None, None), ("b", "")], "name string, t string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(named, ranks, public_tokenizers.PATTERN, "name", "t").collect()}
    assert got == {"a": library.encode_ordinary("one two"), None: [], "b": []}


def test_decoding_any_ids(spark, ranks, library):
    """Lists that no text gave: unknown ids and nulls give null, bytes need not be text; other columns stay."""
    rows = [(1, library.encode_ordinary("round 日")), (2, []), (3, None), (4, [5, None]), (5, [10**6]), (6, [-1, 3]), (7, [ranks[b"\xff"], ranks[b"\xfe"]])]
    got = {r["k"]: r["out"] for r in bpe.decode(spark.createDataFrame(rows, "k int, n array<int>"), ranks, "n", "out").collect()}
    assert got == {1: "round 日".encode(), 2: b"", 3: None, 4: None, 5: None, 6: None, 7: b"\xff\xfe"}
    assert bpe.decode(spark.createDataFrame(rows[:3], "k int, n array<int>"), {}, "n").where("decoded is not null").count() == 1


def test_words_that_went_missing_are_noticed(spark, ranks, monkeypatch):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    whole = bpe.slice_words
    monkeypatch.setattr(bpe, "slice_words", lambda source, pattern: whole(source, pattern).where(F.col("code") > 0))
    with pytest.raises(Exception, match="answers to"):
        bpe.encode(docs, ranks, public_tokenizers.PATTERN).collect()


def test_ranks_file(tmp_path):
    path = tmp_path / "v"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([b"a", b"\xff", b"ab"])) + b"\n\n")
    assert bpe.read_ranks(str(path)) == {b"a": 0, b"\xff": 1, b"ab": 2}
