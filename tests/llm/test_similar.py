"""Near copies by five-word similarity, against all pairs of exact sets."""

import random
import re

import numpy as np
import pytest

from souk.llm import op04_simhash, similar
from tests.llm.test_duplicates import WORDS, brute_components, brute_fingerprint

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def five(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    few, many = sorted((len(a), len(b)))
    return 5 * few >= 4 * many and 5 * (both := len(a & b)) >= 4 * (few + many - both)


def brute_first(docs):
    """{doc_id: smallest id of its component} by all pairs: similar sets, or fingerprints within 3 bits."""
    fps = {d: brute_fingerprint(t) for d, t in docs}
    bits, own = brute_components(list(fps.values())), {d: five(t) for d, t in docs}
    root = {d: d for d, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(root)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bits[fps[a]] == bits[fps[b]] or alike(own[a], own[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def copies(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for at in rng.sample(range(words), edits):
            own[at] = f"x{rng.randrange(10**9)}"
        yield " ".join(own)


def test_stage_finds_copies_beyond_three_bits(spark):
    texts = [*copies(8, 200, 2, 1), "", " ", None, "one two", "One  two", "one two three"]
    docs = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    first = brute_first(docs)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, frame, "").collect()} == set(first.values())
    assert len(set(first.values())) < op04_simhash.keep_first(frame).count()


def test_equals_all_pairs(spark, small_docs):
    docs = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    found = {r["doc_id"]: r["component_id"] for r in similar.near_copies(small_docs).collect()}
    assert found == brute_first(docs)


def test_large_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(similar, "SMALL", 4)
    monkeypatch.setattr(similar, "NEIGHBOURS", 1)
    monkeypatch.setattr(similar, "BLOCK", 16)
    docs = list(enumerate([*copies(60, 200, 2, 2), *copies(40, 200, 5, 3), *copies(40, 120, 3, 4)]))
    found = {r["doc_id"]: r["component_id"] for r in similar.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == brute_first(docs)


def test_empty_table(empty_docs):
    assert similar.near_copies(empty_docs).count() == 0
    assert similar.sketch(np.zeros(0, np.uint64)) == bytes(similar.HASHES)
