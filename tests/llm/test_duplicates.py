"""Operators on repeated text, against brute force over all documents."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from pyspark.sql import functions as F

from souk.llm import components, op03_suffix_dedup, op04_simhash, op10_substrings, similar
from souk.llm.suffix import SENTINEL, shared_prefix_groups

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(params=["odd", "small"])
def docs(request, odd_docs, small_docs):
    return odd_docs if request.param == "odd" else small_docs


def brute_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [words] if len(words) < 3 else [words[i : i + 3] for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, most=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(root)
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if bin(a ^ b).count("1") <= most:
                root[find(a)] = find(b)
    return {f: find(f) for f in distinct}


def test_simhash(docs):
    all_rows = docs.collect()
    fps = [brute_fingerprint(r["text"]) for r in all_rows]
    root = brute_components(fps)
    first = {}
    for r, f in zip(all_rows, fps, strict=True):
        if r["doc_id"] is not None:
            first[root[f]] = min(first.get(root[f], r["doc_id"]), r["doc_id"])
    expected = sorted(((r["doc_id"], f"{f:016x}", first.get(root[f])) for r, f in zip(all_rows, fps, strict=True)), key=repr)
    assert rows(op04_simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == expected
    kept = op04_simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id") == sorted(((first.get(c),) for c in set(root.values())), key=repr)


@pytest.mark.parametrize("split, look_up", [(4096, 20_000), (40, 20_000), (40, 10)])
def test_links_connect_all_near_fingerprints(spark, monkeypatch, split, look_up):
    monkeypatch.setattr(op04_simhash, "SPLIT_ABOVE", split)
    monkeypatch.setattr(op04_simhash, "LOOK_UP_ABOVE", look_up)
    r = random.Random(5)
    centre = r.getrandbits(64)
    fps = {r.getrandbits(64) for _ in range(500)} | {0, (1 << 64) - 1, centre}
    for _ in range(400):
        x = r.choice([centre, *list(fps)[:30]])
        for _ in range(r.randint(1, 4)):
            x ^= 1 << r.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    distinct = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64)}))
    pairs = op04_simhash.links(distinct).toPandas()
    u, v = (pairs[c].to_numpy().view(np.uint64) for c in "uv")
    assert (np.bitwise_count(u ^ v) <= 3).all()
    frame = spark.createDataFrame(pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)}))
    got = {np.int64(r["node"]).view(np.uint64).item(): r["root"] for r in components.components(frame).collect()}
    want = brute_components(fps)
    sizes = Counter(want.values())
    groups = {}
    for f in fps:
        if sizes[want[f]] > 1:
            groups.setdefault(want[f], set()).add(got.get(f, np.uint64(f).view(np.int64).item()))
        else:
            assert f not in got
    assert all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)


def test_a_full_key_gives_fewer_links_than_fingerprints():
    """All 2^16 settings of 16 bits, and settings with gaps that leave several components."""
    every = np.arange(1 << 16, dtype=np.uint64) << np.uint64(20)
    links = op04_simhash.neighbour_links(every)
    assert links.shape == (65_535, 2) and np.unique(links).size == 65_536 and (np.bitwise_count(links[:, 0] ^ links[:, 1]) <= 3).all()
    r = np.random.default_rng(2)
    sparse = np.unique(r.integers(0, 1 << 24, 700, np.uint64))
    for found in (op04_simhash.neighbour_links(sparse), op04_simhash.forest(sparse)):
        want = brute_components(sparse.tolist())
        root = {f: f for f in sparse.tolist()}

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for u, v in found.tolist():
            assert top(u) != top(v)  # a forest: no link closes a circle
            root[top(u)] = top(v)
        got = {f: top(f) for f in sparse.tolist()}
        assert len({(want[f], got[f]) for f in got}) == len(set(want.values())) == len(set(got.values())) == sparse.size - len(found)


def test_one_row_of_each_group_stays(spark):
    """Repeated ids, texts and null ids, and columns with the operator's own names."""
    near = "a text of some words that is copied once and once again here"
    docs = [(5, near), (5, near), (2, near), (5, "other words stand under the same id"), (None, near), (None, "only null ids have this text"), (None, "only null ids have this text"), (9, "x"), (8, None), (7, "")]
    frame = spark.createDataFrame([(*x, i, "g", 0.5) for i, x in enumerate(docs)], "doc_id long, text string, _gone long, root string, n double").withColumn("_key_id", F.lit(1)).withColumn("_key_digest", F.lit(2)).withColumn("_place", F.lit(3))
    for keep in (op04_simhash.keep_first, similar.keep_first):
        got = keep(frame)
        assert got.columns == frame.columns
        kept = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
        assert kept == sorted([(2, near), (5, "other words stand under the same id"), (None, "only null ids have this text"), (9, "x"), (7, "")], key=repr)


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {1000 + i: 1000 for i in range(1, 50)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_substrings(texts, window=35):
    words = [WORDS.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings(docs):
    all_rows = docs.collect()
    expected = sorted(((r["doc_id"], *x) for r, x in zip(all_rows, brute_substrings([r["text"] for r in all_rows]), strict=True)), key=repr)
    got = op10_substrings.remove_repeats(docs)
    assert rows(got, "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    assert all(r["n_removed"] == sum(b - a for a, b in zip(r["spans"][::2], r["spans"][1::2], strict=True)) for r in got.collect())


def test_window_hashes_are_equal_only_for_equal_windows():
    r = np.random.default_rng(1)
    x = r.integers(0, 3, 3000).astype(np.uint64)
    h = op10_substrings.window_hashes(x, 4, op10_substrings.BASES[0])
    seen = {}
    for i, k in enumerate(h.tolist()):
        assert seen.setdefault(k, tuple(x[i : i + 4])) == tuple(x[i : i + 4])
    assert len(seen) == 81


@pytest.mark.parametrize("seed", range(12))
def test_shared_prefix_groups(seed):
    r = random.Random(seed)
    letters, least = r.choice(["ab", "abc", "abcdefgh"]), r.choice([3, 8, 20, 50])
    base = "".join(r.choice(letters) for _ in range(200))
    parts = []
    for _ in range(r.randint(1, 12)):
        a = r.randrange(150)
        parts.append(base[a : a + r.randint(1, 50)] + "".join(r.choice(letters) for _ in range(r.randint(0, 30))) if r.random() < 0.8 else "ab" * r.randint(1, 60))
    text = b"".join(p.encode() + bytes([SENTINEL]) for p in parts)
    where = {}
    for i in range(len(text) - least + 1):
        if SENTINEL not in text[i : i + least]:
            where.setdefault(text[i : i + least], []).append(i)
    got = {}
    for p, g in zip(*(x.tolist() for x in shared_prefix_groups(np.frombuffer(text, np.uint8), least)), strict=True):
        got.setdefault(g, []).append(p)
    assert {tuple(sorted(x)) for x in got.values()} == {tuple(x) for x in where.values() if len(x) > 1}


def test_thinned_text_keeps_all_repeats():
    """What is left for the transform is small where little repeats, and gives the same strings."""
    rng, length = np.random.default_rng(5), 50
    shared = rng.integers(97, 123, 130).astype(np.uint8)
    pieces = [rng.integers(97, 123, n).astype(np.uint8) for n in (50, 51, 400, 3000, 700)]
    pieces = [np.concatenate([p, shared[:k], p[:20]]) for p, k in zip(pieces, (130, 49, 50, 130, 90), strict=True)] + [pieces[0], np.full(300, 97, np.uint8)]
    text = np.concatenate([np.append(p, np.uint8(SENTINEL)) for p in pieces])
    starts = np.concatenate([[0], np.cumsum([p.size + 1 for p in pieces])])
    kept, at, begin = op03_suffix_dedup.thinned(text, starts, length)
    places, groups = shared_prefix_groups(kept, length)
    part = np.searchsorted(at, places, side="right") - 1
    sets = lambda places, groups: {tuple(sorted(places[groups == g].tolist())) for g in np.unique(groups)}
    assert sets(places - at[part] + begin[part], groups) == sets(*shared_prefix_groups(text, length))
    assert kept.size < text.size / 2
    alone = np.append(pieces[3][:3000], np.uint8(SENTINEL))
    assert op03_suffix_dedup.thinned(alone, np.array([0, alone.size]), length)[0].size < alone.size / 2


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(spark, docs, monkeypatch, hot):
    monkeypatch.setattr(op03_suffix_dedup, "HOT", hot)
    pieces = [(100, "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt"), (101, "xx Lorem ipsum dolor sit amet, consectetur adipiscing eliT"), (102, "ab" * 300), (103, "zz" + "ab" * 40 + "q"), (104, "é" * 24 + "ab"), (105, "é" * 26)]
    r = random.Random(4)
    passage = "a passage that stands in many documents, each time with other words before and after it."
    pieces += [(200 + i, "".join(r.choice("abcdefgh ") for _ in range(90)) + passage + "".join(r.choice("abcdefgh ") for _ in range(70))) for i in range(40)]
    frame = docs.select("doc_id", "text").union(spark.createDataFrame(pieces, "doc_id long, text string"))
    all_rows = frame.collect()
    first = {}
    data = [((r["text"] or "").encode(), r["doc_id"]) for r in all_rows]
    for b, d in data:
        for i in range(len(b) - 49 if d is not None else 0):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], d), d)
    expected = []
    for b, d in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        expected.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    got = op03_suffix_dedup.remove_repeats(frame)
    assert rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(expected, key=repr)


def test_empty_tables(empty_docs):
    assert op04_simhash.near_duplicates(empty_docs).count() == 0
    assert op10_substrings.remove_repeats(empty_docs).count() == 0
    assert op03_suffix_dedup.remove_repeats(empty_docs).count() == 0
