"""Vector codes against plain Lloyd rounds over every entry, against SQL, and on odd vectors."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.llm import op12_vector_codes as codes


def plain(rows, parts=4, entries=256, rounds=4):
    """Every distance of every round in Python integers: (vec_id, code, error) and the digest."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    if not good:
        return [], None
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(good[0][1])
    width = -(-length // parts)
    top = min(math.isqrt((2**63 - 1) // (4 * width * parts)), 2**31 - 1)
    ints = [[max(-top, min(top, math.floor(1024 * c))) for c in v] + [0] * (width * parts - length) for _, v in good if len(v) == length]
    ids = [i for i, v in good if len(v) == length]
    x = np.array(ints, dtype=object).reshape(len(ints), parts, width)
    books = [x[:entries, p].copy() for p in range(parts)]

    def near(p):
        d = np.stack([((x[:, p] - e) ** 2).sum(1) for e in books[p]], 1)
        at = [min(range(len(r)), key=lambda j: (r[j], j)) for r in d.tolist()]
        return at, [r[j] for r, j in zip(d.tolist(), at, strict=True)]

    for _ in range(rounds):
        for p in range(parts):
            at = near(p)[0]
            for e in set(at):
                own = [x[i, p] for i, a in enumerate(at) if a == e]
                books[p][e] = sum(own) // len(own)
    last = [near(p) for p in range(parts)]
    text = ",".join(str(c) for b in books for e in b for c in e)
    return [(ids[i], "".join(f"{last[p][0][i]:02x}" for p in range(parts)), sum(last[p][1][i] for p in range(parts))) for i in range(len(ids))], hashlib.sha256(text.encode()).hexdigest()


def compare(spark, rows, kind="float", **settings):
    frame = spark.createDataFrame([(i, v, None if k % 5 == 0 else k % 3, 1) for k, (i, v) in enumerate(rows)], f"vec_id long, embedding array<{kind}>, label int, code int").repartition(3)
    got = codes.compress(frame, **settings).collect()
    expected, digest = plain([(i, None if v is None else [c if c is None else float(np.float32(c)) if kind == "float" else c for c in v]) for i, v in rows], **settings)
    assert sorted([(r["vec_id"], r["code"], r["error"]) for r in got], key=repr) == sorted(expected, key=repr)
    assert {r["codebooks_sha256"] for r in got} <= {digest}
    return frame, got


def test_codes_equal_plain_rounds(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16))
    rows = [(int(i), (centres[i % 40] * 0.2 + r.normal(size=16) * 0.03).tolist()) for i in r.permutation(900)]
    frame, got = compare(spark, rows)
    labels = {}
    marks = {x["vec_id"]: x["label"] for x in frame.collect()}
    for x in got:
        labels[marks[x["vec_id"]]] = labels.get(marks[x["vec_id"]], 0) + x["error"]
    assert all(x["label_error"] == labels[marks[x["vec_id"]]] for x in got)


def test_ties_and_repeated_vectors(spark):
    """Components of few values: very many equal distances, equal vectors, repeated and null ids."""
    r = np.random.default_rng(6)
    rows = [(int(i % 300) if i % 17 else None, (r.integers(-2, 3, 8) / 1024).tolist()) for i in range(700)]
    compare(spark, rows)
    compare(spark, rows, entries=40, rounds=7)


def test_odd_vectors(spark):
    """Nulls, non-finite and very great components, other lengths, lengths the parts don't divide."""
    r = np.random.default_rng(7)
    rows = [(i, r.normal(size=10).tolist()) for i in range(40)]
    rows += [(50, None), (51, []), (52, [None] * 10), (53, [float("nan")] + [0.1] * 9), (54, [float("inf")] + [0.1] * 9), (55, [0.5] * 9), (56, [1e300, -1e300] * 5), (57, [3e4] * 10), (58, [-1e-9] * 10), (58, [-1e-9] * 10)]
    compare(spark, rows, "double")
    compare(spark, rows, "double", entries=7)
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert codes.compress(frame).count() == 0
    assert codes.compress(spark.createDataFrame([(1, None, 1), (2, [None], 2)], frame.schema)).count() == 0


def test_sql_agrees(spark, duck):
    """More vectors than entries: codes, errors and the digest by SQL."""
    path = "/root/testdata/sf0.1/embeddings.parquet"
    frame = spark.read.parquet(path).where("vec_id < 400")
    expected = duck.sql(codes.oracle(f"(SELECT * FROM read_parquet('{path}') WHERE vec_id < 400)")).fetchall()
    got = [tuple(r) for r in codes.compress(frame).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()]
    assert sorted(got) == sorted(expected)


def test_bounds_save_distances():
    """After the first round most groups are skipped, and none that matters."""
    r = np.random.default_rng(8)
    x = r.integers(-400, 400, (5000, 4)) + r.integers(-3000, 3000, (30, 4))[r.integers(0, 30, 5000)]
    entries = x[:256].copy()
    books = codes.Codebooks(entries[None], [codes.group_entries(entries)], [])
    at, _, lower, full = codes.nearest(x, entries, books.members[0])
    assert full == x.shape[0] * 256
    for _ in range(4):
        moved = books.entries.copy()
        for e in np.unique(at):
            moved[0, e] = x[at == e].sum(0) // (at == e).sum()
        books = books.moved(moved)
        at, best, lower, some = codes.nearest(x, moved[0], books.members[0], books.drift[0], at, lower.astype(np.float64))
        d = codes.distances(x, moved[0])
        assert (at == d.argmin(1)).all() and (best == d.min(1)).all()
        assert (np.sqrt(d[:, books.members[0][0]].astype(float)).min(1)[~np.isin(at, books.members[0][0])] >= lower[~np.isin(at, books.members[0][0]), 0]).all()
    assert some < full / 3


@pytest.mark.parametrize("top", [1000, 1 << 27])
def test_distances_are_exact(top):
    r = np.random.default_rng(9)
    x, e = r.integers(-top, top, (50, 16)), r.integers(-top, top, (20, 16))
    assert (codes.distances(x, e).astype(object) == [[sum(int(a - b) ** 2 for a, b in zip(u, v, strict=True)) for v in e] for u in x]).all()


def test_codebook_table(spark):
    frame = spark.range(50).select(F.col("id").alias("vec_id"), F.expr("array(id / 10.0, 1.0, 2.0, id % 7 / 8.0)").cast("array<float>").alias("embedding"))
    books, state = codes.train(frame, label_col=None, entries=8)
    table = codes.codebook_table(spark, books)
    assert table.count() == 4 * 8 and state.count() == 50
    lookup = {(r["part"], r["entry"]): r["components"] for r in table.collect()}
    for r in state.collect():
        rebuilt = [c for p, e in enumerate(r["codes"]) for c in lookup[p, e]]
        assert sum((a - b) ** 2 for a, b in zip(rebuilt, r["x"], strict=True)) == r["error"]
