"""Operators that judge each document, against brute force over whole texts."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from souk.llm import op02_quality, op06_decontaminate, op07_lines, op08_tokens, op09_rules
from souk.llm.queries import vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.fixture(params=["odd", "small"])
def docs(request, odd_docs, small_docs):
    return odd_docs if request.param == "odd" else small_docs


def test_tokens_equal_the_library(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    expected = []
    for r in docs.collect():
        text = r["text"] or ""
        n = len(t.encode(text, add_special_tokens=False).ids)
        expected.append((r["doc_id"], len(text.encode()), n, n > 2048))
    assert rows(op08_tokens.count_tokens(docs, vocabulary("word_bpe_49k.json")), "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(expected, key=repr)


def test_token_table_stays_bounded():
    model = open(vocabulary("word_bpe_49k.json"), encoding="utf-8").read()
    counts = op08_tokens.TokenCounts(model, op08_tokens.prove_whole(model), kept=10)
    assert counts.text(" ".join(f"word{i}" for i in range(100)).encode()) > 100
    assert len(counts) <= 10


def base(text):
    words = WORDS.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


@pytest.mark.parametrize("least, share", [(1, 0.02), (op09_rules.MIN_DOCS, op09_rules.MAX_SHARE), (3, 0.5)])
def test_rule_counts_and_verdicts(spark, docs, least, share):
    """Also with production limits, over added documents of which many share a line."""
    shared = [(1000 + i, "a line that many documents of one host have in common\n" + " ".join(f"own{i}x{k}" for k in range(60)), f"src{i % 2}") for i in range(40)]
    shared += [(2000 + i, "\n".join([f"common line {k} " * 12 for k in range(5)]) + f"\nown {i}", None) for i in range(12)]
    docs = docs.select("doc_id", "text", "source").unionAll(spark.createDataFrame(shared, "doc_id long, text string, source string"))
    all_rows = docs.collect()
    hosts = Counter(r["source"] for r in all_rows)
    on = Counter()
    norm = lambda x: " ".join(WORDS.findall(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), x))))
    for r in all_rows:
        on.update((r["source"], x) for x in {norm(x) for x in (r["text"] or "").split("\n")} if x)
    expected = []
    for r in all_rows:
        counts = base(r["text"])
        over = lambda x, h=r["source"]: on[h, norm(x)] > max(least, share * hosts[h])
        gone = sum(len(WORDS.findall(x)) for x in (r["text"] or "").split("\n") if over(x))
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        expected.append((r["doc_id"], *counts, failed, gone, not failed and counts[0] - gone >= 0.5 * counts[0]))
    got = op09_rules.quality_rules(docs, min_docs=least, max_share=share)
    assert rows(got, "doc_id", *op09_rules.COUNTS, "base_failed", "boilerplate_words", "kept") == sorted(expected, key=repr)


def test_repeat_words_with_many_distinct_words():
    words = [f"{i % 70000}".encode() for i in range(140001)]
    ids = op09_rules.WordIds({str(i).encode() + b"!": i for i in range(1 << 20)})
    assert op09_rules.repeat_words(words, ids) == 140001


def hits(text, items, window=13):
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, met = fold(text), set(), set()
    for name, item in items:
        w = fold(item)
        m = min(window, len(w))
        strings = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1 if m else 0):
            if tuple(words[i : i + m]) in strings:
                hit.update(range(i, i + m))
                met.add(str(name))
    return len(words), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block", [16_000_000, 60])
def test_decontamination(spark, docs, block):
    items = [(1, "Hest, THOU ereaat"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15"), (10, "stop"), (3, None), (4, "--"), (5, "long7 long8 long9 long10 long11 long12 long13 long14 long15 long16 long17 long18 long20"), (2, "two three one two")]
    items += [(r["doc_id"] + 100, " ".join((r["text"] or "").split()[5:40])) for r in docs.where("doc_id % 7 = 0").collect()][:6]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = op06_decontaminate.decontaminate(docs, benchmark, block_bytes=block)
    expected = sorted(((r["doc_id"], *hits(r["text"], items)) for r in docs.collect()), key=repr)
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected
    kept = op06_decontaminate.keep_clean(docs, benchmark, block_bytes=block)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not x[-1] for x in expected)
    none = op06_decontaminate.decontaminate(docs, benchmark.where("false"))
    assert none.where("n_hit > 0 or contaminated").count() == 0 and none.count() == len(expected)


def test_quality_learns_and_holds_out(spark, odd_docs, empty_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = op02_quality.train(docs, labels)
    got = op02_quality.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (got.predicted == (got.score >= 0.3)).all()
    odd = op02_quality.score(odd_docs, model).toPandas()
    assert len(odd) == odd_docs.count() and odd.score.between(0, 1).all()
    kept = op02_quality.keep_good(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == int(odd.predicted.sum())
    same = op02_quality.train(docs.withColumn("lang", docs.text), labels.withColumn("toxic", labels.quality))
    assert np.allclose(same.good.mean, model.good.mean)
    none = op02_quality.train(empty_docs, labels.where("false"))
    assert op02_quality.score(odd_docs, none).where("score is null").count() == 0


def test_quality_scores_equal_densities_by_inverse(spark, small_docs):
    """The whole operator by loops: class means and covariances, their inverses and determinants, for every document."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    told = {r["doc_id"]: r["quality"] for r in labels.collect()}
    docs = [(r["doc_id"], r["text"]) for r in small_docs.collect()]
    held = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d, _ in docs}
    x = {d: [float(v) for v in op02_quality.statistics((t or "").encode())] for d, t in docs}
    size = op02_quality.N_FEATURES
    means, scatter, count = {}, {}, {}
    for k in (0, 1):
        own = [x[d] for d, _ in docs if told.get(d) == k and not held[d]]
        count[k] = len(own)
        means[k] = [sum(v[i] for v in own) / len(own) for i in range(size)]
        scatter[k] = np.array([[sum((v[i] - means[k][i]) * (v[j] - means[k][j]) for v in own) / len(own) for j in range(size)] for i in range(size)])
    pooled = (count[0] * scatter[0] + count[1] * scatter[1]) / (count[0] + count[1])
    inverse, log_det = {}, {}
    for k in (0, 1):
        s = 0.9 * scatter[k] + 0.1 * pooled
        s = 0.98 * s + 0.02 * (sum(s[i][i] for i in range(size)) / size) * np.eye(size)
        inverse[k], log_det[k] = np.linalg.inv(s), np.log(np.linalg.det(s))
    got = {r["doc_id"]: r for r in op02_quality.score(small_docs, op02_quality.train(small_docs, labels)).collect()}
    assert len(got) == len(docs)
    for d, _ in docs:
        z = np.log((count[1] + 1) / (count[0] + 1))
        for k, sign in ((1, 1), (0, -1)):
            away = np.array(x[d]) - means[k]
            z += sign * -0.5 * (log_det[k] + away @ inverse[k] @ away)
        assert got[d]["held_out"] == held[d]
        assert got[d]["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -500, 500))), abs=1e-7)
        assert got[d]["predicted"] == int(got[d]["score"] >= 0.3)


def test_labels_that_are_no_labels(spark, small_docs):
    ids = sorted(r["doc_id"] for r in small_docs.collect())[:60]
    good = [(d, str(i % 2)) for i, d in enumerate(ids)]
    bad = [(ids[0], "1"), (ids[0], "0"), (ids[1], "0.7"), (ids[2], "fine"), (ids[3], None), (None, "1"), (ids[4], "2")]
    clean = spark.createDataFrame([x for x in good if x[0] != ids[0]], "doc_id long, quality string")
    odd = spark.createDataFrame(good + bad + good[5:9], "doc_id long, quality string")
    one, two = (op02_quality.train(small_docs, x) for x in (clean, odd))
    assert np.allclose(one.good.mean, two.good.mean) and np.allclose(one.bad.factor, two.bad.factor) and one.log_odds == two.log_odds


def test_clashing_columns_stay(spark, odd_docs):
    """keep_clean and keep_cleaned keep columns that are called as their own helpers."""
    names = ("_row", "_bad_row", "gone", "gone_id", "gone_digest", "n_lines", "n_removed", "_n_lines", "_gone", "_hits", "_items", "_n_words", "_id")
    frame = odd_docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    benchmark = spark.createDataFrame([(1, "one two three one"), (2, "w1 w2 w3")], "item_id long, text string")
    for block in (16_000_000, 4):
        kept = op06_decontaminate.keep_clean(frame, benchmark, block_bytes=block)
        assert kept.columns == frame.columns and kept.where(" and ".join(f"`{n}` = {i}" for i, n in enumerate(names))).count() == kept.count() > 0
    kept = op07_lines.keep_cleaned(frame, min_sites=2)
    assert kept.columns == frame.columns and kept.where(" and ".join(f"`{n}` = {i}" for i, n in enumerate(names))).count() == kept.count() > 0


def test_empty_tables(spark, empty_docs):
    assert op08_tokens.count_tokens(empty_docs, vocabulary("word_bpe_49k.json")).count() == 0
    assert op09_rules.quality_rules(empty_docs).count() == 0
    assert op06_decontaminate.decontaminate(empty_docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
