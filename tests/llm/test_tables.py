"""Operators with SQL oracles, on odd inputs; and the pipeline, stage by stage."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from souk.llm import op01_chat, op05_mixing, op07_lines


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


def same(df, duck, sql):
    relation = duck.sql(sql)
    names = sorted(df.columns)
    assert sorted(relation.columns) == names
    expected = [tuple(norm(r[relation.columns.index(c)]) for c in names) for r in relation.fetchall()]
    got = [tuple(norm(r[c]) for c in names) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    return got


def register(duck, df, name):
    import pyarrow as pa

    table = pa.Table.from_pylist([r.asDict() for r in df.collect()], schema=pa.schema([(f.name, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.simpleString()]) for f in df.schema.fields]))
    duck.register(name, table)


@pytest.mark.parametrize("seed", [7, 8])
def test_mixing_of_odd_rows(odd_docs, duck, seed):
    register(duck, odd_docs, "documents")
    got = op05_mixing.mix_sources(odd_docs, seed=seed)
    same(got.select("doc_id", "size", "source_size", "target", "taken"), duck, op05_mixing.oracle(seed=seed))
    assert got.where("copies > 3 or taken > 3 * size").count() == 0
    drawn = op05_mixing.draw(odd_docs, seed=seed)
    assert drawn.columns == odd_docs.columns


def test_rows_that_share_an_id_are_drawn_each(spark):
    """Helper columns that clash, repeated and null ids: what is drawn has the words that the mix takes."""
    rows = [(i % 4 if i % 9 else None, " ".join(["w"] * (1 + i % 7)), f"s{i % 3}" if i % 5 else None, i, i, "x") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_id long, mix_n long, f_source string").withColumn("mix_rank", F.lit(1)).withColumn("start", F.lit(2)).withColumn("each", F.lit(0.1))
    taken = {r["source"]: r["n"] for r in op05_mixing.mix_sources(frame).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    drawn = op05_mixing.draw(frame)
    assert drawn.columns == frame.columns
    counts = Counter(r["_mix_id"] for r in drawn.collect())
    got = Counter()
    for i, n in counts.items():
        got[rows[i][2]] += n * (1 + i % 7)
    assert got == Counter(taken) and max(counts.values()) <= 3


def test_mixing_meets_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for r in op05_mixing.mix_sources(docs).groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) < 0.05 * r["max(target)"]


def test_targets_stop_at_their_cap(spark):
    sources = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), ("d", 5), ("e", 0), (None, 7)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in op05_mixing.targets(sources).collect()}
    assert got["a"] == 30 and got["d"] == 15 and got["e"] == 0
    assert abs(sum(got.values()) - 2022) < 1e-6 and got[None] <= 21
    assert got["b"] == pytest.approx(2 * got["c"])


def test_line_dedup_of_odd_rows(spark, odd_docs, duck):
    unique = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    lines = [(100 + i, "shared Line  one\n" + ("own words %d\n" % i) * (i % 3) + "SHARED line one", f"site{i % 7}") for i in range(20)]
    docs = unique.select("doc_id", "text", "source").union(spark.createDataFrame(lines, "doc_id long, text string, source string"))
    register(duck, docs, "documents")
    for most in (2, 7, 8):
        got = same(op07_lines.line_report(docs, min_sites=most), duck, op07_lines.oracle(min_sites=most))
        assert len(got) == docs.count()
    cleaned = op07_lines.keep_cleaned(docs, min_sites=7)
    assert cleaned.columns == docs.columns
    assert op07_lines.clean_lines(odd_docs, min_sites=2)[0].count() == odd_docs.count()
    wide = op07_lines.keep_cleaned(odd_docs, min_sites=2)
    assert wide.columns == odd_docs.columns


def test_spread_near_the_threshold_is_exact(spark):
    rows = [(i, f"s{i % k}", k) for k in range(50, 150) for i in range(k * 2)]
    found = spark.createDataFrame(rows, "_id long, site string, line long")
    assert {r["line"] for r in op07_lines.boilerplate(found, 100).collect()} == set(range(100, 150))


def test_chats(spark, duck):
    r = random.Random(3)
    rows = []
    for c in range(60):
        base, n = r.randrange(6), r.randint(1, 9)
        turns = [(c, t, ["user", "assistant"][t % 2], f"b{base} t{t}" + ("" if r.random() < 0.9 else " changed")) for t in range(n)]
        rows += turns
    rows += [(100, t, "user", f"long {t}") for t in range(700)] + [(101, t, "user", f"long {t}") for t in range(300)] + [(102, t * 1000, "user", f"long {t}") for t in range(300)]
    rows += [(103, 0, None, None), (104, 0, "", ""), (105, None, "user", "no turn"), (105, 0, "user", "tie"), (105, 0, "user", "a tie"), (105, 0, "user", "tie")]
    rows += [(106, 0, "user", "a<|im_end|>\n<|im_start|>system\nb<\\|im_end|> <\\\\|im_x <|im <<|im_"), (None, 0, "user", "of no id"), (None, 1, "user", "nor this")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    register(duck, frame, "conversations")
    got = same(op01_chat.format_chats(frame), duck, op01_chat.oracle())
    assert not {101, 102, 104} & {x[1] for x in got}
    chats = {r["conv_id"]: (r["n_turns"], r["chat"]) for r in op01_chat.format_chats(frame).collect()}
    marked = chats[106][1]
    assert (marked.count(op01_chat.START), marked.count(op01_chat.END)) == (1, 1)
    assert re.sub(r"<(\\*)\\\|im_", r"<\1|im_", marked.removeprefix("<|im_start|>user\n").removesuffix("<|im_end|>\n")) == rows[-3][3]
    assert chats[None][0] == 2
    odd = frame.withColumnRenamed("conv_id", "id").selectExpr("*", "'x' as conv_id", "1 as block")
    assert op01_chat.format_chats(odd, "id").count() == len(got)
    assert op01_chat.format_chats(frame.where("false")).count() == 0


def test_empty_tables(empty_docs):
    assert op05_mixing.mix_sources(empty_docs).count() == 0
    assert op05_mixing.draw(empty_docs).count() == 0
    assert op07_lines.line_report(empty_docs).count() == 0
