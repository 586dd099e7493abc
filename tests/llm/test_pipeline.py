"""The pipeline against its stages done one document at a time, and its stages on odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from souk.llm import op02_quality, op05_mixing, op07_lines  # noqa: E402
from tests.llm.test_documents import hits  # noqa: E402
from tests.llm.test_duplicates import WORDS  # noqa: E402
from tests.llm.test_similar import brute_first  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op02_quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(np.array([op02_quality.statistics(r["text"].encode())]))[0] >= 0.3]
    assert len(rows) > 0.8 * docs.count()

    def norm(line):
        return " ".join(WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), line)))

    sites, keeper = defaultdict(set), {}
    for r in rows:
        for x in {norm(x) for x in r["text"].split("\n")} - {""}:
            sites[x].add(r["source"])
            keeper[x] = min(keeper.get(x, r["doc_id"]), r["doc_id"])
    kept = []
    for r in rows:
        lines = r["text"].split("\n")
        left = [x for x in lines if not (len(sites[norm(x)]) >= op07_lines.MIN_SITES and keeper[norm(x)] != r["doc_id"])]
        if any(norm(x) for x in left) or not any(norm(x) for x in lines):
            kept.append((r["doc_id"], r["source"], "\n".join(left)))
    # the rule for near-duplicate stages: five-word similarity of 0.8 or more; and what fingerprints link
    first = brute_first([(d, t) for d, _, t in kept])
    kept = [x for x in kept if first[x[0]] == x[0]]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [x for x in kept if not hits(x[2], items)[-1]]
    frame = spark.createDataFrame(kept, "doc_id long, source string, text string")
    copies = {r["doc_id"]: r["copies"] for r in op05_mixing.mix_sources(frame).collect()}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter({(d, t): copies[d] for d, _, t in kept if copies[d]})
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


def test_stages_take_odd_rows(odd_docs, spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and no rows at all: each stage keeps the columns."""
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(str(tmp_path / f"{table}.parquet"))
    wide = odd_docs.select("*", *[F.lit("x").alias(c) for c in ("lang", "_gone", "n_lines", "mix_n", "_row", "_key_id", "digest")])
    twice = wide.unionAll(wide.where("doc_id < 8"))
    for frame in (twice, twice.where("false")):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path)).cache()
            assert out.columns == frame.columns, name
            assert frame.isEmpty() == out.isEmpty(), name
            if name == "near dedup":
                assert out.count() == out.select("doc_id", "text").distinct().count()
            docs = out if not out.isEmpty() else docs
