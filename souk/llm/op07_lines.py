"""Line dedup by distinct-site spread: HyperLogLog sketches per line, exact counts near the threshold.

Lines are normalised (ASCII lower case, white space to one space) and hashed. Each line's sites are gathered in a
HyperLogLog sketch, merged by aggregation. A line whose estimate is clearly above the threshold is boilerplate, one clearly
below is not; for those between, the distinct sites are counted exactly. Boilerplate is removed from every document but
the one with the smallest id that holds it, so no text is lost from the corpus.

A line that a third of all documents hold is pre-aggregated before every shuffle; where its occurrences are joined to its
verdict, Spark splits the hot partition.

Defined results: a null text has no lines and stays null; lines without words are neither counted nor removed; a null site
counts for no line, so documents without a site are only cleaned of others' boilerplate; rows that repeat are each cleaned, and the
smallest id keeps its lines in all its rows; a null id keeps nothing that is boilerplate; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from souk.llm.common import binary_column, materialize, slices, unused, with_text

#: Lines on at least so many distinct sites are boilerplate.
MIN_SITES = 10
#: log2 of the registers of a sketch, and how far an estimate may be from the count (three standard errors).
SKETCH_BITS = 10
MARGIN = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def line_key(line: bytes) -> int | None:
    """The hash of a normalised line, as a signed long; None for a line without words."""
    words = line.lower().split()
    if not words:
        return None
    h = xxhash.xxh3_64_intdigest(b" ".join(words))
    return h - (1 << 64) if h >> 63 else h


def boilerplate(occurrences: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN) -> DataFrame:
    """(line, keeper) of the lines on min_sites distinct sites or more. occurrences: (_id, site, line)."""
    sketched = occurrences.groupBy("line").agg(F.hll_sketch_agg(F.col("site"), F.lit(SKETCH_BITS)).alias("sketch"), F.min("_id").alias("keeper"))
    rated = materialize(sketched.select("line", "keeper", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= min_sites * (1 - margin) - 1), "line-spread")
    clear = F.col("sites") > min_sites * (1 + margin) + 1
    near = rated.where(~clear).select(F.col("line").alias("near_line"), F.col("keeper").alias("near_keeper"))
    exact = occurrences.join(near, F.col("line") == F.col("near_line")).groupBy("line").agg(F.count_distinct("site").alias("n"), F.first("near_keeper").alias("keeper")).where(F.col("n") >= min_sites)
    return rated.where(clear).select("line", "keeper").unionAll(exact.select("line", "keeper"))


def _occurrences(source: DataFrame) -> DataFrame:
    """(_id, _digest, site, line): the distinct lines of each document."""
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            at, keys = [], []
            for i, text in enumerate(binary_column(batch, "_text")):
                own = {line_key(x) for x in text.split(b"\n")} - {None}
                keys += own
                at += [i] * len(own)
            rows = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(rows) for c in ("_id", "_digest", "_site")), pa.array(keys, pa.int64())], names=["_id", "_digest", "site", "line"])

    return source.select("_id", "_digest", "_site", "_text").mapInArrow(run, f"_id {kind}, _digest long, site string, line long")


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> tuple[DataFrame, str, str]:
    """(All rows and columns of docs with boilerplate lines taken out of the text and two columns added, the names of these: the number
    of lines with words, and of those removed; both are names that docs has not)."""
    source = with_text(docs, id_col, text_col, site_col).select("_id", F.xxhash64("_text").alias("_digest"), F.col(f"_{site_col}").cast("string").alias("_site"), "_text")
    found = materialize(_occurrences(source), "lines")
    verdicts = boilerplate(found, min_sites).select(F.col("line").alias("bad_line"), "keeper")
    bad, gone_id, gone_digest, n_lines, n_removed = unused(docs.columns, "gone", "gone_id", "gone_digest", "n_lines", "n_removed")
    gone = found.join(verdicts, (F.col("line") == F.col("bad_line")) & ~F.col("_id").eqNullSafe(F.col("keeper"))).groupBy(F.col("_id").alias(gone_id), F.col("_digest").alias(gone_digest)).agg(F.collect_set("line").alias(bad))
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col(gone_id)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(gone_digest)), "left").drop(gone_id, gone_digest)
    schema = StructType([*(StructField(f.name, StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields), StructField(n_lines, LongType()), StructField(n_removed, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts, counts, removed = [], [], []
            nulls = batch.column(batch.schema.get_field_index(text_col)).is_null().to_pylist()
            for text, null, lines in zip(binary_column(batch, text_col), nulls, batch.column(batch.schema.get_field_index(bad)).to_pylist(), strict=True):
                all_lines = text.split(b"\n")
                hashes = set(lines or ())
                kept = [x for x in all_lines if line_key(x) not in hashes] if hashes else all_lines
                texts.append(None if null else b"\n".join(kept).decode())
                counts.append(sum(1 for x in all_lines if x.strip()))
                removed.append(len(all_lines) - len(kept))
            columns = [pa.array(texts, pa.string()) if f.name == text_col else batch.column(i) for i, f in enumerate(batch.schema) if f.name != bad]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64())], names=[*(f.name for f in batch.schema if f.name != bad), n_lines, n_removed])

    return joined.mapInArrow(run, schema), n_lines, n_removed


def keep_cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """The rows of docs with cleaned texts and the same columns; rows that had lines and lost all of them go."""
    cleaned, n_lines, n_removed = clean_lines(docs, id_col, text_col, site_col, min_sites)
    return cleaned.where((F.col(n_lines) == 0) | (F.col(n_removed) < F.col(n_lines))).drop(n_lines, n_removed)


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_md5) for every row; kept_md5 of the cleaned text (null: of the empty one)."""
    cleaned, n_lines, n_removed = clean_lines(docs.select(id_col, text_col, site_col), id_col, text_col, site_col, min_sites)
    return cleaned.select(F.col(id_col).alias("doc_id"), F.col(n_lines).alias("n_lines"), F.col(n_removed).alias("n_removed"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("kept_md5"))


#: The same in DuckDB SQL; {documents} and {min_sites} are filled in. Ids must be unique.
SQL = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM {documents}),
keyed AS (
  SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS k FROM lines),
bad AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= {min_sites}),
flagged AS (SELECT y.*, b.k IS NOT NULL AND y.doc_id IS DISTINCT FROM b.keeper AS gone FROM keyed y LEFT JOIN bad b ON y.k = b.k)
SELECT doc_id, count(*) FILTER (WHERE k <> '')::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM flagged GROUP BY doc_id
"""


def oracle(documents: str = "documents", min_sites: int = MIN_SITES) -> str:
    return SQL.replace("{documents}", documents).replace("{min_sites}", str(min_sites))
