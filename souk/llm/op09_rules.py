"""Quality rules: base counts of a text, and the share of its words that stand in lines many documents of its host hold.

Lines are normalised (ASCII lower case, digits to 0, white space to one space) and hashed with their host. A line is over
the limit if the distinct documents of its host that hold it are more than `min_docs` and more than `max_share` of the
host's documents. Such lines are removed; a document that keeps less than `min_kept` of its words is depleted and
rejected, as is one that fails the base rules. The host is the source of a document.

Lines are counted and joined back to their documents by Spark's own aggregates and joins, partly summed up before each shuffle;
a line that a third of all documents hold makes no large group.

Defined results: a null or empty text has no words, so it fails the base rules; a null host is a host of its own; rows that
repeat are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import WORD_SEPARATORS, binary_column, materialize, slices, with_text

#: Fixed by the contract.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Lines on more documents of a host than both are boilerplate; a document must keep this share of its words.
MIN_DOCS = 10
MAX_SHARE = 0.02
MIN_KEPT = 0.5

_NOT_CODE_POINTS = WORD_SEPARATORS + bytes(range(0x80, 0xC0))
_DIGITS = bytes.maketrans(b"0123456789", b"0000000000")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class WordIds(dict):
    """Numbers words as they come; emptied when full, so numbers hold for one text at a time."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeat_words(words: list[bytes], ids: WordIds) -> int:
    """Words that stand in a 3-word window found twice or more in the text."""
    if len(words) < 4:
        return 0
    if len(ids) > 1 << 20:
        ids.clear()
    x = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    if x.max() >= 1 << 21:  # a single text with millions of distinct words
        x = np.unique(x, return_inverse=True)[1]
        pairs = np.unique(x[:-2] * (x.max() + 1) + x[1:-1], return_inverse=True)[1]
        windows = pairs * (x.max() + 1) + x[2:]
    else:
        windows = (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(words), bool)
    at = np.concatenate([order[1:][same], order[:-1][same]])
    for k in range(3):
        hit[at + k] = True
    return int(hit.sum())


def base_counts(text: bytes, ids: WordIds) -> tuple[int, int, int, int, int]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(text.translate(None, _NOT_CODE_POINTS)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words, ids)


def normal_lines(text: bytes) -> dict[bytes, int]:
    """Normalised line -> words in all its occurrences in the text."""
    found: dict[bytes, int] = {}
    for line in text.lower().translate(_DIGITS).split(b"\n"):
        words = line.split()
        if words:
            key = b" ".join(words)
            found[key] = found.get(key, 0) + len(words)
    return found


def _documents(source: DataFrame) -> DataFrame:
    """(doc_id, host, the five counts, lines) for every row of source (_id, _host, _text): for each distinct line two hashes of host and
    line, and how many words its occurrences have."""
    kind = source.schema["_id"].dataType.simpleString()
    ids = WordIds()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            low, high, words, ends, counts = [], [], [], [0], []
            for host, text in zip(batch.column(1).to_pylist(), binary_column(batch, "_text"), strict=True):
                counts.append(base_counts(text, ids))
                seed = b"-" if host is None else b"+" + host.encode() + b"\n"
                for line, n in normal_lines(text).items():
                    h = xxhash.xxh3_128_intdigest(seed + line)
                    low.append(h & 0xFFFFFFFFFFFFFFFF)
                    high.append(h >> 64)
                    words.append(n)
                ends.append(len(low))
            lines = pa.StructArray.from_arrays([*(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (low, high)), pa.array(words, pa.int64())], names=["low", "high", "words"])
            columns = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines)], names=["doc_id", "host", *COUNTS, "lines"])

    return source.mapInArrow(run, f"doc_id {kind}, host string, {', '.join(f'{c} long' for c in COUNTS)}, lines array<struct<low: long, high: long, words: long>>")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_kept: float = MIN_KEPT) -> DataFrame:
    """(doc_id, host, the five counts, base_failed, boilerplate_words, kept) for every row of docs."""
    source = with_text(docs, id_col, text_col, host_col).withColumn("_host", F.col(f"_{host_col}").cast("string")).select("_id", "_host", "_text")
    found = materialize(_documents(source).withColumn("row", F.monotonically_increasing_id()), "rules-documents")
    lines = found.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.*")
    common = lines.groupBy("low", "high").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > min_docs).withColumnsRenamed({"low": "l", "high": "h"})
    hosts = found.groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("host_docs"))
    over = lines.join(common, (F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))).join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("docs") > F.lit(max_share) * F.col("host_docs"))
    gone = over.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("gone"))
    told = found.drop("lines").join(gone, F.col("row") == F.col("r"), "left").withColumn("boilerplate_words", F.coalesce("gone", F.lit(0).cast("long")))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return told.select("doc_id", "host", *COUNTS, base.alias("base_failed"), "boilerplate_words").withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("boilerplate_words") >= F.lit(min_kept) * F.col("n_words")))
