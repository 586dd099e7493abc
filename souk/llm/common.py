"""What the operators of this subpackage share: shared storage, batches of texts, packed integers."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: words are maximal runs of bytes other than these.
WORD_SEPARATORS = b" \t\n\v\f\r"
#: A batch of documents is worked on in slices of about this many bytes of text.
SLICE_BYTES = 12_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may do without; it gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="souk-checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written once to shared storage and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    return written(spark, df, f"{shared_dir(spark)}/souk/{name}-{uuid.uuid4().hex}")


def written(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null becomes empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes of text; a longer document is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.fromiter((0 if x is None else x for x in pc.binary_length(column).to_pylist()), np.int64, batch.num_rows)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)


def with_text(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    """Only the named columns, as _id, _text and the others; any other column of docs cannot clash."""
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *[F.col(c).alias(f"_{c}") for c in others])


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column is called so."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts(spark: SparkSession, amount: float, each: float) -> int:
    """Tasks for an amount (of bytes or rows) if none is to hold much more than `each`, and no fewer than the session's."""
    return max(shuffle_partitions(spark), math.ceil((amount or 0) / each))


def text_bytes(docs: DataFrame, text: str = "_text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def pack_gaps(positions: np.ndarray) -> bytes:
    """Integers as gaps, in the narrowest width that few of them overflow: small for ascending ones."""
    gaps = np.diff(positions, prepend=0).astype(np.int64)
    if not gaps.size:
        return b""
    best = None
    for code, kind in ((1, np.uint8), (2, np.uint16)):
        top = np.iinfo(kind).max
        over = np.flatnonzero((gaps >= top) | (gaps < 0))
        size = gaps.size * code + 8 * over.size
        if best is None or size < best[0]:
            best = (size, code, kind, top, over)
    _, code, kind, top, over = best
    small = np.where(gaps < 0, top, np.minimum(gaps, top)).astype(kind)
    return bytes([code]) + np.int64(over.size).tobytes() + gaps[over].tobytes() + small.tobytes()


def unpack_gaps(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.int64)
    kind = np.uint8 if blob[0] == 1 else np.uint16
    n_over = int(np.frombuffer(blob, np.int64, 1, 1)[0])
    over = np.frombuffer(blob, np.int64, n_over, 9)
    gaps = np.frombuffer(blob, kind, -1, 9 + 8 * n_over).astype(np.int64)
    if n_over:
        gaps[gaps == np.iinfo(kind).max] = over
    return np.cumsum(gaps)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return edges[::2], edges[1::2]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
