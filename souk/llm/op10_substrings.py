"""Substring dedup: Rabin-Karp hashes of every window of `window` words, counted over all documents.

A window's key is a polynomial in the hashes of its words, modulo 2**64, taken from running sums; a second polynomial of
other word hashes chooses its bucket, so two windows pass for one only if both agree. Windows that occur more than once
anywhere are merged into maximal removal intervals of words. Counting goes through souk.llm.exchange: about nine bytes a
window are shuffled, and a window that a third of all documents hold makes no large group.

Defined results: a null text has no words; a text of fewer words than the window loses none; rows that repeat are documents of
their own, so their windows repeat; an empty table gives no rows. Nothing is cut: texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import binary_column, mix, pack_gaps, slices, unpack_gaps, with_text
from souk.llm.exchange import count_pieces

#: Fixed by the contract.
WINDOW = 35
#: Odd multipliers of the two polynomials.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Words whose hashes a worker keeps.
KEPT_WORDS = 500_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64."""
    out = np.full(n, np.uint64(base))
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def window_hashes(values: np.ndarray, window: int, base: int) -> np.ndarray:
    """The polynomial of every window of values, highest power first in meaning, equal for equal windows."""
    n = values.size
    if n < window:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers(base, n), dtype=np.uint64)])
    return (sums[window:] - sums[:-window]) * powers(pow(base, -1, 1 << 64), n - window + 1)


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(_id, _digest, _spans) of the rows of docs (_id, _digest, _text) that hold repeated windows: packed edges of word runs."""
    kind = docs.schema["_id"].dataType.simpleString()
    hashes = WordHashes()

    def extract(batch: pa.RecordBatch):
        values, lengths = [], []
        for text in binary_column(batch, "_text"):
            words = text.split()
            lengths.append(len(words))
            values.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
        lengths = np.array(lengths, np.int64)
        values = np.concatenate(values)
        ends = np.cumsum(lengths)
        whole = np.repeat(ends, lengths)[: max(0, values.size - window + 1)] >= np.arange(window, values.size + 1)
        keys = window_hashes(values, window, BASES[0])[whole]
        spread = window_hashes(mix(values ^ np.uint64(BASES[1])), window, BASES[1])[whole]
        return mix(keys), spread, (batch.column(0).to_pylist(), batch.column(1).to_pylist(), np.maximum(lengths - window + 1, 0))

    def finish(head, places: np.ndarray, totals: np.ndarray) -> pd.DataFrame:
        ids, digests, n_windows = head
        ends = np.cumsum(n_windows)
        owner = np.searchsorted(ends, places, side="right")
        cuts = np.flatnonzero(np.diff(owner)) + 1
        out = []
        for a, b in zip([0, *cuts], [*cuts, places.size], strict=True):
            if b > a:
                d = int(owner[a])
                begins = places[a:b] - (ends[d] - n_windows[d])
                apart = np.flatnonzero(np.diff(begins) > window)
                starts = begins[np.concatenate([[0], apart + 1])]
                stops = begins[np.concatenate([apart, [b - a - 1]])] + window
                out.append((ids[d], digests[d], pack_gaps(np.stack([starts, stops], 1).ravel())))
        return pd.DataFrame(out, columns=["_id", "_digest", "_spans"]).astype({"_id": object})

    return count_pieces(docs, extract, 2, finish, f"_id {kind}, _digest long, _spans binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text, kept_sha256) for every row; spans: [begin, end) of words, flattened."""
    source = with_text(docs, id_col, text_col).select("_id", F.xxhash64("_text").alias("_digest"), "_text")
    # rows with the same id and text have the same spans: one is enough for the join
    spans = repeated_spans(source, window).dropDuplicates(["_id", "_digest"]).withColumnsRenamed({"_id": "_span_id", "_digest": "_span_digest"})
    joined = source.join(spans, (F.col("_digest") == F.col("_span_digest")) & F.col("_id").eqNullSafe(F.col("_span_id")), "left").select("_id", "_text", "_spans")
    kind = source.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out = []
            for text, packed in zip(binary_column(batch, "_text"), batch.column(2).to_pylist(), strict=True):
                words, edges = text.split(), unpack_gaps(packed or b"").tolist()
                kept, at = [], 0
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                joined_text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), edges, joined_text.decode(), hashlib.sha256(joined_text).hexdigest()))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "spans", "kept_text", "kept_sha256"])

    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, spans array<long>, kept_text string, kept_sha256 string")
