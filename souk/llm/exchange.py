"""Global occurrence counts of document pieces, with bounded groups and packed shuffles.

A piece is anything with a 64-bit key: a window of words, a line. Documents are read in slices. Each slice sends, to each
bucket of the key space, one row that packs the distinct keys it holds there with their local counts. A bucket adds up
the counts of each key over all slices and answers every slice with the totals that matter, again packed. A key that a
third of all documents hold is one entry for each slice that has it, so no group grows with the copies of a key.

The number of buckets and of tasks follows the bytes of text, so a bucket stays at some megabytes at any input size. What is
packed is one row for each slice and bucket, never more rows than there are pieces.

The buckets come from a second hash of the piece, independent of the key: a false match needs both to agree.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from souk.llm.common import mix, pack_gaps, parts, slices, text_bytes, unpack_gaps

CELL = "bucket long, slice long, n int, keys binary, counts binary, places binary, head binary"
ANSWER = "slice long, places binary, totals binary, head binary"
#: Buckets for each task, so that hashing buckets to tasks stays even.
BUCKETS_PER_PARTITION = 4
#: Bytes of text whose pieces a task counts: with nine bytes or so a word's piece, about twice as many bytes.
TEXT_PER_TASK = 12_000_000


def narrow(values: np.ndarray) -> bytes:
    """Non-negative integers in the narrowest width that holds them all."""
    width = 1 if not values.size or values.max() < 1 << 8 else 2 if values.max() < 1 << 16 else 8
    return bytes([width]) + values.astype(f"u{width}").tobytes()


def widen(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"u{blob[0]}", -1, 1).astype(np.int64)


def count_pieces(docs: DataFrame, extract: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, object]], least: int, finish: Callable[[object, np.ndarray, np.ndarray], pd.DataFrame], schema: str, text: str = "_text") -> DataFrame:
    """finish(head, places, totals) of every slice of docs.

    extract(slice) gives the key and the bucket hash of each piece in order, and a head (any picklable object) for
    finish. places are the indexes of the pieces whose key occurs `least` times or more in docs; totals are those counts.
    docs must give the same rows in the same order when a task is repeated (a scan or a written table does).
    """
    n_tasks = parts(docs.sparkSession, text_bytes(docs, text), TEXT_PER_TASK)
    n_buckets = BUCKETS_PER_PARTITION * n_tasks

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(slices(batches, text)):
            number = part << 32 | seq
            keys, spread, head = extract(batch)
            order = np.argsort(keys, kind="stable")
            ordered = keys[order]
            new = np.ones(keys.size, bool)
            new[1:] = ordered[1:] != ordered[:-1]
            begins = np.flatnonzero(new)
            counts = np.diff(begins, append=keys.size)
            first = order[begins]
            # later copies of a key in this slice, by the place of their first
            again = np.flatnonzero(~new)
            twins = (order[again], np.repeat(first, counts - 1))
            by_place = np.argsort(twins[0], kind="stable")
            twins = tuple(np.diff(x[by_place], prepend=0).astype(np.int32) for x in twins)
            del ordered, order, new
            bucket = (mix(spread[first]) % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((first, bucket))
            first, counts, bucket = first[order], counts[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            rows = []
            for a, b in zip([0, *cuts], [*cuts, first.size], strict=True):
                if b > a:
                    rows.append((int(bucket[a]), number, int(b - a), keys[first[a:b]].tobytes(), narrow(counts[a:b]), pack_gaps(first[a:b]), None))
            rows.append((hash(number) * 7919 % n_buckets, number, 0, b"", b"", b"", pickle.dumps((head, twins), protocol=5)))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "slice", "n", "keys", "counts", "places", "head"])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        heads, cells = group[group["n"] == 0], group[group["n"] > 0]
        out = [(s, b"", b"", h) for s, h in zip(heads["slice"], heads["head"], strict=True)]
        if len(cells):
            keys = np.concatenate([np.frombuffer(x, np.uint64) for x in cells["keys"]])
            counts = np.concatenate([widen(x) for x in cells["counts"]])
            order = np.argsort(keys)
            new = np.ones(keys.size, bool)
            new[1:] = keys[order][1:] != keys[order][:-1]
            totals = np.empty(keys.size, np.int64)
            totals[order] = np.add.reduceat(counts[order], np.flatnonzero(new))[np.cumsum(new) - 1]
            at = 0
            for s, n, places in zip(cells["slice"], cells["n"], cells["places"], strict=True):
                own = totals[at : at + n]
                at += n
                if (hit := own >= least).any():
                    out.append((s, pack_gaps(unpack_gaps(places)[hit]), narrow(own[hit]), None))
        return pd.DataFrame(out, columns=["slice", "places", "totals", "head"])

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        found = [x for x in group["head"] if x is not None]
        head, twins = pickle.loads(found[0])
        marked = [(unpack_gaps(p), widen(t)) for p, t in zip(group["places"], group["totals"], strict=True) if p]
        places = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in marked)])
        totals = np.concatenate([np.zeros(0, np.int64), *(t for _, t in marked)])
        order = np.argsort(places)
        places, totals = places[order], totals[order]
        if twins[0].size and places.size:
            own, firsts = (np.cumsum(x, dtype=np.int64) for x in twins)
            at = np.minimum(np.searchsorted(places, firsts), places.size - 1)
            hit = places[at] == firsts
            places, totals = np.concatenate([places, own[hit]]), np.concatenate([totals, totals[at[hit]]])
            order = np.argsort(places)
            places, totals = places[order], totals[order]
        return finish(head, places, totals)

    cells = docs.mapInArrow(scatter, CELL)
    answers = cells.repartition(n_tasks, "bucket").groupBy("bucket").applyInPandas(lambda g: answer(g), ANSWER)
    return answers.repartition(n_tasks, "slice").groupBy("slice").applyInPandas(lambda g: gather(g), schema)
