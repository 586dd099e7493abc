"""Exact substring dedup over bytes: Burrows-Wheeler interval expansion, bounded by the minimum length.

Every byte goes that a string of `length` bytes covers which also starts in a document with a smaller id. One transform of the
whole corpus fits no machine, so strings are first brought together with all their equals:

1. Each string belongs to the least hash among the `KMER`-byte strings within it. Neighbouring strings with the same least
   hash form a segment. Equal strings have equal least hashes, so they are in segments of the same hash.
2. Equal segments collapse to the one in the smallest document: all others are covered by it, whole. What is sent for a
   segment is packed in 14 bytes: hash, content hash, document, place and length.
3. Where one hash has several different segments in several documents, these segments' bytes are brought together by the
   hash, and the Burrows-Wheeler expansion of souk.llm.suffix finds all strings that they share. It compares the bytes
   themselves, of those parts of the segments whose strings' hashes occur twice. Of each set of equal strings, all those outside the smallest document are hits.
4. Covered segments and hits are merged into maximal runs of bytes for each document.

Groups stay small whatever the skew. A segment that a third of all documents hold is one entry for each slice of documents
that has it, and copies within a slice are settled there. The edges of a common passage give each document a segment of its
own under one hash: where a hash has more than HOT different segments in a bucket, its strings are dealt out one by one, by
a hash of all their bytes, and a slice sends each of them once, so that equal strings meet and no others need to.

Defined results: a null text is empty; texts shorter than `length` lose nothing; rows with equal ids are one document, so they
take nothing from each other; rows with a null id are kept whole and cover nothing; an empty table gives no rows. Equal
segments are told by 80 bits of two hashes and their bucket (about one false match expected in 10^13 comparisons within
a hash).
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import binary_column, materialize, mix, pack_gaps, parts, runs, slices, text_bytes, unpack_gaps, with_text
from souk.llm.exchange import BUCKETS_PER_PARTITION, TEXT_PER_TASK, narrow, widen
from souk.llm.op10_substrings import powers
from souk.llm.suffix import SENTINEL, shared_prefix_groups

#: Fixed by the contract.
LENGTH = 50
#: Bytes of the strings whose least hash says where a longer string belongs.
KMER = 26
#: Different segments of one hash above which their strings are dealt out one by one.
HOT = 2000
_BASE, _CONTENT = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MESSAGE = "bucket long, slice long, payload binary"


def _block_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k bytes, from hashes of blocks whose sizes double."""
    n = data.size - k + 1
    level, size, done, out = mix(data.astype(np.uint64) + np.uint64(1)), 1, 0, None
    while True:
        if k & size:
            part = level[done : done + n]
            out = part if out is None else out * np.uint64(pow(_BASE, size, 1 << 64)) + part
            done += size
        if size * 2 > k:
            return mix(out)
        level = level[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + level[size:]
        size *= 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n, level, size = values.size - width + 1, values, 1
    while size * 2 <= width:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    return np.minimum(level[:n], level[width - size : width - size + n])


def segments(data: np.ndarray, length: int = LENGTH, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash, content hash) of the segments of a text; neighbours overlap by length - 1 bytes."""
    none = np.zeros(0, np.int64)
    if data.size < length:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    least = _least(_block_hashes(data, kmer), length - kmer + 1)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    begin = np.concatenate([[0], cut])
    end = np.concatenate([cut, [least.size]]) + length - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(77)) * powers(_CONTENT, data.size), dtype=np.uint64)])
    content = mix((sums[end] - sums[begin]) * powers(pow(_CONTENT, -1, 1 << 64), data.size)[begin] + (end - begin).astype(np.uint64))
    return begin, end, least[begin], content


def _six(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _message(rows: list[tuple[int, int, object]]) -> pa.RecordBatch:
    buckets, numbers, payloads = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(numbers, pa.int64()), pa.array([pickle.dumps(p, protocol=5) for p in payloads], pa.binary())], names=["bucket", "slice", "payload"])


def _cells(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The entries of each bucket, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for own in np.split(order, cuts):
        if own.size:
            yield int(bucket[own[0]]), own


def _spread(number: int, n_buckets: int) -> int:
    """A bucket for what only passes through on its way back to its slice."""
    return int(mix(np.array([number], np.uint64))[0] % np.uint64(n_buckets))


def merge(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Edges of the union of intervals."""
    if not begin.size:
        return np.zeros(0, np.int64)
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    apart = np.flatnonzero(begin[1:] > end[:-1])
    return np.stack([begin[np.concatenate([[0], apart + 1])], end[np.concatenate([apart, [begin.size - 1]])]], 1).ravel()


class _Slice:
    """Documents of a slice in one line of places, a byte apart."""

    def __init__(self, sizes: list[int]):
        self.starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64) + 1)])

    @staticmethod
    def owners(starts: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(starts, places, side="right") - 1


def _by_owner(owner: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal owners in an ascending array."""
    if owner.size:
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [owner.size]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(owner[a]), slice(a, b)


def find_segments(docs: DataFrame, length: int, n_tasks: int) -> DataFrame:
    """(_id, _digest, _covered, _begins, _sizes, _hashes, _hots): for documents that have any, edges of what equal segments cover, and
    the segments to compare byte by byte."""
    n_buckets, hot = BUCKETS_PER_PARTITION * n_tasks, HOT
    kind = docs.schema["_id"].dataType.simpleString()

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(slices(batches, "_text")):
            number = part << 32 | seq
            ids, digests, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch, "_text")
            order = sorted((i for i, x in enumerate(ids) if x is not None), key=lambda i: (ids[i], digests[i]))
            if not order:
                continue
            line = _Slice([len(texts[i]) for i in order])
            found = [segments(np.frombuffer(texts[i], np.uint8), length) for i in order]
            counts = [f[0].size for f in found]
            shift = np.repeat(line.starts[:-1], counts)
            begin, end = np.concatenate([f[0] for f in found]) + shift, np.concatenate([f[1] for f in found]) + shift
            hashes, content = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
            doc = np.repeat(np.array([ids[i] for i in order], np.int64), counts)
            # settle copies within the slice: only the smallest document's segments go on
            by_content = np.argsort(content, kind="stable")
            new = np.concatenate([[True], np.diff(content[by_content].view(np.int64)) != 0])[: content.size]
            smallest = np.empty_like(doc)
            smallest[by_content] = doc[by_content][np.flatnonzero(new)[np.cumsum(new) - 1]] if content.size else 0
            later = doc > smallest
            covered = merge(begin[later], end[later])
            begin, size, hashes, content, doc = (x[~later] for x in (begin, end - begin, hashes, content, doc))
            hashes = mix(hashes)
            rows = [(b, number, ("cell", (hashes[own] >> np.uint64(32)).astype(np.uint32).tobytes(), _six(content[own]), pack_gaps(doc[own]), pack_gaps(begin[own]), narrow(size[own]))) for b, own in _cells((hashes % np.uint64(n_buckets)).astype(np.int64))]
            rows.append((_spread(number, n_buckets), number, ("head", [ids[i] for i in order], [digests[i] for i in order], line.starts, covered)))
            yield _message(rows)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        numbers, cells, out = [], [], []
        for number, blob in zip(group["slice"], group["payload"], strict=True):
            payload = pickle.loads(blob)
            if payload[0] == "head":
                out.append((number, blob))
            else:
                numbers.append(number)
                cells.append(payload[1:])
        if cells:
            h = np.concatenate([np.frombuffer(c[0], np.uint32) for c in cells])
            content = np.concatenate([_from_six(c[1]) for c in cells])
            doc = np.concatenate([unpack_gaps(c[2]) for c in cells])
            order = np.lexsort((doc, content, h))
            h_o, c_o, d_o = h[order], content[order], doc[order]
            new_h = np.concatenate([[True], h_o[1:] != h_o[:-1]])
            new_c = new_h | np.concatenate([[True], c_o[1:] != c_o[:-1]])
            first_doc = d_o[np.flatnonzero(new_c)][np.cumsum(new_c) - 1]
            begins = np.flatnonzero(new_h)
            different = np.add.reduceat(new_c.astype(np.int64), begins)
            several = different > 1
            several &= np.minimum.reduceat(first_doc, begins) != np.maximum.reduceat(first_doc, begins)
            state = np.empty(order.size, np.int8)
            state[order] = np.where(d_o > first_doc, 1, np.where(several[np.cumsum(new_h) - 1], np.where(different[np.cumsum(new_h) - 1] > hot, 3, 2), 0))
            at = 0
            for number, c in zip(numbers, cells, strict=True):
                n = len(c[0]) // 4
                own = state[at : at + n]
                at += n
                if own.any():
                    begin, size, hashes = unpack_gaps(c[3]), widen(c[4]), np.frombuffer(c[0], np.uint32)
                    one, two = own == 1, own >= 2
                    out.append((number, pickle.dumps(("reply", pack_gaps(begin[one]), narrow(size[one]), pack_gaps(begin[two]), narrow(size[two]), hashes[two].tobytes(), (own[two] == 3).tobytes()), protocol=5)))
        return pd.DataFrame(out, columns=["slice", "payload"])

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        payloads = [pickle.loads(b) for b in group["payload"]]
        _, ids, digests, starts, covered = next(p for p in payloads if p[0] == "head")
        replies = [p[1:] for p in payloads if p[0] == "reply"]
        begin = np.concatenate([covered[::2], *(unpack_gaps(r[0]) for r in replies)])
        end = np.concatenate([covered[1::2], *(unpack_gaps(r[0]) + widen(r[1]) for r in replies)])
        edges = merge(begin, end).reshape(-1, 2)
        open_begin = np.concatenate([np.zeros(0, np.int64), *(unpack_gaps(r[2]) for r in replies)])
        open_size = np.concatenate([np.zeros(0, np.int64), *(widen(r[3]) for r in replies)])
        open_hash = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(r[4], np.uint32) for r in replies)])
        open_hot = np.concatenate([np.zeros(0, bool), *(np.frombuffer(r[5], bool) for r in replies)])
        order = np.argsort(open_begin)
        open_begin, open_size, open_hash, open_hot = open_begin[order], open_size[order], open_hash[order], open_hot[order]
        made: dict[int, list] = {}
        for d, own in _by_owner(_Slice.owners(starts, edges[:, 0])):
            made.setdefault(d, [b""] * 5)[0] = pack_gaps((edges[own] - starts[d]).ravel())
        for d, own in _by_owner(_Slice.owners(starts, open_begin)):
            made.setdefault(d, [b""] * 5)[1:] = [pack_gaps(open_begin[own] - starts[d]), narrow(open_size[own]), open_hash[own].tobytes(), open_hot[own].tobytes()]
        return pd.DataFrame([(ids[d], digests[d], *x) for d, x in made.items()], columns=["_id", "_digest", "_covered", "_begins", "_sizes", "_hashes", "_hots"]).astype({"_id": object})

    messages = docs.mapInArrow(scatter, _MESSAGE)
    replies = messages.repartition(n_tasks, "bucket").groupBy("bucket").applyInPandas(meet, "slice long, payload binary")
    return replies.repartition(n_tasks, "slice").groupBy("slice").applyInPandas(settle, f"_id {kind}, _digest long, _covered binary, _begins binary, _sizes binary, _hashes binary, _hots binary")


def _strings(data: list[bytes], documents: np.ndarray, owner: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The strings of segments, once for each that the slice has: (places, owners, hashes of all bytes) in their smallest document, and
    (owners, places) of those in other documents, which need no other slice to be covered."""
    at, of, keys = [], [], []
    for o, own in _by_owner(owner):
        hashes = _block_hashes(np.frombuffer(data[o], np.uint8), length)
        places = np.unique(np.concatenate([np.arange(b, b + n - length + 1) for b, n in zip(begin[own].tolist(), size[own].tolist(), strict=True)]))
        at.append(places)
        of.append(np.full(places.size, o))
        keys.append(hashes[places])
    at, of, keys = np.concatenate(at), np.concatenate(of), np.concatenate(keys)
    order = np.lexsort((documents[of], keys))
    at, of, keys = at[order], of[order], keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    smallest = documents[of][np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = documents[of] > smallest
    return at[~later], of[~later], keys[~later], (of[later], at[later])


def thinned(text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts of a text that strings cover which may occur twice: (parts, a sentinel behind each; where each begins; where it began).

    starts: where the pieces of text begin, and its size; a sentinel ends each piece. Strings are counted by three parts of a hash, so none that
    occurs twice is lost, and a few that occur once stay for the transform to tell."""
    places = np.ones(text.size, bool)
    places[(starts[1:, None] - 1 - np.arange(length)).ravel()] = False
    places = np.flatnonzero(places)
    keys = _block_hashes(text, length)[places]
    last = np.uint64((1 << (4 * keys.size).bit_length()) - 1)
    for shift in (0, 20, 40):
        slots = (keys >> np.uint64(shift) & last).astype(np.int64)
        twice = np.bincount(slots)[slots] > 1 if slots.size else np.zeros(0, bool)
        places, keys = places[twice], keys[twice]
    edges = np.bincount(places, minlength=text.size + 1) - np.bincount(places + length, minlength=text.size + 1)
    covered = np.cumsum(edges)[:-1] > 0
    begin, end = runs(covered)
    at = np.concatenate([[0], np.cumsum(end - begin + 1)])
    out = np.full(int(at[-1]), SENTINEL, np.uint8)
    inside = np.ones(out.size, bool)
    inside[at[1:] - 1] = False
    out[inside] = text[covered]
    return out, at, begin


def compare_segments(joined: DataFrame, length: int, n_tasks: int) -> DataFrame:
    """(_id, _digest, _edges): bytes of the open segments that strings in smaller documents cover. joined: documents with their marks."""
    n_buckets = BUCKETS_PER_PARTITION * n_tasks
    kind = joined.schema["_id"].dataType.simpleString()

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, batch in enumerate(slices(batches, "_text")):
            number = part << 32 | seq
            begins, sizes, hashes, hots = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_begins", "_sizes", "_hashes", "_hots"))
            rows = sorted({(i, g): r for r, (i, g, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), begins, strict=True)) if b}.items())
            if not rows:
                continue
            texts = batch.column(batch.schema.get_field_index("_text"))
            found = [(unpack_gaps(begins[r]), widen(sizes[r]), np.frombuffer(hashes[r], np.uint32), np.frombuffer(hots[r], bool)) for _, r in rows]
            data = [texts[r].as_py().encode() for _, r in rows]
            counts = [f[0].size for f in found]
            begin, size, h, hot = (np.concatenate([f[j] for f in found]) for j in range(4))
            owner = np.repeat(np.arange(len(rows)), counts)
            route, settled = h.astype(np.uint64), (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if hot.any():
                documents = np.array([k[0] for k, _ in rows], np.int64)
                at, of, keys, settled = _strings(data, documents, owner[hot], begin[hot], size[hot], length)
                begin, size, owner, route = np.concatenate([begin[~hot], at]), np.concatenate([size[~hot], np.full(at.size, length)]), np.concatenate([owner[~hot], of]), np.concatenate([route[~hot], keys])
            out = []
            for b, own in _cells((mix(route) % np.uint64(n_buckets)).astype(np.int64)):
                parts = [data[o][x : x + s] for o, x, s in zip(owner[own].tolist(), begin[own].tolist(), size[own].tolist(), strict=True)]
                out.append((b, number, ("cell", np.array([rows[o][0][0] for o in owner[own].tolist()], np.int64).tobytes(), owner[own].astype(np.int32).tobytes(), begin[own].tobytes(), size[own].tobytes(), b"".join(parts))))
            out.append((_spread(number, n_buckets), number, ("head", [k for k, _ in rows], *settled)))
            yield _message(out)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        numbers, cells, out = [], [], []
        for number, blob in zip(group["slice"], group["payload"], strict=True):
            payload = pickle.loads(blob)
            if payload[0] == "head":
                out.append((number, blob))
            else:
                numbers.append(number)
                cells.append(payload[1:])
        if cells:
            doc, owner, begin, size = (np.concatenate([np.frombuffer(c[j], t) for c in cells]) for j, t in enumerate((np.int64, np.int32, np.int64, np.int64)))
            cell = np.repeat(np.arange(len(cells)), [len(c[0]) // 8 for c in cells])
            starts = np.concatenate([[0], np.cumsum(size + 1)])
            text = np.full(int(starts[-1]), SENTINEL, np.uint8)
            inside = np.ones(text.size, bool)
            inside[starts[1:] - 1] = False
            text[inside] = np.frombuffer(b"".join(c[4] for c in cells), np.uint8)
            kept, kept_at, kept_from = thinned(text, starts, length)
            places, groups = shared_prefix_groups(kept, length)
            part = _Slice.owners(kept_at, places)
            places = places - kept_at[part] + kept_from[part]
            segment = _Slice.owners(starts, places)
            smallest = np.full(int(groups.max(initial=0)) + 1, np.iinfo(np.int64).max)
            np.minimum.at(smallest, groups, doc[segment])
            hit = doc[segment] > smallest[groups]
            places, segment = places[hit], segment[hit]
            at = places - starts[segment] + begin[segment]
            order = np.lexsort((at, owner[segment], cell[segment]))
            for c, own in _by_owner(cell[segment][order]):
                pick = order[own]
                out.append((numbers[c], pickle.dumps(("reply", owner[segment[pick]].tobytes(), at[pick].tobytes()), protocol=5)))
        return pd.DataFrame(out, columns=["slice", "payload"])

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        payloads = [pickle.loads(b) for b in group["payload"]]
        _, keys, settled_owner, settled_at = next(p for p in payloads if p[0] == "head")
        owner = np.concatenate([settled_owner, *(np.frombuffer(p[1], np.int32) for p in payloads if p[0] == "reply")])
        at = np.concatenate([settled_at, *(np.frombuffer(p[2], np.int64) for p in payloads if p[0] == "reply")])
        order = np.lexsort((at, owner))
        owner, at = owner[order], at[order]
        out = [(*keys[d], pack_gaps(merge(at[own], at[own] + length))) for d, own in _by_owner(owner)]
        return pd.DataFrame(out, columns=["_id", "_digest", "_edges"]).astype({"_id": object})

    replies = joined.mapInArrow(scatter, _MESSAGE).repartition(n_tasks, "bucket").groupBy("bucket").applyInPandas(meet, "slice long, payload binary")
    return replies.repartition(n_tasks, "slice").groupBy("slice").applyInPandas(settle, f"_id {kind}, _digest long, _edges binary")


def _with_marks(source: DataFrame, marks: DataFrame) -> DataFrame:
    named = marks.withColumnsRenamed({"_id": "_mark_id", "_digest": "_mark_digest"})
    return source.join(named, (F.col("_id") == F.col("_mark_id")) & (F.col("_digest") == F.col("_mark_digest")), "left").drop("_mark_id", "_mark_digest")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept, kept_sha256) for every row; spans: [begin, end) of bytes, flattened;
    kept: the remaining bytes. Ids are integers."""
    source = with_text(docs, id_col, text_col).select(F.col("_id").cast("long").alias("_id"), F.xxhash64("_text").alias("_digest"), "_text")
    n_tasks = parts(docs.sparkSession, text_bytes(source), TEXT_PER_TASK)
    marks = materialize(find_segments(source, length, n_tasks).dropDuplicates(["_id", "_digest"]), "suffix-marks")
    joined = _with_marks(source, marks.drop("_covered"))
    hits = compare_segments(joined, length, n_tasks)
    edges = marks.select("_id", "_digest", F.col("_covered").alias("_edges")).unionAll(hits.dropDuplicates(["_id", "_digest"])).groupBy("_id", "_digest").agg(F.collect_list("_edges").alias("_edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            out = []
            for text, packed in zip(binary_column(batch, "_text"), batch.column(batch.schema.get_field_index("_edges")).to_pylist(), strict=True):
                gone = np.zeros(len(text), bool)
                for p in packed or ():
                    edges = unpack_gaps(p).tolist()
                    for a, b in zip(edges[::2], edges[1::2], strict=True):
                        gone[a:b] = True
                begin, end = runs(gone)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((len(text), int(gone.sum()), begin.size, np.stack([begin, end], 1).ravel().tolist(), kept, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    return _with_marks(source, edges).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<long>, kept binary, kept_sha256 string")
