"""Benchmark decontamination by Wu-Manber search over words.

Test strings are the windows of `window` consecutive words of benchmark items; an item of fewer words is one string. For
each string length m a shift table says, for every block of two words, how far the search may move on without missing a
string; most blocks of a document stand in no string, so it moves on by m - 1 words. Where the shift is 0 the block is the
last of some strings: its bucket, split by their first word, gives the few to compare word by word.

The test strings are sent to the workers in blocks of bounded size; documents are searched once for each block, with what
was found so far carried along, so a benchmark of any size is searched against all rows.

Defined results: a null text has no words; items without words are no test strings; an empty benchmark marks nothing; rows
that repeat are searched each; a document without words is not contaminated.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm.common import binary_column, materialize, pack_gaps, runs, slices, unpack_gaps, unused, with_text

#: Fixed by the contract.
WINDOW = 13
HIT_SHARE = 20
#: Benchmark text sent to the workers at once.
BLOCK_BYTES = 16_000_000

#: Word bytes are digits, a-z after lower-casing, and bytes from 0x80 on; all others part words.
_FOLD = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80) else 0x20 for b in range(256))


def item_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class WuManber:
    """Strings of m words each, with the numbers of the items that hold them."""

    def __init__(self, m: int, strings: dict[tuple[bytes, ...], set[int]]):
        self.m, self.block = m, min(2, m)
        self.skip = m - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], dict[bytes, list[tuple[list[bytes], tuple[int, ...]]]]] = defaultdict(lambda: defaultdict(list))
        for string, items in strings.items():
            for end in range(self.block - 1, m):
                block = string[end - self.block + 1 : end + 1]
                self.shift[block] = min(self.shift.get(block, self.skip), m - 1 - end)
            self.buckets[string[-self.block :]][string[0]].append((list(string), tuple(items)))

    def search(self, words: list[bytes], hit: np.ndarray, items: set[int]) -> None:
        m, n, skip, shift, block = self.m, len(words), self.skip, self.shift.get, self.block
        at = m - 1
        while at < n:
            last = (words[at - 1], words[at]) if block == 2 else (words[at],)
            step = shift(last, skip)
            if step:
                at += step
                continue
            begin = at - m + 1
            for string, owners in self.buckets[last].get(words[begin], ()):
                if words[begin : at + 1] == string:
                    hit[begin : at + 1] = True
                    items.update(owners)
            at += 1


def build(items: list[tuple[int, bytes]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = defaultdict(lambda: defaultdict(set))
    for number, text in items:
        words = item_words(text)
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            by_length[m][tuple(words[i : i + m])].add(number)
    return [WuManber(m, strings) for m, strings in sorted(by_length.items())]


def search_all(engines: list[WuManber], words: list[bytes], hit: np.ndarray) -> set[int]:
    items: set[int] = set()
    for engine in engines:
        engine.search(words, hit, items)
    return items


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[bool, list[tuple[str, bytes]]]]:
    """Whether this is the last, and the items: lists of bounded size, one fetched at a time."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        yield k == n - 1, [(r["item"], bytes(r["text"])) for r in rows.collect()]


def _marked(docs: DataFrame, items: list[tuple[str, bytes]], window: int, first: bool, last: bool) -> DataFrame:
    """docs, without its text after the last block, with _hits (packed edges of hit runs) and _items (names of the items met) brought up to date."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    replaced = {"_hits", "_items", "_n_words"} | ({"_text"} if last else set())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engines = names = None
        for batch in slices(batches, "_text"):
            if engines is None:
                names = [name for name, _ in shared.value]
                engines = build([(i, text) for i, (_, text) in enumerate(shared.value)], window)
            hits, met = [], []
            old_hits = [b""] * batch.num_rows if first else batch.column(batch.schema.get_field_index("_hits")).to_pylist()
            old_met = [[]] * batch.num_rows if first else batch.column(batch.schema.get_field_index("_items")).to_pylist()
            lengths = []
            for text, before, known in zip(binary_column(batch, "_text"), old_hits, old_met, strict=True):
                words = item_words(text)
                hit = np.zeros(len(words), bool)
                edges = unpack_gaps(before)
                for a, b in zip(edges[::2], edges[1::2], strict=True):
                    hit[a:b] = True
                found = search_all(engines, words, hit)
                lengths.append(len(words))
                hits.append(pack_gaps(np.stack(runs(hit), 1).ravel()))
                met.append(sorted({*known, *(names[i] for i in found if names[i] is not None)}))
            kept_names = [f.name for f in batch.schema if f.name not in replaced]
            kept = [batch.column(batch.schema.get_field_index(x)) for x in kept_names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, pa.binary()), pa.array(met, pa.list_(pa.string())), pa.array(lengths, pa.int64())], names=[*kept_names, "_hits", "_items", "_n_words"])

    plain = [f for f in docs.schema.fields if f.name not in replaced]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain) + ", _hits binary, _items array<string>, _n_words long"
    return docs.mapInArrow(run, schema)


def mark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(_id, _hits, _items, _n_words): hit runs of words as packed edges, and the names of the items met."""
    marked = with_text(docs, id_col, text_col)
    for k, (last, items) in enumerate(_blocks(benchmark, item_col, item_text_col, block_bytes)):
        if k:
            marked = materialize(marked, "decontaminate-block")
        marked = _marked(marked, items, window, first=k == 0, last=last)
    return marked


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = HIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, item_ids, contaminated) for every row of docs."""
    marked = mark(docs, benchmark, id_col, text_col, item_col, item_text_col, window, block_bytes)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, hits, items, lengths = (c.to_pylist() for c in batch.columns)
            n_hit = [int((e[1::2] - e[::2]).sum()) for e in map(unpack_gaps, hits)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(lengths, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array(map(len, items), pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array([h > 0 and share * h >= n for h, n in zip(n_hit, lengths, strict=True)], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "item_ids", "contaminated"],
            )

    kind = marked.schema["_id"].dataType.simpleString()
    return marked.mapInArrow(finish, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, item_ids array<string>, contaminated boolean")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, share: int = HIT_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns, in one pass where one block holds the benchmark."""
    last, items = next(_blocks(benchmark, item_col, item_text_col, block_bytes))
    if not last:
        row, bad_row = unused(docs.columns, "_row", "_bad_row")
        numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
        bad = decontaminate(numbered, benchmark, row, text_col, item_col, item_text_col, window, share, block_bytes).where("contaminated")
        return numbered.join(bad.select(F.col("doc_id").alias(bad_row)), F.col(row) == F.col(bad_row), "left_anti").drop(row)
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engines = None
        for batch in slices(batches, text_col):
            engines = engines if engines is not None else build([(i, text) for i, (_, text) in enumerate(shared.value)], window)
            keep = []
            for text in binary_column(batch, text_col):
                words = item_words(text)
                hit = np.zeros(len(words), bool)
                search_all(engines, words, hit)
                n = int(hit.sum())
                keep.append(not (n > 0 and share * n >= len(words)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

