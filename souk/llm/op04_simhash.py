"""SimHash near-duplicates through an inverted index on byte positions, with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 bytes, each at its position. The index
holds each distinct fingerprint under 14 quadruples of positions, the blocks of the affine space over 3 bits: any 5 positions
hold one of them. Keys are counted by an aggregate and those of a single fingerprint dropped. Under a key, the bytes that a
pair shares are tallied over all 8 positions; pairs with the guaranteed minimum of 5 are verified by their differing bits.
Where a key holds many fingerprints, each is indexed again by one more position, of which a pair must share some: such a
key fixes 5 bytes, so it holds at most 2^24 fingerprints (128 MB) however large the input. Above a handful of fingerprints a
key gives fewer links than it holds fingerprints: those not connected yet are joined, breadth first or by looking up all neighbours.

Links join the distinct fingerprints into components with joins and aggregates only. Copies share a fingerprint and are
counted once before any of this.

Defined results: a text without words (null, empty) has fingerprint zero and is linked like any other; rows that repeat
share their component; rows with a null id take part, but an id is never null where a component has another; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import binary_column, materialize, parts, slices, unused, with_text
from souk.llm.components import components

#: Fixed by the contract.
SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Bytes of 8 that must agree if at most MAX_BITS bits differ, and the positions that are indexed together.
MIN_MATCHES = 8 - MAX_BITS
BLOCKS = tuple(b for b in combinations(range(8), MIN_MATCHES - 1) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0)
#: Keys with more fingerprints than this are split by one more position.
SPLIT_ABOVE = 4096
#: Keys with at most this many are compared pair by pair.
SMALL = 8
#: Entries of a task.
ENTRIES_PER_TASK = 500_000
#: Fingerprints of one key from which on links are looked up among all neighbours of a fingerprint.
LOOK_UP_ABOVE = 20_000


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of the text's shingles in order; fewer words than a shingle are one."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    h, seed = xxhash.xxh64_intdigest, SEED
    if n <= shingle:
        values = [h(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        values = [h(joined[a:b], seed) for a, b in zip(begins[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return np.array(values, np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    if not hashes.size:
        return 0
    bits = np.zeros(64, np.int64)
    for at in range(0, hashes.size, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > hashes.size, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, fp) for every row; fp is the fingerprint's 64 bits as a signed long, digest a hash of the text."""
    source = with_text(docs, id_col, text_col).select("_id", F.xxhash64("_text").alias("_digest"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            values = np.array([fingerprint(t) for t in binary_column(batch, "_text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["doc_id", "digest", "fp"])

    return source.mapInArrow(run, f"doc_id {source.schema['_id'].dataType.simpleString()}, digest long, fp long")


def linked(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of others link to the fingerprints of one (same shape or a single one): tally of shared bytes, then bits."""
    tally = (others.view(np.uint8).reshape(-1, 8) == one.view(np.uint8).reshape(-1, 8)).sum(1)
    hit = tally >= MIN_MATCHES
    hit[hit] = np.bitwise_count((others ^ one)[hit]) <= MAX_BITS
    return hit


def forest(fps: np.ndarray) -> np.ndarray:
    """Links, a row each, that connect what is connected among fps: breadth first, each fingerprint reached once."""
    links, left = [], fps
    while left.size:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            one = queue.pop()
            hit = linked(np.array([one]), left)
            if hit.any():
                found = left[hit]
                links.append(np.stack([np.full(found.size, one), found], 1))
                queue += list(found)
                left = left[~hit]
    return np.concatenate(links) if links else np.zeros((0, 2), np.uint64)


def neighbour_links(fps: np.ndarray) -> np.ndarray:
    """The same for many fingerprints that share 5 bytes. Those that differ in a given set of bits are looked up for all at once; only
    pairs that are not connected yet become links, so there are fewer links than fingerprints whatever the number of neighbours."""
    fps = np.unique(fps)
    free = [b for b in range(64) if ((fps ^ fps[0]) >> np.uint64(b) & np.uint64(1)).any()]
    root, links, apart = np.arange(fps.size), [], fps.size
    for n in range(1, MAX_BITS + 1):
        for bits in combinations(free, n):
            if apart == 1:
                break
            other = fps ^ np.uint64(sum(1 << b for b in bits))
            at = np.minimum(np.searchsorted(fps, other), fps.size - 1)
            one = np.flatnonzero((fps[at] == other) & (fps < other))
            two = at[one]
            while True:
                low, high = np.minimum(root[one], root[two]), np.maximum(root[one], root[two])
                new = np.flatnonzero(low != high)
                if not new.size:
                    break
                # of the pairs that reach a tree, one joins it to a tree with a smaller root
                joins = new[np.unique(high[new], return_index=True)[1]]
                links.append(np.stack([fps[one[joins]], fps[two[joins]]], 1))
                apart -= joins.size
                root[high[joins]] = low[joins]
                while (root[root] != root).any():
                    root = root[root]
    return np.concatenate(links) if links else np.zeros((0, 2), np.uint64)


def bucket_links(keys: np.ndarray, fps: np.ndarray) -> pd.DataFrame:
    """Links among the index entries of a bucket."""
    order = np.lexsort((fps, keys))
    fps, keys = fps[order], keys[order]
    begins = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
    sizes = np.diff(begins, append=keys.size)
    links = [np.zeros((0, 2), np.uint64)]
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, SMALL):
        at = np.flatnonzero((keys[step:] == keys[:-step]) & small[step:])
        if not at.size:
            break
        hit = at[linked(fps[at], fps[at + step])]
        links.append(np.stack([fps[hit], fps[hit + step]], 1))
    for begin, n in zip(begins[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        links.append((forest if n <= LOOK_UP_ABOVE else neighbour_links)(fps[begin : begin + n]))
    pairs = np.unique(np.sort(np.concatenate(links), 1), axis=0).view(np.int64)
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def _masked(positions: tuple[int, ...]) -> Column:
    """The bytes of a fingerprint at some positions, as a column; with the positions themselves it makes a key."""
    mask = sum(0xFF << 8 * p for p in positions)
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(distinct: DataFrame, split_above: int | None = None) -> DataFrame:
    """(u, v): links between the distinct fingerprints fp, enough to connect every pair within MAX_BITS."""
    spark, split_above = distinct.sparkSession, split_above or SPLIT_ABOVE
    indexed = distinct.select("fp", F.posexplode(F.array(*[_masked(b) for b in BLOCKS])).alias("block", "part")).withColumn("key", F.xxhash64("block", "part"))
    counted = materialize(indexed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "k"), "simhash-keys")
    shared = indexed.join(counted, F.col("key") == F.col("k")).select("fp", "block", "key", "n")
    more = F.element_at(F.array(*[F.array(*[_masked((*b, p)) for p in range(8) if p not in b]) for b in BLOCKS]), F.col("block") + 1)
    hot = shared.where(F.col("n") > split_above).select("fp", "block", F.posexplode(more).alias("place", "part")).select("fp", F.xxhash64("block", "place", "part").alias("key"))
    entries = shared.where(F.col("n") <= split_above).select("fp", "key").unionAll(hot)
    n_tasks = parts(spark, counted.agg(F.sum(F.when(F.col("n") > split_above, 4 * F.col("n")).otherwise(F.col("n")))).first()[0], ENTRIES_PER_TASK)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        return bucket_links(group["key"].to_numpy(np.int64), group["fp"].to_numpy(np.int64).view(np.uint64))

    bucketed = entries.withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(2 * n_tasks)))
    return bucketed.repartition(n_tasks, "bucket").groupBy("bucket").applyInPandas(meet, "u long, v long")


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, fp, root, component_id) for every row of docs."""
    own = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    found = components(links(distinct))
    rooted = distinct.join(found, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    classes = rooted.join(smallest, F.col("root") == F.col("r")).select(F.col("fp").alias("class_fp"), "root", "component_id")
    return own.join(classes, F.col("fp") == F.col("class_fp"), "left").select("doc_id", "digest", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row of docs."""
    return _rooted(docs, id_col, text_col).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each root of found (doc_id, digest, root): of the smallest id (null last), then of the smallest digest of a
    text. Rows that share both are copies, of which any one stays."""
    own = found.groupBy("doc_id", "digest", "root").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "digest"))
    chosen = own.groupBy("root").agg(first.alias("z")).select(F.col("root").alias("r"), "z")
    judged = materialize(own.join(chosen, F.col("root") == F.col("r")).select("doc_id", "digest", "n", (F.col("doc_id").eqNullSafe(F.col("z.doc_id")) & (F.col("digest") == F.col("z.digest"))).alias("stays")), "kept-keys")
    k_id, k_digest, row = unused(docs.columns, "_key_id", "_key_digest", "_row")

    def keys(where: str) -> DataFrame:
        return judged.where(where).select(F.col("doc_id").alias(k_id), F.col("digest").alias(k_digest))

    same = F.col(id_col).eqNullSafe(F.col(k_id)) & (F.xxhash64(F.col(text_col).cast("string")) == F.col(k_digest))
    left = docs.join(keys("not stays"), same, "left_anti")
    if judged.where("stays and n > 1").isEmpty():
        return left
    again = keys("stays and n > 1")
    # however often a row is repeated, an aggregate keeps one of each task before any is sent
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    copies = left.join(again, same, "left_semi").groupBy(F.col(id_col).alias(k_id), F.xxhash64(F.col(text_col).cast("string")).alias(k_digest)).agg(F.any_value(whole).alias(row))
    return left.join(again, same, "left_anti").unionAll(copies.select(*[F.col(row).getField(c).alias(c) for c in docs.columns]))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all its columns: see keep_one."""
    return keep_one(docs, _rooted(docs, id_col, text_col), id_col, text_col)
