"""Near copies by five-word similarity: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more,
and those that op04 links, in one set of components.

Each distinct set has a sketch: one byte for each of 96 least hashes. Four bytes are a band; sets that agree in a band are
candidates. A pair at 0.8 agrees in none of the 24 bands with probability (1 - 0.8^4)^24, about 3e-6. Candidates that agree in
fewer than MIN_EQUAL bytes (five standard deviations below 0.8) go; the others are verified by their exact sets. A pair is a
candidate only in the first band that it shares.

Bands are counted by an aggregate, and only those that several sets share go on. Large ones are dealt out in blocks and met
twice. First each set is paired with some neighbours in sketch order only. What those links leave in different components
is then compared in full, block by block, by a finer sketch of FINE least hashes, one bit each, too. So a large group of
near copies gives links in proportion to its size, no task holds more than some blocks, and no pair is left out: one within
a component would add nothing.

Defined results: fewer than five words are one shingle; texts without words share the empty set; otherwise as op04.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import op04_simhash
from souk.llm.common import binary_column, materialize, mix, parts, slices, with_text
from souk.llm.components import components

#: Fixed by the rule for near-duplicate stages: words in a shingle, and the least similarity as a fraction.
SHINGLE = 5
LEAST = (4, 5)
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Equal bytes of HASHES below which a pair is taken to be under LEAST.
MIN_EQUAL = 57
#: Bits of the finer sketch, and how many must agree: 0.9 of them do at 0.8, with a standard deviation of 13.6.
FINE = 2048
MIN_FINE = 1775
#: Keys with at most this many sets are compared pair by pair at once; larger ones with NEIGHBOURS in sketch order first.
SMALL = 32
NEIGHBOURS = 8
#: Sets of a block of a large key, and entries of a task.
BLOCK = 4096
ENTRIES_PER_TASK = 50_000
FACTORS = np.random.default_rng(42).integers(0, 1 << 64, HASHES + FINE, np.uint64, endpoint=False) | np.uint64(1)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of the text's shingles, ascending."""
    return np.unique(op04_simhash.shingle_hashes(text, SHINGLE))


def _least(own: np.ndarray, factors: np.ndarray) -> np.ndarray:
    least = np.full(factors.size, np.iinfo(np.uint64).max)
    step = max(1, (1 << 19) // factors.size)
    for at in range(0, own.size, step):
        np.minimum(least, np.multiply.outer(factors, own[at : at + step]).min(1), out=least)
    return mix(least)


def sketch(own: np.ndarray) -> bytes:
    return (_least(own, FACTORS[:HASHES]) >> np.uint64(56)).astype(np.uint8).tobytes() if own.size else bytes(HASHES)


def fine_sketch(own: np.ndarray) -> bytes:
    return np.packbits((_least(own, FACTORS[HASHES:]) >> np.uint64(63)).astype(bool)).tobytes() if own.size else bytes(FINE // 8)


def shape(own: np.ndarray) -> int:
    """A hash of the whole set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), op04_simhash.SEED)).view(np.int64))


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, fp, shape, n, sketch) for every row; n is the size of the set, digest a hash of the text."""
    source = with_text(docs, id_col, text_col).select("_id", F.xxhash64("_text").alias("_digest"), "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            fps, shapes, sizes, sketches = [], [], [], []
            for text in binary_column(batch, "_text"):
                own = shingle_set(text)
                fps.append(op04_simhash.fingerprint(text))
                shapes.append(shape(own))
                sizes.append(own.size)
                sketches.append(sketch(own))
            columns = [batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(shapes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "fp", "shape", "n", "sketch"])

    return source.mapInArrow(run, f"doc_id {source.schema['_id'].dataType.simpleString()}, digest long, fp long, shape long, n long, sketch binary")


def sets(docs: DataFrame, text_col: str) -> DataFrame:
    """(shape, items): the sets of docs, once for each slice that has them."""
    source = docs.select(F.col(text_col).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = {}
            for text in set(binary_column(batch, "_text")):
                own = shingle_set(text)
                found[shape(own)] = own
            ends = np.cumsum([0, *(x.size for x in found.values())])
            items = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([*found.values(), np.zeros(0, np.uint64)]).view(np.int64))).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), items], names=["shape", "items"])

    return source.mapInArrow(run, "shape long, items array<long>")


def fine(own: DataFrame) -> DataFrame:
    """(shape, fine) of stored sets (shape, items)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fine_sketch(x.values.to_numpy(zero_copy_only=False).view(np.uint64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["shape", "fine"])

    return own.mapInArrow(run, "shape long, fine binary")


def close(sketches: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the sets at a and b may be similar, by size and equal bytes."""
    few, many = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
    hit = few * LEAST[1] >= many * LEAST[0]
    left = np.flatnonzero(hit)
    for at in range(0, left.size, 1 << 16):
        part = left[at : at + (1 << 16)]
        hit[part] = (sketches[a[part]] == sketches[b[part]]).sum(1) >= MIN_EQUAL
    return hit


def first_shared(sketches: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band that the sets at a and b share."""
    return np.concatenate([np.zeros(0, np.int64), *((sketches[a[i : i + (1 << 16)]] == sketches[b[i : i + (1 << 16)]]).reshape(-1, BANDS, ROWS).all(2).argmax(1) for i in range(0, a.size, 1 << 16))])


def near_pairs(keys: np.ndarray, bands: np.ndarray, large: np.ndarray, sketches: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of candidates among entries: all pairs of small keys, neighbours in sketch order in large ones."""
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, SMALL):
        at = np.flatnonzero((keys[order[step:]] == keys[order[:-step]]) & ~large[order[step:]])
        if not at.size:
            break
        a, b = order[at], order[at + step]
        hit = close(sketches, sizes, a, b)
        hit[hit] = first_shared(sketches, a[hit], b[hit]) == bands[a[hit]]
        one.append(a[hit])
        two.append(b[hit])
    for own in np.split(order, begins[1:]):
        if large[own[0]]:
            # the bytes after the key's first, so that each band sorts its keys in another way
            turned = np.roll(sketches[own], -ROWS * (int(bands[own[0]]) + 1), 1)
            own = own[np.lexsort(turned.T[::-1])]
            for step in range(1, NEIGHBOURS + 1):
                a, b = own[:-step], own[step:]
                hit = close(sketches, sizes, a, b)
                one.append(a[hit])
                two.append(b[hit])
    return np.concatenate(one), np.concatenate(two)


def apart_pairs(bands: np.ndarray, blocks: np.ndarray, roots: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, fines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of candidates among the entries of one cell of a key, of other roots: between its two blocks, or within its only one."""
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    single = blocks.min() == blocks.max()
    # the largest component last, so that it is compared with the others only
    names, at, n = np.unique(roots, return_inverse=True, return_counts=True)
    rank = np.empty(names.size, np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(names.size)
    order = np.argsort(rank[at], kind="stable")
    ends = np.searchsorted(rank[at][order], rank[at][order], side="right")
    for i in range(order.size):
        rest = order[ends[i] :]
        if not rest.size:
            break
        if not single:
            rest = rest[blocks[rest] != blocks[order[i]]]
        a = np.full(rest.size, order[i])
        hit = close(sketches, sizes, a, rest)
        hit[hit] = first_shared(sketches, a[hit], rest[hit]) == bands[a[hit]]
        hit[hit] = FINE - np.bitwise_count(fines[rest[hit]] ^ fines[order[i]]).sum(1, dtype=np.int64) >= MIN_FINE
        one.append(a[hit])
        two.append(rest[hit])
    return np.concatenate(one), np.concatenate(two)


def _table(column: pd.Series, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, width)


def _pairs(shapes: np.ndarray, one: np.ndarray, two: np.ndarray) -> pd.DataFrame:
    a, b = shapes[one], shapes[two]
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pd.DataFrame({"u": pairs[:, 0], "v": pairs[:, 1]})


def shared_bands(classes: DataFrame) -> DataFrame:
    """(shape, band, key, many): the bands of sets that several sets have, and how many have it."""
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("sketch", b * ROWS + 1, ROWS)) for b in range(BANDS)])
    entries = classes.select("shape", F.posexplode(bands).alias("band", "key"))
    counted = entries.groupBy("key").agg(F.count(F.lit(1)).alias("many")).where("many > 1").withColumnRenamed("key", "k")
    return materialize(entries.join(counted, F.col("key") == F.col("k")).select("shape", "band", "key", "many"), "similar-bands")


def first_meeting(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): candidates of small keys, and of neighbours in the blocks of large ones."""
    n_tasks = parts(shared.sparkSession, shared.count(), ENTRIES_PER_TASK)
    blocks = F.ceil(F.col("many") / BLOCK)
    named = classes.select(F.col("shape").alias("s"), "n", "sketch")
    dealt = shared.withColumn("key", F.xxhash64("key", F.pmod("shape", blocks))).join(named, F.col("shape") == F.col("s"))
    bucketed = dealt.select("shape", "band", "key", (F.col("many") > SMALL).alias("large"), "n", "sketch", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(2 * n_tasks)).alias("bucket"))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        return _pairs(group["shape"].to_numpy(np.int64), *near_pairs(group["key"].to_numpy(np.int64), group["band"].to_numpy(np.int64), group["large"].to_numpy(bool), _table(group["sketch"], np.uint8, HASHES), group["n"].to_numpy(np.int64)))

    return bucketed.repartition(n_tasks, "bucket").groupBy("bucket").applyInPandas(meet, "u long, v long")


def second_meeting(shared: DataFrame, named: DataFrame, own: DataFrame) -> DataFrame:
    """(u, v): candidates of large keys whose sets have several roots. named: (shape, n, sketch, root); own: the sets of large keys."""
    large = shared.where(F.col("many") > SMALL).join(named.select(F.col("shape").alias("s"), "root"), F.col("shape") == F.col("s")).select("shape", "band", "key", "many", "root")
    torn = large.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(F.col("key").alias("k"))
    left = materialize(large.join(torn, F.col("key") == F.col("k")).drop("k"), "similar-torn")
    blocks = F.ceil(F.col("many") / BLOCK).cast("int")
    block = F.pmod("shape", blocks).cast("int")
    # each set goes to the cells of its block with every block of its key
    cells = left.select("*", block.alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = cells.withColumn("cell", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    n_tasks = parts(shared.sparkSession, cells.count(), ENTRIES_PER_TASK)
    facts = named.select(F.col("shape").alias("s"), "n", "sketch").join(fine(own).withColumnRenamed("shape", "f"), F.col("s") == F.col("f")).select("s", "n", "sketch", "fine")
    dealt = cells.join(facts, F.col("shape") == F.col("s")).select("shape", "band", "root", "block", "cell", "n", "sketch", "fine")

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        columns = [group[c].to_numpy(np.int64) for c in ("band", "block", "root")]
        return _pairs(group["shape"].to_numpy(np.int64), *apart_pairs(*columns, _table(group["sketch"], np.uint8, HASHES), group["n"].to_numpy(np.int64), _table(group["fine"], np.uint64, FINE // 64)))

    return dealt.repartition(n_tasks, "cell").groupBy("cell").applyInPandas(meet, "u long, v long")


def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs whose sets have a similarity of LEAST or more."""
    one, two = (own.select(F.col("shape").alias(f"s{i}"), F.col("items").alias(f"i{i}")) for i in (1, 2))
    met = pairs.join(one, F.col("u") == F.col("s1")).join(two, F.col("v") == F.col("s2"))
    shared = met.select("u", "v", F.size(F.array_intersect("i1", "i2")).alias("both"), (F.size("i1") + F.size("i2")).alias("total"))
    return shared.where((F.col("total") - F.col("both")) * LEAST[0] <= F.col("both") * LEAST[1]).select("u", "v")


def _rooted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, digest, shape, root, component_id) for every row of docs."""
    own = materialize(sketched(docs, id_col, text_col), "sketches")
    classes = materialize(own.groupBy("shape").agg(F.min("doc_id").alias("first"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "similar-classes")
    # op4's links between fingerprints, as links between the least sets that have them
    by_fp = materialize(own.groupBy("fp").agg(F.min("shape").alias("least")), "distinct-fingerprints")
    bits = op04_simhash.links(by_fp)
    ends = by_fp.select(F.col("fp").alias("u"), F.col("least").alias("a")), by_fp.select(F.col("fp").alias("v"), F.col("least").alias("b"))
    same = own.select("fp", "shape").distinct().join(by_fp, "fp").select(F.col("shape").alias("u"), F.col("least").alias("v"))
    edges = same.unionAll(bits.join(ends[0], "u").join(ends[1], "v").select("a", "b"))
    shared = shared_bands(classes)
    pairs = materialize(first_meeting(shared, classes).distinct(), "similar-candidates")
    large = shared.where(F.col("many") > SMALL).select(F.col("shape").alias("node")).distinct()
    nodes = materialize(pairs.select(F.col("u").alias("node")).unionAll(pairs.select("v")).unionAll(large).distinct(), "similar-nodes")
    met = sets(docs, text_col).join(nodes, F.col("shape") == F.col("node"), "left_semi")
    met = materialize(met.groupBy("shape").agg(F.any_value("items").alias("items")), "similar-sets")
    edges = materialize(edges.unionAll(verified(pairs, met)).where("u <> v").distinct(), "similar-links")
    found = components(edges)
    if not large.isEmpty():
        named = classes.join(found, F.col("shape") == F.col("node"), "left").select("shape", "n", "sketch", F.coalesce("root", "shape").alias("root"))
        own_large = met.join(large, F.col("shape") == F.col("node"), "left_semi")
        rest = materialize(second_meeting(shared, named, own_large).distinct(), "similar-candidates")
        found = components(edges.unionAll(verified(rest, met)))
    rooted = classes.join(found, F.col("shape") == F.col("node"), "left").select("shape", "first", F.coalesce("root", "shape").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    named = rooted.join(smallest, F.col("root") == F.col("r")).select(F.col("shape").alias("class"), "root", "component_id")
    return own.select("doc_id", "digest", "shape").join(named, F.col("shape") == F.col("class"), "left").select("doc_id", "digest", "shape", "root", "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shape, component_id) for every row of docs."""
    return _rooted(docs, id_col, text_col).select("doc_id", "shape", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component, with all its columns: see op04_simhash.keep_one."""
    return op04_simhash.keep_one(docs, _rooted(docs, id_col, text_col), id_col, text_col)
