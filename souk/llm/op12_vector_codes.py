"""Vector code compression: product quantization whose codebooks are trained by Yinyang Lloyd rounds.

Vectors become integers and are cut into parts, each part position with a codebook of its own. The entries of a codebook are clustered into
groups once. A part keeps its entry and, for each group, one lower bound of its distance to any other entry there. When entries move, a
group's bound sinks by its greatest drift; only groups whose bound no longer exceeds the distance to the part's own entry are scanned.
Distances are integers: a scanned group gives the nearest entry exactly, ties to the lower index, and a group is skipped only if all of
it is farther, by more than what rounding of the bounds can hide.

A round reads the table of the round before (vector, entries, bounds), writes its own to shared storage and deletes the other. New entries are
sums of a Spark aggregate; what meets on the driver and is broadcast is the codebooks' size only.

Defined results: a null, empty or odd vector (a null or non-finite component, or another length than the vector of the smallest id) is
dropped; a length that the parts don't divide is filled with zeros; components whose squared distances might overflow a long are held
at the greatest value that cannot; rows that repeat are vectors each; null ids come last when a codebook starts, equal ids by their
components; with fewer vectors than entries the codebook has as many entries as vectors; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.llm.common import discard, materialize, shared_dir, written

#: Fixed by the contract.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a codebook for each group.
GROUP_SIZE = 16
STATE = "vec_id {id}, label {label}, x array<int>, codes array<int>, lower array<float>, error long"


@dataclass
class Codebooks:
    """entries: (part, entry, position) integers; members: for each part the entries of each group, ascending; drift: for each part and group how far its entries moved last."""

    entries: np.ndarray
    members: list[list[np.ndarray]]
    drift: list[np.ndarray]

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def moved(self, entries: np.ndarray) -> Codebooks:
        far = np.sqrt(((entries - self.entries).astype(np.float64) ** 2).sum(2)) * (1 + 1e-9)
        return Codebooks(entries, self.members, [np.array([far[p][m].max() for m in groups]) for p, groups in enumerate(self.members)])


def group_entries(entries: np.ndarray, size: int = GROUP_SIZE, rounds: int = 5) -> list[np.ndarray]:
    """The entries of one codebook in groups of about `size` near ones. Any grouping gives the same codes; a good one skips more."""
    points = entries.astype(np.float64)
    centres = points[:: max(1, size)].copy()
    for _ in range(rounds):
        own = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for g in np.unique(own):
            centres[g] = points[own == g].mean(0)
    return [np.flatnonzero(own == g) for g in np.unique(own)]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of integer vectors, exact: by a product of doubles where all sums fit their 53 bits, else in long integers."""
    top = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * x.shape[1] * int(top) ** 2 < 1 << 53:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], 1)


def nearest(x: np.ndarray, entries: np.ndarray, members: list[np.ndarray], drift: np.ndarray | None = None, index: np.ndarray | None = None, lower: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(index, squared distance, lower bounds, pairs compared) of each part of x. Without an index of the round before, all groups are scanned."""
    n, rows_all, greatest = len(x), np.arange(len(x)), np.iinfo(np.int64).max
    if index is None:
        start, own = np.full(n, -1), np.full(n, greatest)
        lower, reach = np.zeros((n, len(members))), np.full(n, np.inf)
    else:
        start, own = index, ((x - entries[index]) ** 2).sum(1)
        lower, reach = lower - drift, np.sqrt(own.astype(np.float64)) * (1 + 1e-9) + 1e-6
    best, at, compared = own.copy(), start.copy(), 0
    scanned = []
    for g, m in enumerate(members):
        rows = np.flatnonzero(lower[:, g] <= reach)
        if not rows.size:
            continue
        d = distances(x[rows], entries[m])
        compared += d.size
        place = d.argmin(1)
        least, who = d[rows_all[: rows.size], place], m[place]
        d[rows_all[: rows.size], place] = greatest
        scanned.append((g, rows, who, least, d.min(1)))
        better = (least < best[rows]) | ((least == best[rows]) & (who < at[rows]))
        best[rows[better]], at[rows[better]] = least[better], who[better]
    # an entry that is left counts among the others of its group again
    if index is not None:
        group_of = np.empty(len(entries), np.int64)
        for g, m in enumerate(members):
            group_of[m] = g
        left = np.flatnonzero(at != start)
        was = group_of[start[left]]
        lower[left, was] = np.minimum(lower[left, was], np.sqrt(own[left].astype(np.float64)))
    for g, rows, who, least, second in scanned:
        other = np.where(at[rows] == who, second, least)
        lower[rows, g] = np.where(other == greatest, np.inf, np.sqrt(other.astype(np.float64)))
    return at, best, np.nextafter(lower.astype(np.float32), np.float32(-np.inf)), compared


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS) -> tuple[DataFrame, int]:
    """(vec_id, label, x) of the vectors that are kept, and the width of a part; x is filled to parts of one width."""
    vectors = table.select(F.col(id_col).alias("vec_id"), (F.col(label_col) if label_col else F.lit(None).cast("int")).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    vectors = vectors.where("v is not null and size(v) > 0 and not exists(v, c -> c is null or isnan(c) or abs(c) = double('Infinity'))")
    length = vectors.agg(F.min_by(F.size("v"), F.struct(F.col("vec_id").isNull(), "vec_id", "v"))).first()[0] or parts
    width = math.ceil(length / parts)
    top = math.isqrt(((1 << 63) - 1) // (4 * width * parts))
    top = min(top, (1 << 31) - 1)
    # compared before the product, which could be infinite
    whole = F.transform("v", lambda c: F.least(F.greatest(F.floor(F.least(F.greatest(c, F.lit(-1e15)), F.lit(1e15)) * SCALE), F.lit(-top)), F.lit(top)).cast("int"))
    return vectors.where(F.size("v") == length).select("vec_id", "label", F.concat(whole, F.array_repeat(F.lit(0), width * parts - length)).alias("x")), width


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel(), kind))


def assign(state: DataFrame, books: Codebooks, first: bool) -> DataFrame:
    """The state with the nearest entries of books: by the bounds of the round before, or, the first time, by scanning all."""
    shared = state.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        n_parts, _, width = books.entries.shape
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch, "x").astype(np.int64).reshape(-1, n_parts, width)
            before = (None, None) if first else (_matrix(batch, "codes"), np.split(_matrix(batch, "lower"), np.cumsum([len(m) for m in books.members])[:-1], axis=1))
            codes, lowers, error = [], [], np.zeros(batch.num_rows, np.int64)
            for p in range(n_parts):
                known = () if first else (books.drift[p], before[0][:, p].astype(np.int64), before[1][p].astype(np.float64))
                at, best, lower, _ = nearest(x[:, p], books.entries[p], books.members[p], *known)
                codes.append(at)
                lowers.append(lower)
                error += best
            columns = [batch.column(0), batch.column(1), batch.column(2), _lists(np.stack(codes, 1).astype(np.int32), pa.int32()), _lists(np.concatenate(lowers, 1), pa.float32()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "x", "codes", "lower", "error"])

    kinds = {c: state.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    wanted = ["vec_id", "label", "x"] if first else ["vec_id", "label", "x", "codes", "lower"]
    return state.select(*wanted).mapInArrow(run, STATE.format(id=kinds["vec_id"], label=kinds["label"]))


def means(state: DataFrame, books: Codebooks) -> np.ndarray:
    """The entries moved to the means of their parts, rounded down; entries without parts stay."""
    shape = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_parts, n_entries, width = shape
        total, count = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = _matrix(batch, "x").reshape(-1, n_parts, width), _matrix(batch, "codes")
            for p in range(n_parts):
                count[p] += np.bincount(codes[:, p], minlength=n_entries)
                np.add.at(total[p], codes[:, p], x[:, p])
        p, e = np.nonzero(count)
        cells = [np.repeat(p, width), np.repeat(e, width), np.tile(np.arange(width), p.size), total[p, e].ravel(), np.repeat(count[p, e], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["part", "entry", "at", "total", "n"])

    sums = state.select("x", "codes").mapInArrow(run, "part long, entry long, at long, total long, n long").groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    entries = books.entries.copy()
    for r in sums.collect():
        entries[r["part"], r["entry"], r["at"]] = r["total"] // r["n"]
    return entries


def train(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame]:
    """The codebooks, and (vec_id, label, x, codes, lower, error) of every kept vector under them, written."""
    spark = table.sparkSession
    base = f"{shared_dir(spark)}/souk/vector-codes-{uuid.uuid4().hex}"
    vectors, width = integer_vectors(table, id_col, vector_col, label_col, parts)
    state = written(spark, vectors, f"{base}/start")
    begin = state.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in begin], np.int64).reshape(len(begin), parts, width).transpose(1, 0, 2).copy()
    books = Codebooks(start, [group_entries(e) if len(e) else [] for e in start], [])
    if not begin:
        return books, assign(state, books, True)
    last = f"{base}/start"
    for step in range(rounds + 1):
        state = written(spark, assign(state, books, step == 0), f"{base}/{step}")
        discard(spark, last)
        last = f"{base}/{step}"
        if step < rounds:
            books = books.moved(means(state, books))
    return books, state


def compress(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    books, state = train(table, id_col, vector_col, label_col, parts, entries, rounds)
    coded = materialize(state.select("vec_id", "label", F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code"), "error"), "vector-codes")
    by_label = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def codebook_table(spark: SparkSession, books: Codebooks) -> DataFrame:
    """(part, entry, components): as small as the codebooks."""
    rows = [(p, e, c.tolist()) for p, entries in enumerate(books.entries) for e, c in enumerate(entries)]
    return spark.createDataFrame(rows, "part int, entry int, components array<long>")


#: The same in DuckDB SQL: every distance of every round. For vectors of 64 components.
START = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rn, vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)) AS x FROM {embeddings}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
parts AS MATERIALIZED (
  SELECT rn, p, x[p * 16 + 1 : p * 16 + 16] AS x FROM v, range(4) r(p)),
book0 AS MATERIALIZED (SELECT p, rn AS entry, x AS c FROM parts WHERE rn < 256)"""
ASSIGN = r"""
near{r} AS MATERIALIZED (
  SELECT rn, a.p, any_value(x) AS x, min((list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c))::BIGINT * 256 + entry) AS best
  FROM parts a JOIN book{r} b ON a.p = b.p GROUP BY rn, a.p)"""
MOVE = r"""
mean{r} AS MATERIALIZED (
  SELECT p, entry, list(m ORDER BY i) AS c FROM (SELECT p, best % 256 AS entry, i, floor(sum(x[i]) / count(*)) AS m FROM near{r}, range(1, 17) q(i) GROUP BY p, best % 256, i) GROUP BY p, entry),
book{n} AS MATERIALIZED (SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m ON m.p = b.p AND m.entry = b.entry)"""
END = r"""
coded AS (
  SELECT rn, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM near4 GROUP BY rn),
digest AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT), ','), ',' ORDER BY p, entry)) AS s FROM book4)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM v JOIN coded USING (rn), digest
"""


def oracle(embeddings: str = "embeddings") -> str:
    steps = [part.format(r=r, n=r + 1) for r in range(ROUNDS) for part in (ASSIGN, MOVE)] + [ASSIGN.format(r=ROUNDS)]
    return ",".join([START.replace("{embeddings}", embeddings), *steps, END])
