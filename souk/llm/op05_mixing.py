"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Each source gets a share of all words by its weight, held to at most `cap` times its own words; what is cut there goes to
the others by weight. A document's expected copies are its source's target over its source's words. Expected copies are
summed up in an order of the documents within their source, one offset is added, and a document is taken once for each
whole number that its stretch of the running sum crosses.

The order runs through size classes, so that the words taken stay near the target: documents of like size lie together and
each stretch of them gives its share. The running sum needs no task that holds a source: documents are ranked within
(source, class, salt), and only the counts of these cells, some thousands a source, are summed per source.

Defined results: a null text has size 0; a null source is a source of its own, last; an empty table gives no rows; rows
that repeat are documents of their own; size 0 is never taken in words; with no words at all every target is 0.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import materialize, unused

#: Fixed by the contract: weights of the sources in order, repeating, and the most a source or document may repeat.
WEIGHTS = (5, 2, 1)
CAP = 3
WORD = r"[^\x20\x09-\x0D]+"
#: Hash cells for a size class in a source: so many, and as many again for each further ROWS_PER_SALTS documents, so that a class
#: that holds a third of all rows is split into cells of bounded size.
SALTS = 64
ROWS_PER_SALTS = 20_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Sizes that share their five leading bits: classes no wider than a sixteenth of the size."""
    bits = F.length(F.bin(size))
    shift = F.greatest(bits - 5, F.lit(0)).cast("int")
    return (bits * 32 + F.call_function("shiftright", size, shift)).cast("int")


def digest(column: Column) -> Column:
    return F.md5(F.coalesce(column.cast("string"), F.lit("")))


def weighed(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, weight): weights go round the sources by code point, null last. Sources are dealt to ranges, numbered within
    them, and only the ranges' sizes, one for each task, are summed up in one place."""
    ranged = materialize(sources.select("source", "source_size").repartitionByRange(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(F.col("range").alias("r")).agg(F.count(F.lit(1)).alias("n")).select("r", F.coalesce(F.sum("n").over(before.orderBy("r")), F.lit(0)).alias("start"))
    ordinal = F.col("start") + F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1
    picked = F.element_at(F.array(*[F.lit(w) for w in weights]), (ordinal % len(weights) + 1).cast("int")).cast("long")
    return materialize(ranged.join(starts, F.col("range") == F.col("r")).withColumn("weight", picked).select("source", "source_size", "weight"), "mix-weights")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): each source's words in the mix.

    Sources whose share is above their cap are held to it, and what is left of the words and of the weights makes the share of
    the others; that is repeated, one aggregate a round, until no other source is above its cap.
    """
    found, exact = weighed(sources, weights), "decimal(38,0)"
    words, weight = (found.agg(F.sum(F.col(c).cast(exact))).first()[0] or 0 for c in ("source_size", "weight"))
    total, all_weight, held = int(words), int(weight), -1
    words, weight = total, all_weight

    def above() -> Column:
        return F.col("weight").cast(exact) * F.lit(Decimal(words)) > F.col("source_size").cast(exact) * F.lit(Decimal(cap * weight))

    while weight:
        row = found.where(above()).agg(F.count(F.lit(1)), F.sum(F.col("source_size").cast(exact)), F.sum("weight")).first()
        if row[0] == held:
            break
        held = row[0]
        words, weight = total - cap * int(row[1] or 0), all_weight - int(row[2] or 0)
    most = (F.col("source_size") * cap).cast("double")
    share = F.when(above(), most).otherwise((F.col("weight") * F.lit(words)).cast("double") / F.lit(float(weight))) if weight else most
    return found.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(share).alias("target"))


def _offset(seed: int, source: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))), 1, 5), 16, 10).cast("double") / F.lit(float(1 << 20))


def _cell(size: Column, doc_id: Column, salts: int) -> tuple[Column, Column]:
    """Size class and salt of a document."""
    return size_class(size), (F.conv(F.substring(digest(doc_id), 1, 8), 16, 10).cast("long") % salts).cast("int")


def _cell_facts(sized: DataFrame, seed: int) -> DataFrame:
    """(f_source, f_class, f_salt, start, source_size, target, each, offset): a row for each cell of sized (source, size, class, salt)."""
    cells = materialize(sized.groupBy("source", "class", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")), "mix-counts")
    per_source = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")))
    running = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("n").over(running), F.lit(0)))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = starts.alias("c").join(per_source.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
    facts = joined.select(F.col("c.source").alias("f_source"), F.col("class").alias("f_class"), F.col("salt").alias("f_salt"), "start", "source_size", "target")
    return materialize(facts.withColumn("each", each).withColumn("offset", _offset(seed, F.col("f_source"))), "mix-cells")


def salts_for(docs: DataFrame) -> int:
    return SALTS * max(1, -(-docs.count() // ROWS_PER_SALTS))


def _copies(start: Column, rank: Column, each: Column, offset: Column) -> Column:
    at = start + rank
    return F.least(F.floor((at + 1) * each + offset) - F.floor(at * each + offset), F.lit(CAP)).cast("long")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, salts: int | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    salts = salts or salts_for(docs)
    in_class, in_salt = _cell(F.col("size"), F.col("doc_id"), salts)
    sized = materialize(sized.withColumn("class", in_class).withColumn("salt", in_salt), "mix-sizes")
    rank = F.row_number().over(Window.partitionBy("source", "class", "salt").orderBy("size", digest(F.col("doc_id")), "doc_id")) - 1
    joined = sized.withColumn("rank", rank).join(_cell_facts(sized, seed), F.col("source").eqNullSafe(F.col("f_source")) & (F.col("class") == F.col("f_class")) & (F.col("salt") == F.col("f_salt")))
    copies = _copies(F.col("start"), F.col("rank"), F.col("each"), F.col("offset"))
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def draw(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, salts: int | None = None) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with all its columns. Copies are dealt to rows, so rows that share an
    id are taken by their own share each. Rows are shuffled once, to their cells, and no id is joined back."""
    plain = docs.select(F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.col(id_col).alias("doc_id"))
    salts = salts or salts_for(docs)
    in_class, in_salt = _cell(F.col("size"), F.col("doc_id"), salts)
    facts = _cell_facts(plain.withColumn("class", in_class).withColumn("salt", in_salt), seed)
    size, kind, salt, rank, n = unused([*docs.columns, *facts.columns], "mix_size", "mix_class", "mix_salt", "mix_rank", "mix_n")
    renamed = dict(zip(facts.columns, unused([*docs.columns, size, kind, salt, rank, n], *facts.columns), strict=True))
    facts = facts.withColumnsRenamed(renamed)
    source, doc_id = F.col(source_col).cast("string"), F.col(id_col)
    sized = docs.withColumn(size, word_count(F.col(text_col)))
    in_class, in_salt = _cell(F.col(size), doc_id, salts)
    placed = sized.withColumn(kind, in_class).withColumn(salt, in_salt)
    placed = placed.withColumn(rank, F.row_number().over(Window.partitionBy(source, kind, salt).orderBy(size, digest(doc_id), doc_id)) - 1)
    met = placed.join(facts, source.eqNullSafe(F.col(renamed["f_source"])) & (F.col(kind) == F.col(renamed["f_class"])) & (F.col(salt) == F.col(renamed["f_salt"])))
    copies = _copies(*[F.col(x) for x in (renamed["start"], rank, renamed["each"], renamed["offset"])])
    taken = met.withColumn(n, copies).where(F.col(n) > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias(n))
    return taken.drop(n)


#: The same in DuckDB SQL over `documents`; {seed}, {salts} and {documents} are filled in.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '')) AS k FROM {documents}),
binned AS (
  SELECT *, length(CASE WHEN size = 0 THEN '0' ELSE ltrim(bin(size), '0') END) AS bits, ('0x' || substr(k, 1, 8))::BIGINT % {salts} AS salt FROM sized),
classed AS (SELECT *, bits * 32 + (size >> greatest(bits - 5, 0)::BIGINT) AS class FROM binned),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::HUGEINT AS weight FROM sources),
leveled AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS left_words,
    sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight FROM weighted
  WINDOW w AS (ORDER BY source_size / weight ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT left_words AS w, left_weight AS g FROM leveled WHERE weight * left_words <= 3 * source_size * left_weight
  ORDER BY source_size / weight, left_words, left_weight LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0
    WHEN (SELECT w FROM level) IS NULL OR weight * (SELECT w FROM level) > 3 * source_size * (SELECT g FROM level) THEN (3 * source_size)::DOUBLE
    ELSE (weight * (SELECT w FROM level))::DOUBLE / (SELECT g FROM level)::DOUBLE END AS target FROM weighted),
placed AS (
  SELECT c.doc_id, c.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
    ('0x' || substr(md5('{seed}:' || coalesce(c.source, '')), 1, 5))::BIGINT::DOUBLE / 1048576.0 AS u,
    row_number() OVER (PARTITION BY c.source ORDER BY class, salt, c.size, k, c.doc_id) - 1 AS i
  FROM classed c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (least(floor((i + 1) * each + u) - floor(i * each + u), 3)::BIGINT * size)::BIGINT AS taken FROM placed
"""


def oracle(documents: str = "documents", seed: int = 7, salts: int | None = None) -> str:
    dealt = salts or f"(SELECT {SALTS} * greatest(1, ceil(count(*) / {ROWS_PER_SALTS}.0))::BIGINT FROM {documents})"
    return SQL.replace("{documents}", documents).replace("{seed}", str(seed)).replace("{salts}", str(dealt))
