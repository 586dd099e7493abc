"""How filters interact, for every order in which they can be applied: a relational word pipeline.

Words are exploded and aggregated by (document, word), then by document, to totals and distinct counts. The result is outer-joined with
the flags that need no words, identical texts and labels. Documents become counts of each set of failed filters: 32 conditional counts
a part, and as many of its labelled documents. Every order and step is read off those counts, so no order costs another pass over the texts.

A row's words are joined back by its id and a 64-bit hash of its text. Copies of a text meet in aggregates only: of the rows of one
text, part and set of flags, a sum and the rows at the smallest id are kept, however many copies there are.

Defined results: a null text is empty, a null source is the part ''; rows that repeat are documents each; a null id is smaller or larger
than none, so E keeps its row, and it has no label; of several labels of an id the greatest value counts; a document without words
has no share of distinct words, so B keeps it; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import parts, text_bytes

#: The filters by letter; bit i of a set of failures is letter i.
FILTERS = "ABCDE"
#: Fixed by the contract: fewest words, least percentage of distinct words, greatest percentage of capital letters, symbols.
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, SYMBOLS = 50, 65, 5, "[#$%&*|]"
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Bytes of text whose words a task aggregates.
TEXT_PER_TASK = 32_000_000
#: What is counted in each set of failures: documents, those labelled good, those labelled toxic.
COUNTED = ("n", "good", "toxic")
SETS = range(1 << len(FILTERS))


def word_counts(docs: DataFrame) -> DataFrame:
    """(_id, _hash, n_words, n_distinct) of each id and text (columns _id, _text, _hash) that has words; rows that repeat count once.

    Texts are dealt out by document before they are exploded, so neither aggregate sends its words to another task.
    """
    n_tasks = parts(docs.sparkSession, text_bytes(docs), TEXT_PER_TASK)
    dealt = docs.select("_id", "_hash", "_text").repartition(n_tasks, "_id", "_hash")
    words = dealt.select("_id", "_hash", F.posexplode(F.split(F.ltrim("_text", F.lit(" \t\n\v\f\r")), SEPARATORS)).alias("at", "word")).where("word <> ''")
    by_word = words.groupBy("_id", "_hash", "word").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("at") == 0).cast("long")).alias("firsts"))
    totals = by_word.groupBy("_id", "_hash").agg(F.sum("n").alias("n"), F.sum("firsts").alias("rows"), F.count(F.lit(1)).alias("n_distinct"))
    return totals.select("_id", "_hash", F.expr("n div rows").alias("n_words"), "n_distinct")


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, failed, n, good, toxic): documents of each part by the set of filters that they fail; several rows may tell of one set."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part")).withColumn("_hash", F.xxhash64("_text"))
    capitals = F.length(F.regexp_replace("_text", "[^A-Z]+", ""))
    flags = (100 * capitals > MAX_CAPITALS * F.length("_text")).cast("int") * 4 + F.col("_text").rlike(SYMBOLS).cast("int") * 8
    rows = source.select("_id", "_hash", "part", flags.alias("flags"), F.unhex(F.sha2("_text", 256)).alias("digest")).groupBy("_id", "_hash", "part", "flags", "digest").agg(F.count(F.lit(1)).alias("rows"))

    words = word_counts(source).select(F.col("_id").alias("w_id"), F.col("_hash").alias("w_hash"), "n_words", "n_distinct")
    n_words, n_distinct = F.coalesce("n_words", F.lit(0)), F.coalesce("n_distinct", F.lit(0))
    failed = F.col("flags") + (n_words < MIN_WORDS).cast("int") + (100 * n_distinct < MIN_DISTINCT * n_words).cast("int") * 2
    joined = rows.join(words, F.col("_id").eqNullSafe(F.col("w_id")) & (F.col("_hash") == F.col("w_hash")), "left")

    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(a) for c, a in (("quality", "is_good"), ("toxic", "is_toxic"))], F.lit(0).cast("long").alias("l_salt"))
    # a null id has no label: its rows go to the tasks by their hash
    marked = joined.withColumn("salt", F.when(F.col("_id").isNull(), F.col("_hash")).otherwise(F.lit(0))).join(marks, (F.col("_id") == F.col("l_id")) & (F.col("salt") == F.col("l_salt")), "left")
    marked = marked.select("_id", "part", "digest", "rows", failed.alias("failed"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("is_good", "is_toxic")])

    kinds = marked.groupBy("digest", "part", "failed", "is_good", "is_toxic").agg(
        F.sum("rows").alias("n"), F.min("_id").alias("least"), F.min_by("rows", "_id").alias("n_least"), F.sum(F.when(F.col("_id").isNull(), F.col("rows")).otherwise(0)).alias("n_null")
    )
    firsts = kinds.groupBy(F.col("digest").alias("f_digest")).agg(F.min("least").alias("first"))
    kept = F.col("n_null") + F.when(F.col("least") == F.col("first"), F.col("n_least")).otherwise(0)
    told = kinds.join(firsts, F.col("digest") == F.col("f_digest")).select("part", "is_good", "is_toxic", F.explode(F.array(F.struct("failed", kept.alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - kept).alias("n")))).alias("x"))
    return told.select("part", "x.failed", "x.n", (F.col("x.n") * F.col("is_good")).alias("good"), (F.col("x.n") * F.col("is_toxic")).alias("toxic"))


def set_counts(found: DataFrame) -> DataFrame:
    """One row a part with arrays n, good and toxic: item i counts the documents whose failed filters are the set i."""
    counts = [F.sum(F.when(F.col("failed") == i, F.col(c)).otherwise(0)).alias(f"{c}_{i}") for c in COUNTED for i in SETS]
    return found.groupBy("part").agg(*counts).select("part", *[F.array(*[f"{c}_{i}" for i in SETS]).alias(c) for c in COUNTED])


def _passing(counts: str) -> Column:
    """Item s: the documents that fail none of the filters of the set s."""
    return F.expr(f"transform(sequence(0, {SETS[-1]}), s -> aggregate(sequence(0, {SETS[-1]}), 0L, (a, m) -> a + if(m & s = 0, {counts}[m], 0L)))")


def orders(counts: DataFrame) -> DataFrame:
    """Every order and step of each part, from its counts."""
    n_orders = len(list(permutations(FILTERS)))
    passing = counts.select("part", "n", *[_passing(c).alias(f"p_{c}") for c in COUNTED])
    each = passing.withColumn("filter_order", F.explode(F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    bit = "shiftleft(1, ascii(substr(filter_order, step, 1)) - 65)"
    before = "aggregate(filter(sequence(1, 5), i -> i < step), 0, (a, i) -> a + shiftleft(1, ascii(substr(filter_order, i, 1)) - 65))"
    each = each.withColumn("bit", F.expr(bit)).withColumn("before", F.expr(before)).withColumn("after", F.col("bit") + F.col("before"))
    removed = {c: F.expr(f"p_{c}[before] - p_{c}[after]") for c in COUNTED}
    # of all orders, a filter comes first among the m that a document fails in one of m
    shapley = F.expr(f"aggregate(sequence(0, {SETS[-1]}), 0L, (a, m) -> a + if(m & bit <> 0, n[m] * {n_orders} div bit_count(m), 0L))")
    return each.select(
        "part", "filter_order", "step", F.expr("p_n[after]").alias("kept"), removed["n"].alias("removed"),
        (F.expr("p_n[0] - p_n[bit]") - removed["n"]).alias("redundant"), F.expr("n[bit]").alias("unique_fails"),
        removed["good"].alias("good_lost"), removed["toxic"].alias("toxic_lost"), shapley.cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part."""
    return orders(set_counts(failures(docs, labels, id_col, text_col, source_col)))


#: The same in DuckDB SQL, document by document.
SQL = r"""
WITH d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM {documents}),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM {labels} GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 50 AS fa, 100 * len(list_distinct(w)) < 65 * len(w) AS fb,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd, coalesce(d.doc_id > first, false) AS fe
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
names AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM names a, names b, names c, names d, names e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
kinds AS (
  SELECT part, (CASE WHEN fa THEN 'A' ELSE '' END) || (CASE WHEN fb THEN 'B' ELSE '' END) || (CASE WHEN fc THEN 'C' ELSE '' END) || (CASE WHEN fd THEN 'D' ELSE '' END) || (CASE WHEN fe THEN 'E' ELSE '' END) AS failed,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
steps AS (
  SELECT part, filter_order, step::INTEGER AS step, failed, n, good, toxic, substr(filter_order, step::INTEGER, 1) AS letter,
    len(list_filter(string_split(failed, ''), lambda y: y <> '' AND instr(substr(filter_order, 1, step::INTEGER - 1), y) > 0)) > 0 AS gone
  FROM kinds, o, range(1, 6) r(step)),
report AS (
  SELECT part, filter_order, step, letter, sum(n) FILTER (WHERE NOT gone AND NOT contains(failed, letter)) AS kept, sum(n) FILTER (WHERE NOT gone AND contains(failed, letter)) AS removed,
    sum(n) FILTER (WHERE gone AND contains(failed, letter)) AS redundant, sum(n) FILTER (WHERE failed = letter) AS unique_fails,
    sum(good) FILTER (WHERE NOT gone AND contains(failed, letter)) AS good_lost, sum(toxic) FILTER (WHERE NOT gone AND contains(failed, letter)) AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, letter), 0)::BIGINT AS shapley
FROM report
"""


def oracle(documents: str = "documents", labels: str = "labels") -> str:
    return SQL.replace("{documents}", documents).replace("{labels}", labels)
