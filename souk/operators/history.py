"""Record versions: validity periods, current rows, lookup as of an instant, incremental loads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.operators.rows import first_per_key


def validity_periods(versions: DataFrame, key: str, changed: str, created: str, newest_copy: Sequence[Column]) -> DataFrame:
    """valid_from, valid_to, is_current of each version of a key.

    Copies of one version are reduced to the first by newest_copy. The first known version holds since the record was
    created, if that is earlier.
    """
    # dealt out by key, so that copies and neighbours of a version need one shuffle
    single = first_per_key(versions.repartition(key), [key, changed], newest_copy)
    over = Window.partitionBy(key).orderBy(changed)
    return (
        single.withColumn("_nth", F.row_number().over(over))
        .withColumn("valid_to", F.lead(changed).over(over))
        .withColumn("valid_from", F.when(F.col("_nth") == 1, F.least(F.col(created), F.col(changed))).otherwise(F.col(changed)))
        .withColumn("is_current", F.col("valid_to").isNull())
        .drop("_nth")
    )


#: Days of facts and versions of a key that are looked through together.
BUCKET_DAYS = 30


def as_of(facts: DataFrame, instant: str, fact_key: str, periods: DataFrame, period_key: str, columns: Sequence[str], bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """facts with the columns of the version that held at their instant, null where none did. Periods of a key must not overlap.

    Facts and versions are laid in one order of time and the last version is carried forward, so no fact meets more than one version. Time is
    cut into buckets: what a bucket starts with is carried over the buckets of a key, of which there are few, and joined to its rows. A key
    with very many facts is thus spread over as many tasks as it has buckets.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    carried = F.struct(micros("valid_to").alias("until"), *[F.col(x).alias(x) for x in columns])
    whole = F.struct(*[F.col(f"`{x}`") for x in facts.columns])
    versions = periods.select(F.col(period_key).alias("_k"), micros("valid_from").alias("_at"), F.lit(0).alias("_kind"), carried.alias("_version")).where("_k is not null and _at is not null")
    known = facts.select(F.col(fact_key).alias("_k"), micros(instant).alias("_at"), F.lit(1).alias("_kind"), whole.alias("_fact"))
    rows = versions.unionByName(known.where("_k is not null and _at is not null"), allowMissingColumns=True).withColumn("_bucket", F.floor(F.col("_at") / (bucket_days * 86_400_000_000)))
    inside = Window.partitionBy("_k", "_bucket").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy("_k", "_bucket").agg(F.max_by("_version", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"))
    starts = last.select("_k", "_bucket", F.last("_last", True).over(before).alias("_start"))
    met = rows.withColumn("_own", F.last("_version", True).over(inside)).where("_kind = 1").join(starts, ["_k", "_bucket"])
    met = met.select("_fact", "_at", F.coalesce("_own", "_start").alias("_held"))
    holds = F.coalesce(F.col("_at") < F.col("_held.until"), F.col("_held").isNotNull())
    found = met.select("_fact.*", *[F.when(holds, F.col(f"_held.{x}")).alias(x) for x in columns])
    without = facts.where(F.col(fact_key).isNull() | F.col(instant).isNull())
    return found.unionAll(without.select("*", *[F.lit(None).cast(periods.schema[x].dataType).alias(x) for x in columns]))


def watermark(stored: DataFrame, changed: str, margin_minutes: int = 10) -> DataFrame:
    """One row: the newest change less a margin, as ISO text in UTC; null for an empty table."""
    newest = F.max(F.col(changed).try_cast("timestamp")) - F.expr(f"INTERVAL '{int(margin_minutes)}' MINUTE")
    return stored.agg(F.date_format(newest, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("updated_since"))


def only_new(fetched: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fetched rows whose keys are not stored; rows with a null key are never taken for stored ones."""
    return fetched.join(stored.select(*keys).distinct(), list(keys), "left_anti")
