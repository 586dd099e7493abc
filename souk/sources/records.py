"""Records of the shop's API: landed as JSON lines, read as text fields, incremental loads of record versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from souk.operators import history
from souk.sources import shop_api
from souk.sources.files import Files
from souk.sources.lake import Lake
from souk.sources.shop_api import FIELDS, KEYS


def land(records: DataFrame, folder: str, run_id: str) -> int:
    """Writes records (column _raw) as JSON lines by the executors. The run's folder appears under its name only when whole, and not at
    all if there is no record; returns how many there are."""
    files, told = Files(records.sparkSession), Observation()
    staged = f"{folder}/_staged-{run_id}"
    try:
        records.select(F.col("_raw").alias("value")).observe(told, F.count(F.lit(1)).alias("n")).write.text(staged)
        if told.get["n"]:
            files.rename(staged, f"{folder}/{run_id}")
    finally:
        files.delete(staged)
    return told.get["n"]


def read_lines(spark: SparkSession, path: str, entity: str, run_id: str) -> DataFrame:
    """JSON lines as text fields, with the raw line; a line that is no JSON has nulls."""
    schema = ", ".join(f"{f} STRING" for f in FIELDS[entity])
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_name").alias("_source_file"))
    return lines.withColumn("r", F.from_json("value", schema)).select("r.*", F.col("value").alias("_raw"), "_source_file", F.current_timestamp().alias("_ingested_at"), F.lit(run_id).alias("_run_id"))


def load_versions(spark: SparkSession, lake: Lake, url: str, entity: str, landing: str, run_id: str, full: bool = False, margin_minutes: int = 10, **options: object) -> dict[str, int]:
    """Fetches what changed since the stored watermark and appends the versions that are not stored. options: of the data source."""
    table, keys = f"bronze/{entity}", [KEYS[entity], "updated_at"]
    since = None if full or not lake.exists(table) else history.watermark(lake.read(table), "updated_at", margin_minutes).first()["updated_since"]
    fetched = land(shop_api.read(spark, url, entity, since, **options), landing, run_id)
    if not fetched:
        return {"fetched": 0, "stored": 0}
    rows, told = read_lines(spark, f"{landing}/{run_id}", entity, run_id), Observation()
    new = history.only_new(rows, lake.read(table), keys).select(*rows.columns) if lake.exists(table) else rows
    lake.append(new.observe(told, F.count(F.lit(1)).alias("n")), table)
    return {"fetched": fetched, "stored": told.get["n"]}
