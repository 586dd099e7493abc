"""The marketplace's daily CSV files: ; between fields, header checked, short rows kept with their raw line."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.plans.cleaning import EXPORT_COLUMNS
from souk.sources.files import Files
from souk.sources.lake import Lake

#: Fixed value: how the files are named.
NAME = re.compile(r"marketplace_orders_(\d{4}-\d{2}-\d{2})\.csv")


class MissingFiles(RuntimeError):
    """Days of the range have no file."""


def available(spark: SparkSession, folder: str) -> dict[dt.date, str]:
    found = {dt.date.fromisoformat(m[1]): f"{folder}/{n}" for n in Files(spark).names(folder) if (m := NAME.fullmatch(n))}
    return dict(sorted(found.items()))


def select_days(files: dict[dt.date, str], first: dt.date, last: dt.date) -> tuple[dict[dt.date, str], list[dt.date]]:
    """(files of the days, days without one), both ends included."""
    days = [first + dt.timedelta(n) for n in range((last - first).days + 1)]
    return {d: files[d] for d in days if d in files}, [d for d in days if d not in files]


def read(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """All text. A renamed or reordered header fails the read; a row of other length is kept, with its line in _corrupt_record.
    Paths that are all the export files of a folder are read as that folder, which is listed once."""
    paths = list(paths)
    folders = {p.rsplit("/", 1)[0] for p in paths}
    whole = len(folders) == 1 and len(paths) > 1 and len(paths) == len(available(spark, folder := next(iter(folders))))
    schema = ", ".join(f"{c} STRING" for c in [*EXPORT_COLUMNS, "_corrupt_record"])
    reader = spark.read.option("pathGlobFilter", "marketplace_orders_*.csv") if whole else spark.read
    return reader.csv(folder if whole else paths, schema=schema, sep=";", header=True, enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def with_lineage(df: DataFrame, run_id: str) -> DataFrame:
    """File name, its day, load time and run; for rows read from files."""
    day = F.nullif(F.regexp_extract("_metadata.file_name", r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")).try_cast("date")
    return df.select("*", F.col("_metadata.file_name").alias("_source_file"), day.alias("_file_date"), F.current_timestamp().alias("_ingested_at"), F.lit(run_id).alias("_run_id"))


def load(spark: SparkSession, lake: Lake, folder: str, first: dt.date, last: dt.date, run_id: str, skip_missing: bool = False) -> int:
    """Loads the days into bronze, each replacing what it held; returns the number of files."""
    files, missing = select_days(available(spark, folder), first, last)
    if missing and not skip_missing:
        raise MissingFiles(", ".join(map(str, missing)))
    if files:
        lake.replace_slices(with_lineage(read(spark, files.values()), run_id), "bronze/marketplace_orders", "_file_date", map(str, files))
    return len(files)


def write(df: DataFrame, folder: str) -> None:
    """Export rows (with file_date) as one file for each day, named as the marketplace does. For fixtures. Files are written by the
    executors, header first, and only renamed here."""
    files = Files(df.sparkSession)
    staged = f"{folder}/_staged"
    line = F.concat_ws(";", *[F.coalesce(c, F.lit("")) for c in EXPORT_COLUMNS])
    torn = F.concat_ws(";", "numero_commande", "date_commande")
    lines = df.select("file_date", F.lit(1).alias("place"), F.when(F.col("torn"), torn).otherwise(line).alias("value"))
    headers = df.select("file_date").distinct().select("file_date", F.lit(0).alias("place"), F.lit(";".join(EXPORT_COLUMNS)).alias("value"))
    ordered = lines.unionAll(headers).repartition("file_date").sortWithinPartitions("file_date", "place")
    ordered.select("file_date", "value").write.partitionBy("file_date").option("compression", "none").text(staged)
    written = {re.search(r"file_date=([^/]+)/", p)[1]: p for p in files.matching(f"{staged}/file_date=*/part-*")}
    files.rename_all({p: f"{folder}/marketplace_orders_{day}.csv" for day, p in written.items()})
    files.delete(staged)
