"""Lake tables as Spark writes them: a folder of Parquet files each. Tables are appended to, overwritten, or, where they are sliced by
a column such as a day, replaced slice by slice by Spark's dynamic partition overwrite, which leaves all other slices unread. A load that is
repeated gives the same rows. One writer at a time is taken for granted; the daily jobs hold a lease (plans/flow.py)."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.sources.files import Files

#: Types that a published table may have; any other is refused.
PUBLISHABLE = (T.StringType, T.IntegerType, T.LongType, T.DecimalType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
SLICE = "_slice"
_OUTSIDE = "row outside the slices that are replaced: "


class OutsideSlice(ValueError):
    """Rows outside the slices that are replaced, or with none."""


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        return any(n.endswith(".parquet") or n.startswith(f"{SLICE}=") for n in self.files.names(self.path(table)))

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(self.path(table)).drop(SLICE)

    def slices(self, table: str) -> list[str]:
        """The slices that a table has."""
        return [n.removeprefix(f"{SLICE}=") for n in self.files.names(self.path(table)) if n.startswith(f"{SLICE}=")]

    def append(self, df: DataFrame, table: str, sliced_by: str | None = None) -> None:
        """Adds rows. A table that is sliced stays so: its column is named each time."""
        if sliced_by is None:
            df.write.mode("append").parquet(self.path(table))
        else:
            self._sliced(df, sliced_by).write.partitionBy(SLICE).mode("append").parquet(self.path(table))

    def overwrite(self, df: DataFrame, table: str) -> None:
        self.publish({table: df}, plain=False)

    def publish(self, frames: Mapping[str, DataFrame], plain: bool = True) -> None:
        """Replaces the tables. All are written aside first, so a table may be made from itself, and none changes if writing any of them
        fails; then each is moved to its place. plain: refuses nested columns."""
        for name, df in frames.items() if plain else ():
            check_publishable(df.schema, name)
        aside = f"{self.root}/_aside-{uuid.uuid4().hex}"
        try:
            for name, df in frames.items():
                df.write.parquet(f"{aside}/{name}")
            for name in frames:
                self.files.delete(self.path(name))
                self.files.make_folder(self.path(name).rsplit("/", 1)[0])
                self.files.rename(f"{aside}/{name}", self.path(name))
        finally:
            self.files.delete(aside)

    @staticmethod
    def _sliced(df: DataFrame, column: str, inside: Column | None = None) -> DataFrame:
        """df with the slice of each row. A row without one, or for which inside does not hold, fails the write."""
        held = F.col(column).isNotNull() if inside is None else F.col(column).isNotNull() & F.coalesce(inside, F.lit(False))
        slice_ = F.col(column).cast("string")
        checked = F.when(held, slice_).otherwise(F.raise_error(F.concat(F.lit(_OUTSIDE), F.coalesce(slice_, F.lit("null")))).cast("string"))
        return df.withColumn(SLICE, checked)

    def replace_slices(self, df: DataFrame, table: str, column: str, slices: Iterable[str] | None = None, inside: Column | None = None) -> None:
        """Replaces, for each value of the column in df, all rows with that value. Of the slices that are named, those without a row in df
        are emptied. Rows for which inside does not hold, and nulls, are refused."""
        told, named = Observation(), set(slices or ())
        sliced, tasks = self._sliced(df, column, inside), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # few slices may be large and are split by their size; many are dealt out, as a small file each takes its time
        dealt = sliced.repartition(tasks, SLICE) if len(named) > tasks else sliced.hint("rebalance", SLICE)
        found = dealt.observe(told, F.collect_set(SLICE).alias("own"))
        try:
            found.write.partitionBy(SLICE).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path(table))
        except Exception as e:
            if _OUTSIDE in str(e):
                raise OutsideSlice(table) from e
            raise
        own = set(told.get["own"])
        for name in named & set(self.slices(table)) - own:
            self.files.delete(f"{self.path(table)}/{SLICE}={name}")

    def replace_where(self, df: DataFrame, table: str, column: str, condition: Column) -> None:
        """Replaces the slices for which a condition on the column holds, by rows for which it holds; the first load creates the table."""
        names = self.spark.createDataFrame([(n,) for n in self.slices(table)], f"{column} STRING").withColumn(column, F.col(column).cast(df.schema[column].dataType))
        replaced = [r[0] for r in names.where(condition).select(F.col(column).cast("string")).collect()]
        self.replace_slices(df, table, column, replaced, condition)


def check_publishable(schema: T.StructType, table: str) -> None:
    for field in schema.fields:
        if not isinstance(field.dataType, PUBLISHABLE):
            raise TypeError(f"{table}.{field.name}: {field.dataType.simpleString()} cannot be published")
