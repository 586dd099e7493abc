"""Tables into a relational database over JDBC, all of them in one transaction.

Executors write each table to a staging table in parallel; the driver then moves all of them in one transaction, so readers see
the old tables or the new ones. A table whose columns have changed is made anew.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LOADED_AT = "_loaded_at"


class Unmapped(TypeError):
    """A column has a type for which the database has none."""


def column_type(kind: T.DataType, text: str = "TEXT") -> str:
    """The type of a column; instants are written as timestamps in UTC, text as the database calls it."""
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    plain = {T.StringType: text, T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.DoubleType: "DOUBLE PRECISION", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampType: "TIMESTAMP", T.TimestampNTZType: "TIMESTAMP"}
    if type(kind) not in plain:
        raise Unmapped(kind.simpleString())
    return plain[type(kind)]


@dataclass
class Database:
    spark: SparkSession
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    #: What the database calls text of any length.
    text: str = "TEXT"

    @contextlib.contextmanager
    def transaction(self) -> Iterator[object]:
        """A statement whose effects are kept if the block ends well, and undone if not."""
        jvm = self.spark._jvm
        p = jvm.java.util.Properties()
        for k, v in self.properties.items():
            if k != "driver":
                p.setProperty(k, v)
        if "driver" in self.properties:
            jvm.java.lang.Class.forName(self.properties["driver"])
        connection = jvm.java.sql.DriverManager.getConnection(self.url, p)
        try:
            connection.setAutoCommit(False)
            yield connection.createStatement()
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.close()

    def columns(self, statement: object, table: str) -> list[tuple[str, str]] | None:
        """(name, type name) of the columns of a table, or None."""
        schema, _, name = table.rpartition(".")
        found = statement.getConnection().getMetaData().getColumns(None, schema.upper() or None, name.upper(), None)
        out = []
        while found.next():
            out.append((found.getString("COLUMN_NAME").lower(), found.getString("TYPE_NAME")))
        return out or None

    def publish(self, frames: Mapping[str, DataFrame]) -> dict[str, str]:
        """Replaces the tables (schema.table) and tells of each whether it was created, recreated or refilled."""
        definitions = {n: ", ".join([*(f"{f.name} {column_type(f.dataType, self.text)}" for f in df.schema.fields), f'"{LOADED_AT}" TIMESTAMP DEFAULT CURRENT_TIMESTAMP']) for n, df in frames.items()}
        with self.transaction() as s:
            for name, definition in definitions.items():
                staged = f"{name}__new"
                if self.columns(s, staged):
                    s.executeUpdate(f"DROP TABLE {staged}")
                s.executeUpdate(f"CREATE TABLE {staged} ({definition})")
        for name, df in frames.items():
            df.write.mode("append").jdbc(self.url, f"{name}__new", properties=self.properties)
        done = {}
        with self.transaction() as s:
            for name, df in frames.items():
                now, wanted = self.columns(s, name), self.columns(s, f"{name}__new")
                done[name] = "created" if now is None else "refilled" if now == wanted else "recreated"
                if done[name] == "recreated":
                    s.executeUpdate(f"DROP TABLE {name}")
                if done[name] != "refilled":
                    s.executeUpdate(f"CREATE TABLE {name} ({definitions[name]})")
                else:
                    s.executeUpdate(f"DELETE FROM {name}")
                named = ", ".join(df.columns)
                s.executeUpdate(f"INSERT INTO {name} ({named}) SELECT {named} FROM {name}__new")
            for name in frames:
                s.executeUpdate(f"DROP TABLE {name}__new")
        return done
