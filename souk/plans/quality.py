"""Data quality: a catalogue of checks as SQL conditions, all conditions of a table in one aggregate.

A check says what must hold: of each row (`row`), of the whole table (`table`), that no two rows share a key (`key`), or that a row's
key is found in another table (`found`). Conditions are SQL that Spark and other engines read alike. Conditions that are null for
a row do not concern it.
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions import columns as c
from souk.operators.joins import flagged
from souk.operators.lifecycle import STATUSES

#: Fixed values of the shop: its sales channels, and how its own order numbers look.
CHANNELS = ("web", "mobile", "marketplace")
ORDER_NUMBER = r"^WEB-[0-9]{8}-[0-9]{5}$"
#: The layout of a check's result.
RESULT = (
    "run_id STRING, checked_at TIMESTAMP_NTZ, layer STRING, table_name STRING, check_name STRING, dimension STRING, severity STRING, description STRING, expectation STRING, column_name STRING, "
    "success BOOLEAN, status STRING, element_count BIGINT, unexpected_count BIGINT, unexpected_percent DOUBLE, observed_value STRING, sample STRING"
)
MOST_CHARACTERS = 300
#: Values that a check shows of those against it: one of each class by hash, so the aggregate is bounded and its result does not depend on order.
SAMPLES = 5
#: The layout of rows that fail checks of rows or keys.
FAILING = "layer STRING, table_name STRING, check_name STRING, shown STRING, record STRING"

#: The shop's 88 checks, with their names, dimensions, severities and limits. A heading names the tables that the lines
#: below it are about; a line is name, dimension, severity and condition. `98% row` must hold for that share of the rows concerned;
#: `table x:` is measured on table x. {statuses}, {channels} and {order_number} are filled in; age_minutes and age_days count up to now.
CATALOGUE = r"""
bronze.freshness
  order_events_fresh                    freshness     warning  table bronze.order_events: age_minutes(max(_ingested_at)) <= 60
  customers_fresh                       freshness     warning  table bronze.customers: round(age_minutes(max(_ingested_at)) / 60, 1) <= 26
  marketplace_export_fresh              freshness     warning  table bronze.marketplace_orders: age_days(max(_file_date)) <= 1
silver.customers
  has_rows                              volume        error    table: count(*) >= 1
  customer_id_not_null                  completeness  error    row: customer_id IS NOT NULL
  customer_id_valid_from_unique         uniqueness    error    key: customer_id, valid_from
  one_current_version                   uniqueness    error    key: customer_id WHERE is_current
  email_not_null                        completeness  warning  99% row: email IS NOT NULL
  email_format                          validity      error    row: email RLIKE '{email}'
  postal_code_not_null                  completeness  warning  98% row: postal_code IS NOT NULL
  postal_code_format                    validity      error    row: postal_code RLIKE '{postal_code}'
  valid_to_not_before_valid_from        consistency   error    row: valid_to >= valid_from
silver.products
  has_rows                              volume        error    table: count(*) >= 1
  product_id_not_null                   completeness  error    row: product_id IS NOT NULL
  name_not_null                         completeness  error    row: name IS NOT NULL
  product_id_valid_from_unique          uniqueness    error    key: product_id, valid_from
  one_current_version                   uniqueness    error    key: product_id WHERE is_current
  unit_price_in_range                   validity      error    row: unit_price BETWEEN 0.01 AND 100000
  category_not_null                     completeness  warning  95% row: category IS NOT NULL
  valid_to_not_before_valid_from        consistency   error    row: valid_to >= valid_from
silver.order_events
  has_rows                              volume        error    table: count(*) >= 1
  event_id_not_null                     completeness  error    row: event_id IS NOT NULL
  event_id_unique                       uniqueness    error    key: event_id
  event_ts_not_null                     completeness  error    row: event_ts IS NOT NULL
  event_type_known_value                validity      error    row: event_type IN ('order_created', 'order_status_changed')
  order_id_format                       validity      error    row: order_id RLIKE '{order_number}'
  status_known_value                    validity      error    row: status IN ({statuses})
silver.web_order_lines silver.marketplace_order_lines
  has_rows                              volume        error    table: count(*) >= 1
  order_id_line_number_unique           uniqueness    error    key: order_id, line_number
  order_id_not_null                     completeness  error    row: order_id IS NOT NULL
  order_ts_not_null                     completeness  error    row: order_ts IS NOT NULL
  product_id_not_null                   completeness  error    row: product_id IS NOT NULL
  customer_id_not_null                  completeness  warning  99% row: customer_id IS NOT NULL
  status_known_value                    validity      error    row: status IN ({statuses})
  channel_known_value                   validity      error    row: channel IN ({channels})
  quantity_in_range                     validity      error    row: quantity BETWEEN 1 AND 1000
  unit_price_in_range                   validity      error    row: unit_price BETWEEN 0 AND 100000
  discount_pct_in_range                 validity      error    row: discount_pct BETWEEN 0 AND 100
  status_ts_not_before_order_ts         consistency   error    row: status_ts >= order_ts
silver.reject_rates
  reject_rate_usual                     volume        warning  table: max(reject_rate_pct) <= 1
  reject_rate_acceptable                volume        error    table: max(reject_rate_pct) <= 5
gold.orders
  has_rows                              volume        error    table: count(*) >= 1
  order_id_not_null                     completeness  error    row: order_id IS NOT NULL
  order_id_unique                       uniqueness    error    key: order_id
  order_date_not_null                   completeness  error    row: order_date IS NOT NULL
  customer_id_not_null                  completeness  warning  99% row: customer_id IS NOT NULL
  status_known_value                    validity      error    row: status IN ({statuses})
  channel_known_value                   validity      error    row: channel IN ({channels})
  lines_count_in_range                  validity      error    row: lines_count >= 1
  units_in_range                        validity      error    row: units >= 1
  total_amount_in_range                 validity      error    row: total_amount >= 0
  total_is_net_plus_shipping            consistency   error    row: total_amount = net_amount + shipping_fee
  total_matches_declared_total          consistency   error    row: abs(total_amount - source_total_amount) <= lines_count * 0.01
  order_date_not_in_future              validity      error    row: age_days(order_date) >= 0
  shipped_at_not_before_order_ts        consistency   error    row: shipped_at >= order_ts
  delivered_at_not_before_shipped_at    consistency   error    row: delivered_at >= shipped_at
  returned_at_not_before_delivered_at   consistency   error    row: returned_at >= delivered_at
gold.orders_freshness
  orders_fresh                          freshness     warning  table gold.orders: age_days(max(order_date)) <= 1
gold.order_lines
  has_rows                              volume        error    table: count(*) >= 1
  order_id_line_number_unique           uniqueness    error    key: order_id, line_number
  quantity_in_range                     validity      error    row: quantity BETWEEN 1 AND 1000
  net_amount_in_range                   validity      error    row: net_amount >= 0
  order_exists                          consistency   error    found: order_id IN gold.orders
  product_exists                        consistency   error    found: product_id IN gold.products
  gross_is_quantity_times_price         consistency   error    row: gross_amount = quantity * unit_price
  net_is_gross_minus_discount           consistency   error    row: net_amount = gross_amount - discount_amount
gold.customers
  has_rows                              volume        error    table: count(*) >= 1
  customer_id_not_null                  completeness  error    row: customer_id IS NOT NULL
  customer_id_unique                    uniqueness    error    key: customer_id
  signup_date_not_null                  completeness  error    row: signup_date IS NOT NULL
  email_not_null                        completeness  warning  99% row: email IS NOT NULL
gold.products
  has_rows                              volume        error    table: count(*) >= 1
  product_id_not_null                   completeness  error    row: product_id IS NOT NULL
  product_id_unique                     uniqueness    error    key: product_id
  category_not_null                     completeness  error    row: category IS NOT NULL
  unit_price_not_null                   completeness  warning  95% row: unit_price IS NOT NULL
"""

_CONDITION = re.compile(r"(?:(?P<percent>\d+)% )?(?P<kind>row|table|key|found)(?: (?P<frame>[a-z_.]+))?: (?P<text>.+)")
_LIMIT = re.compile(r"(?P<measure>.+) (?P<sign><=|>=) (?P<limit>[\d.]+)$")


@dataclass(frozen=True)
class Check:
    """frame: the table that is looked at; percent: the share of rows for which a row condition must hold; where: the rows a key is of."""

    layer: str
    table: str
    name: str
    dimension: str
    severity: str
    frame: str
    kind: str
    text: str
    percent: int = 100

    @property
    def says(self) -> str:
        most = "" if self.percent == 100 else f" for {self.percent} % of the rows"
        return {"row": f"{self.text}{most}", "table": self.text, "key": f"one row for each {self.text}", "found": self.text}[self.kind]

    @property
    def expectation(self) -> str:
        return f"{'' if self.percent == 100 else f'{self.percent}% '}{self.kind}: {self.text}"


def parse(catalogue: str, **values: str) -> list[Check]:
    """The checks of a catalogue, in order. Two checks of a table with one name are refused."""
    for name, value in values.items():
        catalogue = catalogue.replace("{" + name + "}", value)
    tables: list[str] = []
    lines: list[tuple[list[str], list[str]]] = []
    for line in filter(str.strip, catalogue.split("\n")):
        if line[0] != " ":
            tables = line.split()
            lines.append((tables, []))
        else:
            lines[-1][1].append(line)
    found = []
    for tables, own in lines:
        for full in tables:
            layer, table = full.split(".")
            for line in own:
                name, dimension, severity, condition = line.split(None, 3)
                m = _CONDITION.fullmatch(condition)
                if not m:
                    raise ValueError(f"{full}.{name}: {condition}")
                found.append(Check(layer, table, name, dimension, severity, m["frame"] or full, m["kind"], m["text"], int(m["percent"] or 100)))
    if len({(x.layer, x.table, x.name) for x in found}) < len(found):
        raise ValueError("two checks of a table share a name")
    return found


def checks(channels: Sequence[str] = CHANNELS, order_number: str = ORDER_NUMBER) -> list[Check]:
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    return parse(CATALOGUE, statuses=quoted(STATUSES), channels=quoted(channels), order_number=order_number, email=c.EMAIL, postal_code=c.POSTAL_CODE)


def reference(text: str) -> tuple[str, str, str]:
    """(column, other table, its column) of a condition `column IN table` or `column IN table BY its_column`."""
    column, _, rest = text.partition(" IN ")
    parent, _, key = rest.partition(" BY ")
    return column, parent, key or column


def on_spark(text: str, now: dt.datetime) -> Column:
    """A condition as a Spark column. Days are the shop's business days."""
    instant = f"TIMESTAMP_NTZ '{now.isoformat(' ')}'"
    today = f"to_date(convert_timezone('UTC', '{c.BUSINESS_ZONE}', {instant}))"
    text = re.sub(r"age_minutes\(((?:[^()]|\([^()]*\))+)\)", rf"round(timestampdiff(SECOND, \1, {instant}) / 60, 1)", text)
    return F.expr(re.sub(r"age_days\(((?:[^()]|\([^()]*\))+)\)", rf"datediff({today}, \1)", text).replace("\\", "\\\\"))


def _evaluable(df: DataFrame, column: Column) -> bool:
    try:
        return bool(df.select(column).schema)
    except AnalysisException:
        return False


def _key_counts(df: DataFrame, text: str) -> tuple[int, int]:
    """(rows with a key, rows that share theirs)."""
    names, _, where = text.partition(" WHERE ")
    keys = names.split(", ")
    of = (df.where(where) if where else df).where(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull())
    copies = of.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    r = copies.agg(F.sum("_copies").alias("of"), F.sum(F.when(F.col("_copies") > 1, F.col("_copies"))).alias("bad")).first()
    return r["of"] or 0, r["bad"] or 0


def _reference_counts(df: DataFrame, text: str, frames: Mapping[str, Callable[[], DataFrame]]) -> dict:
    """bad, the rows whose key is not found, and samples of such keys. Rows are counted by key before keys meet what they refer to, so no shuffle
    has more of a row than its key."""
    column, parent, key = reference(text)
    counted = df.groupBy(column).agg(F.count(F.lit(1)).alias("_rows"))
    known = flagged(counted, frames[parent]().withColumnRenamed(key, column), [column], "_found")
    shown = F.when(~F.col("_found"), F.col(column).cast("string"))
    return known.agg(F.coalesce(F.sum(F.when(~F.col("_found"), F.col("_rows"))), F.lit(0)).alias("bad"), *[v.alias(f"sample{i}") for i, v in sample_of(shown).items()]).first().asDict()


@dataclass
class Found:
    """What a check saw; of none, it could not be evaluated."""

    elements: int | None = None
    concerned: int = 0
    unexpected: int | None = None
    observed: float | None = None
    sample: str | None = None
    columns: str | None = None


def sample_of(shown: Column) -> dict[int, Column]:
    """For each class, the value with the least hash among those shown."""
    hashed = F.md5(shown)
    return {i: F.min(F.when(F.ascii(hashed) % SAMPLES == i, F.struct(hashed.alias("h"), shown.alias("v")))).getField("v") for i in range(SAMPLES)}


def shown_name(text: str) -> str:
    """The column that a condition on rows is first about."""
    return next(n for n in re.findall(r"[a-z_]+\b(?!\()", text))


def _with_parents(df: DataFrame, own: Sequence[Check], frames: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """df with whether each `found` check finds its row's key."""
    for k, x in enumerate(own):
        if x.kind == "found":
            column, parent, key = reference(x.text)
            if column in df.columns:
                df = flagged(df, frames[parent]().withColumnRenamed(key, column), [column], f"_found{k}")
    return df


def look(df: DataFrame, own: Sequence[Check], frames: Mapping[str, Callable[[], DataFrame]], now: dt.datetime) -> dict[Check, Found]:
    """The checks of one table: rows and measures in one aggregate, keys and references in one more each."""
    aggregates, told = {"n": F.count(F.lit(1))}, []
    named = {x: list(dict.fromkeys(n for n in re.findall(r"\b[a-z_]+\b", x.text) if n in df.columns)) for x in own}
    for k, x in enumerate(own):
        if x.kind == "table":
            value = on_spark(_LIMIT.fullmatch(x.text)["measure"], now).cast("double")
            if _evaluable(df, value):
                aggregates[f"value{k}"] = value
        elif x.kind == "row":
            good = on_spark(x.text, now)
            if _evaluable(df, good):
                shown = F.when(~good, F.col(shown_name(x.text)).cast("string"))
                aggregates |= {f"bad{k}": F.count_if(~good), f"of{k}": F.count(good)} | {f"sample{k}_{i}": v for i, v in sample_of(shown).items()}
        elif x.kind == "found":
            if reference(x.text)[0] in df.columns:
                told.append(x)
        elif set(x.text.partition(" WHERE ")[0].split(", ")) <= set(df.columns):
            told.append(x)
    row = df.agg(*[v.alias(n) for n, v in aggregates.items()]).first().asDict()

    def listed(of: dict, name: str) -> str | None:
        values = [v for i in range(SAMPLES) if (v := of[f"{name}{i}"]) is not None]
        return json.dumps(values, ensure_ascii=False, separators=(",", ":"))[:MOST_CHARACTERS] if values else None

    out = {}
    for k, x in enumerate(own):
        if row.get(f"value{k}") is not None:
            out[x] = Found(observed=row[f"value{k}"])
        elif f"bad{k}" in row:
            out[x] = Found(row["n"], row[f"of{k}"], row[f"bad{k}"], sample=listed(row, f"sample{k}_"))
    for x in told:
        if x.kind == "found":
            seen = _reference_counts(df, x.text, frames)
            out[x] = Found(row["n"], row["n"], seen["bad"], sample=listed(seen, "sample"))
        else:
            out[x] = Found(row["n"], *_key_counts(df, x.text))
    for x, seen in out.items():
        seen.columns = ", ".join(named[x]) or None
    return out


def failing_rows(df: DataFrame, own: Sequence[Check], frames: Mapping[str, Callable[[], DataFrame]], now: dt.datetime) -> DataFrame:
    """(layer, table_name, check_name, shown, record): each row of one table with each check of rows, keys or references that it fails.

    One scan of the table, in which a row gets the array of the checks that it fails; keys that rows share are found by an aggregate each and
    joined. shown has the columns that the check is about, record the whole row as JSON. Checks whose columns are missing find nothing."""
    columns = df.columns
    plain, df, failed = df, _with_parents(df, own, frames), []
    for k, x in enumerate(own):
        if x.kind == "table":
            continue
        names, _, where = x.text.partition(" WHERE ")
        about = names.split(", ") if x.kind == "key" else [shown_name(x.text)]
        if not set(about) <= set(columns):
            continue
        if x.kind == "key":
            of = (plain.where(where) if where else plain).where(F.coalesce(*[F.col(n).cast("string") for n in about]).isNotNull())
            shared = of.groupBy(*about).agg(F.count(F.lit(1)).alias(f"_n{k}")).where(f"_n{k} > 1").select(*[F.col(n).alias(f"_k{k}_{i}") for i, n in enumerate(about)], F.lit(True).alias(f"_shared{k}"))
            same = [F.col(n).eqNullSafe(F.col(f"_k{k}_{i}")) for i, n in enumerate(about)]
            df = df.join(shared, reduce(Column.__and__, same), "left")
            bad = F.col(f"_shared{k}") & (F.expr(where) if where else F.lit(True))
        else:
            good = on_spark(x.text, now) if x.kind == "row" else F.col(f"_found{k}")
            if not _evaluable(df, good):
                continue
            bad = ~good
        shown = F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("null"))) for n in about])
        failed.append(F.when(bad, F.struct(F.lit(x.name).alias("check_name"), shown.alias("shown"))))
    if not failed:
        return df.sparkSession.createDataFrame([], FAILING)
    told = df.select(F.explode(F.array_compact(F.array(*failed))).alias("x"), F.to_json(F.struct(*columns)).alias("record"))
    return told.select(F.lit(own[0].layer).alias("layer"), F.lit(own[0].table).alias("table_name"), "x.check_name", "x.shown", "record")


def judged(x: Check, seen: Found | None) -> tuple[bool, float | None, str | None]:
    """(whether the check holds, percent of rows against it, what was observed)."""
    if seen is None:
        return False, None, "check could not be evaluated"
    if x.kind == "table":
        m = _LIMIT.fullmatch(x.text)
        limit = float(m["limit"])
        return (seen.observed <= limit if m["sign"] == "<=" else seen.observed >= limit), None, f"{seen.observed:.12g}"
    percent = 100.0 * seen.unexpected / seen.concerned if seen.concerned else 0.0
    return seen.unexpected * 100 <= (100 - x.percent) * seen.concerned, percent, None


def run(spark: SparkSession, todo: Sequence[Check], frames: Mapping[str, Callable[[], DataFrame]], run_id: str, at: dt.datetime) -> DataFrame:
    """One row for each check, in order. A check whose columns are missing fails; a table that can't be read gives one failed row in place
    of its checks and stops no other."""
    seen: dict[Check, Found] = {}
    broken: dict[str, str] = {}
    for name in dict.fromkeys(x.frame for x in todo):
        try:
            seen |= look(frames[name](), [x for x in todo if x.frame == name], frames, at)
        except Exception as e:  # noqa: BLE001  a table that can't be read is a finding of its own
            broken[name] = f"{type(e).__name__}: {e}"
    rows, failed = [], set()
    for x in todo:
        if x.frame in broken:
            if (x.layer, x.table) not in failed:
                failed.add((x.layer, x.table))
                rows.append((run_id, at, x.layer, x.table, "suite_ran", "validity", "error", "the table can be read and checked", None, None, False, "failed", None, None, None, broken[x.frame][:MOST_CHARACTERS], None))
            continue
        ok, percent, observed = judged(x, seen.get(x))
        own = seen.get(x) or Found()
        status = "passed" if ok else "failed" if x.severity == "error" else "warning"
        rows.append((run_id, at, x.layer, x.table, x.name, x.dimension, x.severity, x.says, x.expectation, own.columns, ok, status, own.elements, own.unexpected, percent, observed, own.sample))
    return spark.createDataFrame(rows, RESULT)


def search(results: DataFrame, text: str = "", status: str | None = None) -> DataFrame:
    """Results whose table, name, dimension or description holds a text, in any case; of one status only, if that is told."""
    wanted = text.strip().lower()
    told = F.lower(F.concat_ws(" ", F.concat_ws(".", "layer", "table_name"), "check_name", "dimension", "description"))
    found = results.where(F.contains(told, F.lit(wanted))) if wanted else results
    return found if status is None else found.where(F.col("status") == status)


def reject_rates(received: DataFrame, rejects: DataFrame) -> DataFrame:
    """(source, received, rejected, reject_rate_pct): one grouped count for each side, joined."""
    r = rejects.groupBy("source").agg(F.count(F.lit(1)).alias("rejected"))
    joined = received.groupBy("source").agg(F.count(F.lit(1)).alias("received")).join(r, "source", "left").withColumn("rejected", F.coalesce("rejected", F.lit(0)))
    return joined.withColumn("reject_rate_pct", F.round(F.coalesce(c.ratio(100 * F.col("rejected"), F.col("received")), F.lit(0.0)), 4))
