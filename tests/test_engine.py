"""Column factories and operators on hand-made rows, and invariants of the models on the smallest tables."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from souk.functions import columns as c
from souk.operators import history, lifecycle, rows, series
from souk.plans import quality
from souk.queries.base import Shop
from souk.sources import csv_export, shop_api
from souk.sources.lake import Lake, OutsideSlice

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shop(spark):
    return Shop(spark, SF)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tolerant_typing(spark):
    lit = F.lit
    assert one(spark, c.blank_to_null(lit("  "))) is None and one(spark, c.blank_to_null(lit(" a "))) == "a"
    assert one(spark, c.tolerant_money(lit(" 49,90 "))) == Decimal("49.90") and one(spark, c.tolerant_money(lit("gratuit"))) is None
    assert one(spark, c.tolerant_int(lit("deux"))) is None
    assert one(spark, c.local_to_utc(lit("15/01/2026 09:00:00"))) == dt.datetime(2026, 1, 15, 8)
    assert one(spark, c.local_to_utc(lit("15/07/2026 09:00:00"))) == dt.datetime(2026, 7, 15, 7)
    assert one(spark, c.local_to_utc(lit("2026-07-15"))) is None
    assert one(spark, c.labelled(lit(" EXPÉDIÉE "), {"expédiée": "shipped"})) == "shipped" and one(spark, c.labelled(lit("?"), {"a": "b"})) is None
    assert one(spark, c.business_day(lit("2026-07-14 22:30:00").cast("timestamp_ntz"))) == dt.date(2026, 7, 15)
    assert one(spark, c.first_true([(lit(None).cast("boolean"), "null"), (lit(True), "second"), (lit(True), "third")])) == "second"


def test_amounts_round_half_up(spark):
    df = spark.createDataFrame([(1, Decimal("49.90"), 15), (2, Decimal("49.90"), 10)], "quantity int, unit_price decimal(10,2), discount_pct int").withColumns(c.line_amounts())
    assert [(r["gross_amount"], r["discount_amount"], r["net_amount"]) for r in df.collect()] == [(Decimal("49.90"), Decimal("7.48"), Decimal("42.42")), (Decimal("99.80"), Decimal("9.98"), Decimal("89.82"))]


def test_validity_periods_and_lookup(spark):
    d = lambda n: dt.datetime(2026, 1, n)
    versions = spark.createDataFrame([("a", d(5), d(2), 1), ("a", d(9), d(2), 2), ("a", d(9), d(2), 3)], "k string, changed timestamp_ntz, created timestamp_ntz, at int")
    periods = history.validity_periods(versions, "k", "changed", "created", [F.col("at").desc()])
    assert sorted((r["valid_from"], r["valid_to"], r["is_current"], r["at"]) for r in periods.collect()) == [(d(2), d(9), False, 1), (d(9), None, True, 3)]
    facts = spark.createDataFrame([("a", d(1)), ("a", d(8)), ("a", d(9)), ("b", d(9))], "f string, t timestamp_ntz")
    assert sorted((r["t"], r["at"] or 0) for r in history.as_of(facts, "t", "f", periods, "k", ["at"]).collect()) == [(d(1), 0), (d(8), 1), (d(9), 0), (d(9), 3)]


@pytest.mark.parametrize("bucket_days", [1, 30, 4000])
def test_lookup_equals_a_range_join(spark, bucket_days):
    """Many facts of a key, facts at the very instant of a change, ended histories, null keys and instants."""
    import random

    r, d = random.Random(9), lambda n: dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)
    versions = []
    for k in range(6):
        starts = sorted(r.sample(range(2000), r.randint(0, 9)))
        ends = [*starts[1:], None if k % 2 else 2100][: len(starts)]
        versions += [(f"k{k}", d(a), None if b is None else d(b), f"v{k}-{a}" if a % 5 else None) for a, b in zip(starts, ends, strict=True)]
    instants = [x for _, a, b, _ in versions for x in (a, b) if x] + [d(r.randrange(-50, 2300)) for _ in range(300)]
    facts = [(i, r.choice(["k0", "k1", "k2", "k3", "k4", "k5", "k9", None]), r.choice([*instants, None]) if i % 20 == 0 else r.choice(instants)) for i in range(600)]
    f = spark.createDataFrame(facts, "id int, key string, t timestamp_ntz")
    p = spark.createDataFrame(versions, "k string, valid_from timestamp_ntz, valid_to timestamp_ntz, what string")
    held = (F.col("key") == F.col("k")) & (F.col("t") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("t") < F.col("valid_to")))
    expected = sorted(map(tuple, f.join(p, held, "left").select("id", "key", "t", "what").collect()), key=repr)
    assert sorted(map(tuple, history.as_of(f, "t", "key", p, "k", ["what"], bucket_days).collect()), key=repr) == expected and len(expected) == 600


def test_fold_does_not_depend_on_order(spark):
    d = lambda n: dt.datetime(2026, 1, n)
    changes = [("o", "paid", d(2)), ("o", "shipped", d(4)), ("o", "paid", d(1)), ("o", "delivered", d(4))]
    for order in (changes, changes[::-1]):
        r = lifecycle.fold(spark.createDataFrame(order, "order_id string, status string, event_ts timestamp_ntz")).first()
        assert (r["status"], r["status_ts"], r["paid_at"], r["cancelled_at"]) == ("shipped", d(4), d(1), None)


def test_days(spark):
    days = spark.createDataFrame([(dt.date(2026, 1, x),) for x in (1, 2, 5, 6, 7)], "d date").withColumn("g", F.lit(1))
    assert sorted((r["first_day"].day, r["n_days"]) for r in series.islands(days, ["g"], "d").collect()) == [(1, 2), (5, 3)]
    assert {r["missing_day"].day for r in series.missing_days("2026-01-01", "2026-01-07", days, "d").collect()} == {3, 4}
    assert rows.copies_removed(days.union(days), ["d"]).first()["removed"] == 5


def test_lake(spark, tmp_path):
    lake, df = Lake(spark, str(tmp_path)), spark.range(5).withColumn("p", F.col("id") % 2)
    assert not lake.exists("t")
    lake.append(df, "t", "p")
    lake.append(df.where("id = 4"), "t", "p")
    assert lake.exists("t") and lake.slices("t") == ["0", "1"] and lake.read("t").columns == ["id", "p"]
    with pytest.raises(OutsideSlice):
        lake.replace_where(df, "t", "p", F.col("p") == 1)
    assert lake.read("t").count() == 6
    for _ in range(2):
        lake.replace_where(df.where("id = 1"), "t", "p", F.col("p") == 1)
    assert sorted(r["id"] for r in lake.read("t").collect()) == [0, 1, 2, 4, 4]
    lake.replace_where(df.where("false"), "t", "p", F.col("p") < 1)
    assert [r["id"] for r in lake.read("t").collect()] == [1] and lake.slices("t") == ["1"]
    with pytest.raises(TypeError):
        lake.publish({"u": df, "v": df.withColumn("a", F.array("id"))})
    assert not lake.exists("u")


def test_publication_is_written_aside_first(spark, tmp_path):
    """A table may be made from itself; one that cannot be written leaves all as they were."""
    lake, df = Lake(spark, str(tmp_path)), spark.range(3)
    lake.publish({"a/t": df, "b": df})
    lake.overwrite(lake.read("a/t").where("id > 0"), "a/t")
    assert lake.read("a/t").count() == 2
    with pytest.raises(Exception):
        lake.publish({"a/t": df, "b": df.select(F.raise_error(F.lit("broken")).cast("string").alias("x"))})
    assert lake.read("a/t").count() == 2 and lake.read("b").count() == 3 and [n for n in lake.files.names(str(tmp_path)) if n.startswith("_")] == []
    lake.publish({"b": df.where("false")})
    assert lake.exists("b") and lake.read("b").count() == 0


def test_slices_are_replaced_one_by_one(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    day = lambda d, n: spark.createDataFrame([(dt.date(2026, 1, d), n)], "day date, n int")
    files = lambda d: sorted(p.name for p in (tmp_path / f"t/_slice=2026-01-{d:02d}").glob("*.parquet"))
    lake.append(day(1, 0).union(day(9, 0)), "t", "day")
    lake.replace_slices(day(2, 1).union(day(3, 1)), "t", "day")
    untouched = files(2), files(9)
    for _ in range(2):
        lake.replace_slices(day(3, 2), "t", "day")
    lake.replace_slices(day(1, 5), "t", "day")
    assert sorted((r["day"].day, r["n"]) for r in lake.read("t").collect()) == [(1, 5), (2, 1), (3, 2), (9, 0)] and lake.read("t").columns == ["day", "n"]
    with pytest.raises(OutsideSlice):
        lake.replace_slices(day(4, 1).union(day(4, 1).withColumn("day", F.lit(None).cast("date"))), "t", "day")
    assert (files(2), files(9)) == untouched and lake.slices("t") == ["2026-01-01", "2026-01-02", "2026-01-03", "2026-01-09"]
    lake.replace_slices(day(1, 7), "t", "day", ["2026-01-01", "2026-01-02"])
    assert sorted((r["day"].day, r["n"]) for r in lake.read("t").collect()) == [(1, 7), (3, 2), (9, 0)]


def test_a_file_appears_whole_and_once(spark, tmp_path):
    files = Lake(spark, str(tmp_path)).files
    files.create(f"{tmp_path}/x", "first")
    with pytest.raises(FileExistsError):
        files.create(f"{tmp_path}/x", "second")
    assert files.read(f"{tmp_path}/x") == "first" and files.names(str(tmp_path)) == ["x"]


def test_export_header_and_days(spark, tmp_path):
    from souk.plans.cleaning import EXPORT_COLUMNS

    (tmp_path / "marketplace_orders_2026-01-02.csv").write_text(";".join(EXPORT_COLUMNS) + "\n" + ";".join(["x"] * 14) + "\nshort;row\n")
    (tmp_path / "notes.txt").write_text("no")
    lake = Lake(spark, str(tmp_path / "lake"))
    with pytest.raises(csv_export.MissingFiles):
        csv_export.load(spark, lake, str(tmp_path), dt.date(2026, 1, 1), dt.date(2026, 1, 2), "r")
    for _ in range(2):
        assert csv_export.load(spark, lake, str(tmp_path), dt.date(2026, 1, 1), dt.date(2026, 1, 2), "r", skip_missing=True) == 1
    got = lake.read("bronze/marketplace_orders").collect()
    assert len(got) == 2 and {r["_corrupt_record"] for r in got} == {None, "short;row"} and got[0]["_file_date"] == dt.date(2026, 1, 2)
    bad = tmp_path / "bad.csv"
    bad.write_text("a;b\n1;2\n")
    with pytest.raises(Exception):
        csv_export.read(spark, [str(bad)]).collect()


def page(items, more):
    import json

    return 200, {}, json.dumps({"data": items, "pagination": {"page": 1, "page_size": 500, "total": 9, "total_pages": 2, "has_next": more}})


def test_api_client_retries():
    answers = [(503, {}, ""), (429, {"Retry-After": "7"}, ""), (503, {"Retry-After": "Wed, 21 Oct"}, ""), page([{"a": 1}], True)]
    waits = []
    client = shop_api.ApiClient("http://x/", get=lambda url: answers.pop(0), sleep=waits.append)
    assert client.page("customers", 1, None)["data"] == [{"a": 1}] and waits[1] == 7.0 and 0.375 <= waits[0] <= 0.625 and 1.5 <= waits[2] <= 2.5
    with pytest.raises(shop_api.ApiError):
        shop_api.ApiClient("http://x", get=lambda url: (404, {}, "")).page("customers", 1, None)
    tries = []
    with pytest.raises(shop_api.ApiError):
        shop_api.ApiClient("http://x", get=lambda url: tries.append(url) or (503, {}, ""), sleep=lambda _: None).page("products", 4, "2026-01-01")
    assert len(tries) == 6 and tries[0] == "http://x/products?page=4&page_size=500&updated_since=2026-01-01"
    assert shop_api.http_get("http://127.0.0.1:9/nothing", 1)[0] == 503


def test_quality_rules(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", None)], "k string, v int")
    todo = quality.parse("""
x.t
  k_not_null        completeness  error    row: k IS NOT NULL
  v_not_null        completeness  error    75% row: v IS NOT NULL
  k_unique          uniqueness    error    key: k
  v_in_range        validity      warning  row: v BETWEEN 1 AND 2
  k_known_value     validity      error    row: k IN ('a')
  absent_not_null   completeness  error    row: absent IS NOT NULL
  has_rows          volume        error    table: count(*) >= 1
  k_related         consistency   error    found: k IN x.p BY name
  one_each          uniqueness    error    key: k WHERE v > 1
x.u
  has_rows          volume        error    table: count(*) >= 1
  v_not_null        completeness  error    row: v IS NOT NULL
""")

    def broken():
        raise ValueError("no table")

    parents = spark.createDataFrame([("a",)], "name string")
    rows = quality.run(spark, todo, {"x.t": lambda: df, "x.u": broken, "x.p": lambda: parents}, "r", dt.datetime(2026, 1, 1)).collect()
    found = {r["check_name"]: r for r in rows}
    assert {n: (r["status"], r["unexpected_count"]) for n, r in found.items()} == {
        "k_not_null": ("failed", 1), "v_not_null": ("passed", 1), "k_unique": ("failed", 2), "v_in_range": ("warning", 1), "k_known_value": ("failed", 1), "absent_not_null": ("failed", None), "has_rows": ("passed", None), "k_related": ("failed", 2), "one_each": ("passed", 0), "suite_ran": ("failed", None)
    }
    assert len(rows) == 10 and found["v_in_range"]["sample"] == '["3"]' and found["v_in_range"]["column_name"] == "v" and found["v_not_null"]["unexpected_percent"] == 25.0 and found["has_rows"]["observed_value"] == "4"
    for bad in ("x.t\n  a  b  error  row: k\n  a  b  error  row: v", "x.t\n  a  b  error  what: k"):
        with pytest.raises(ValueError):
            quality.parse(bad)


def test_rejects_and_lines_add_up(shop):
    events, bad, again = shop.clean_events
    assert events.count() + bad.count() + again.count() == shop.bronze_events.count()


def test_mart_totals_are_the_facts(shop):
    a = shop.mart_daily.agg(F.sum("net_sales").alias("n"), F.sum("units_sold").alias("u")).first()
    b = shop.fct_sales.agg(F.sum("net_sales_amount").alias("n"), F.sum("units_sold").alias("u")).first()
    assert (a["n"], a["u"]) == (b["n"], b["u"])


def test_catalogues_hold_88_checks_and_73_tests():
    from souk.plans import warehouse

    assert len(quality.checks()) == 88 and len(warehouse.tests()) == 73


def test_rows_are_numbered_over_ranges(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS v").repartition(7)
    assert {r["v"]: r["i"] for r in rows.numbered(df, ["v"], "i").collect()} == {v: v for v in range(1000)}


def test_the_document_is_json(spark):
    import json

    from souk.plans import dashboard
    from souk.registry import QUERIES

    found = QUERIES["dashboard_json"](spark, SF)
    document = json.loads("".join(dashboard.lines(found, "2026-01-01T00:00:00Z")))
    assert set(document) >= {"generated_at", "channels", "categories", "products", "statuses", "payments", "columns", "sales", "sales_orders", "product_sales", "orders", "events", "customers", "quality"}
    assert set(document["customers"]) == {"segments", "departments", "recency", "top"} and set(document["quality"]) == {"run_id", "checked_at", "checks", "rejects"}
    assert all(len(r) == len(document["columns"][n]) for n in dashboard.COLUMNS for r in document[n]) and len(document["quality"]["checks"]) == 88
    assert document["sales"] == sorted(document["sales"], key=lambda r: r[:3]) and max(r[2] for r in document["product_sales"]) < len(document["products"])
    lists = sum(len(x) for n in ("channels", "categories", "products", "statuses", "payments", *dashboard.COLUMNS, "events") for x in [document[n]])
    assert lists + sum(map(len, document["customers"].values())) + 88 + len(document["quality"]["rejects"]) + len(dashboard.SINGLE) == found.count()


def test_texts_of_the_document_are_escaped(spark):
    import json

    from souk.plans import dashboard

    names = ['plain', 'line\nbreak\r\n and\ttab', 'quote " and \\ and / é\u2028', "\x01\x1f", "", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    rows = df.selectExpr(f"{dashboard.record(name=dashboard.text('name'), i=dashboard.number('i'))} AS item").collect()
    assert [json.loads(r["item"]) for r in rows] == [{"name": n, "i": i} for i, n in enumerate(names)]
    lists = dashboard.lists(df.selectExpr("'channels' AS section", f"{dashboard.place('9 - i')} AS sort", f"{dashboard.text('name')} AS item"))
    (one,) = lists.collect()
    assert json.loads(one["items"]) == names[::-1] and one["section"] == "channels"


def test_tables_reach_a_database_in_one_transaction(spark, tmp_path):
    from souk.sources.relational import Database, Unmapped, column_type

    base = Database(spark, f"jdbc:derby:{tmp_path}/db;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, "CLOB")
    orders = spark.createDataFrame([("o1", Decimal("9.50"), dt.datetime(2026, 1, 1, 8), True), (None, None, None, None)], "order_id string, total decimal(12,2), placed_at timestamp, late boolean")
    read = lambda t: spark.read.jdbc(base.url, t, properties=base.properties)
    assert base.publish({"lake.orders": orders, "lake.days": spark.sql("SELECT DATE '2026-01-01' AS d")}) == {"lake.orders": "created", "lake.days": "created"}
    assert base.publish({"lake.orders": orders.limit(1)})["lake.orders"] == "refilled" and read("lake.orders").count() == 1
    assert base.publish({"lake.orders": orders.withColumn("more", F.lit(1))})["lake.orders"] == "recreated"
    got = {r["ORDER_ID"]: r for r in read("lake.orders").collect()}
    assert got["o1"]["TOTAL"] == Decimal("9.50") and got[None]["PLACED_AT"] is None and got["o1"]["MORE"] == 1
    with pytest.raises(Exception):
        with base.transaction() as s:
            s.executeUpdate("DELETE FROM lake.orders")
            raise OSError("lost")
    assert read("lake.orders").count() == 2
    with pytest.raises(Unmapped):
        column_type(spark.sql("SELECT array(1) AS a").schema["a"].dataType)


def test_entry_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 140
