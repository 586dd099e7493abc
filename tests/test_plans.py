"""The calendar by rule, the graph of models, the lease, and rows that fail tests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from souk.operators import calendar
from souk.plans import flow, graph, quality, warehouse
from souk.sources.files import Files

D = dt.date


def test_days_that_move(spark):
    years = spark.range(1900, 2100).select(F.col("id").cast("int").alias("year"))
    y = F.col("year")
    found = {r["year"]: r for r in years.select("year", calendar.easter(y).alias("easter"), calendar.winter_sales(y).alias("winter"), calendar.summer_sales(y).alias("summer"), calendar.black_friday(y).alias("black")).collect()}
    known = {1913: D(1913, 3, 23), 1943: D(1943, 4, 25), 1954: D(1954, 4, 18), 1981: D(1981, 4, 19), 1997: D(1997, 3, 30), 2000: D(2000, 4, 23), 2008: D(2008, 3, 23), 2011: D(2011, 4, 24), 2026: D(2026, 4, 5), 2027: D(2027, 3, 28), 2038: D(2038, 4, 25), 2076: D(2076, 4, 19)}
    assert {k: found[k]["easter"] for k in known} == known
    for year, r in found.items():
        assert r["easter"].weekday() == 6 and D(year, 3, 22) <= r["easter"] <= D(year, 4, 25)
        assert r["winter"].weekday() == 2 and 6 <= r["winter"].day <= 12 and r["summer"].weekday() == 2 and 22 <= r["summer"].day <= 28
        assert r["black"].weekday() == 4 and 23 <= r["black"].day <= 29
    spans = {(r["event_name"], r["start_date"], r["end_date"]) for r in calendar.sales_events(years.where("year in (2026, 2027)")).collect()}
    assert spans == {("Winter sales", D(2026, 1, 7), D(2026, 2, 3)), ("Winter sales", D(2027, 1, 6), D(2027, 2, 2)), ("Summer sales", D(2026, 6, 24), D(2026, 7, 21)), ("Summer sales", D(2027, 6, 23), D(2027, 7, 20)), ("Black Friday", D(2026, 11, 23), D(2026, 11, 30)), ("Black Friday", D(2027, 11, 22), D(2027, 11, 29))}
    feasts = {r["holiday_date"]: r["holiday_name"] for r in calendar.holidays(years.where("year = 1997")).collect()}
    assert feasts[D(1997, 5, 8)] == "Ascension Day / Victory in Europe Day" and len(feasts) == 10 and feasts[D(1997, 5, 19)] == "Whit Monday"
    assert calendar.years_of(spark.createDataFrame([(D(2025, 11, 1),), (D(2026, 11, 20),)], "d date"), "d").count() == 3
    assert calendar.years_of(spark.createDataFrame([], "d date"), "d").count() == 0


def model(name, *inputs):
    return graph.Model(name, inputs, lambda t: None)


def test_graph_of_models():
    g = graph.Graph([model("d", "b", "c"), model("b", "a"), model("c", "s2", "b"), model("a", "s1"), model("e", "s2")], {"page": ["d"], "report": ["e"]})
    assert g.sources == ("s2", "s1") and g.order.index("a") < g.order.index("b") < g.order.index("c") < g.order.index("d")
    assert g.downstream(["s1"]) == ("a", "b", "c", "d") and set(g.downstream(["s2"])) == {"e", "c", "d"} and g.downstream(["c"]) == ("c", "d")
    assert set(g.upstream(["page"])) == {"s1", "s2", "a", "b", "c", "d"} and g.upstream(["e"]) == ("s2", "e")
    assert g.readers(["s1"]) == ("page",) and g.readers(["s2"]) == ("page", "report")
    assert ("d", "page", "exposure") in g.edges() and ("s1", "a", "model") in g.edges() and len(g.edges()) == 9
    marks = {"s1": "x", "s2": "y"}
    assert g.stale(marks, marks, g.order) == () and g.stale(marks, marks, set(g.order) - {"c"}) == ("c", "d") and set(g.stale(marks, {}, ())) == set(g.order)
    assert set(g.stale(marks | {"s2": "z"}, marks, g.order)) == {"c", "d", "e"}
    for bad in ([model("a", "b"), model("b", "a")], [model("a"), model("a")]):
        with pytest.raises(ValueError):
            graph.Graph(bad)
    with pytest.raises(ValueError):
        graph.Graph([model("a")], {"page": ["b"]})


def test_the_warehouse_is_a_graph():
    g = warehouse.models()
    assert len(g.models) == 11 and set(g.sources) == {"orders", "order_lines", "customers", "products", "public_holidays", "sales_events", "quality_check_results", "quality_reject_history"}
    assert set(g.downstream(["sales_events"])) == {"core/dim_date", "marts/mart_daily_sales", "marts/mart_product_demand_features"}
    assert g.readers(["quality_reject_history"]) == ("sales_dashboard",) and "demand_forecast_training_set" in g.readers(["order_lines"])


def test_fingerprints_tell_rows_not_loads(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    mark = graph.fingerprint(df)
    assert mark == graph.fingerprint(df.orderBy(F.desc("k")).select("v", "k").withColumn("_loaded_at", F.current_timestamp()))
    assert mark not in {graph.fingerprint(x) for x in (df.distinct(), df.where("k = 1"), df.withColumn("v", F.lit("b")), df.withColumn("k", F.col("k").cast("long")))}


def test_a_second_run_is_refused(spark, tmp_path):
    files, now = Files(spark), [1000.0]
    hold = lambda who: flow.lease(files, str(tmp_path / "l"), who, 60, lambda: now[0])
    with hold("a") as first:
        with pytest.raises(flow.Held, match="by a"):
            with hold("b"):
                pass
    with pytest.raises(OSError):
        with hold("c"):
            raise OSError("the run failed")
    with hold("d") as third:
        now[0] += 61  # d hangs: its time is over
        with hold("e") as fourth:
            with pytest.raises(flow.Held, match="by e"):
                with hold("f"):
                    pass
    assert (first, third, fourth) == (1, 3, 4) and len(files.names(str(tmp_path / "l"))) == 4


def test_every_row_that_fails_a_test_is_kept(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), (None, 3, "y"), ("b", None, "y"), ("b", None, None), ("c", 9, None)], "k string, v int, g string")
    parents = spark.createDataFrame([("a",), ("b",)], "name string")
    todo = quality.parse("""
x.t
  k_not_null   completeness  error    row: k IS NOT NULL
  v_usual      validity      error    90% row: v BETWEEN 1 AND 2
  k_unique     uniqueness    error    key: k WHERE v > 0
  pair_unique  uniqueness    error    key: k, v
  k_related    consistency   error    found: k IN x.p BY name
  has_rows     volume        error    table: count(*) >= 1
  none_such    validity      error    row: absent > 0
""")
    got = sorted((r["check_name"], r["shown"]) for r in quality.failing_rows(df, todo, {"x.p": lambda: parents}, dt.datetime(2026, 1, 1)).collect())
    assert got == sorted([("k_not_null", "k=null"), ("v_usual", "v=3"), ("v_usual", "v=9"), ("k_unique", "k=a"), ("k_unique", "k=a"), ("pair_unique", "k=b, v=null"), ("pair_unique", "k=b, v=null"), ("k_related", "k=null"), ("k_related", "k=c")])
    rows = warehouse.quarantine(todo, {"x.t": lambda: df, "x.p": lambda: parents}, dt.datetime(2026, 1, 1)).where("failed_test = 'x.t.v_usual'").collect()
    assert sorted(r["record"] for r in rows) == ['{"k":"c","v":9}', '{"v":3,"g":"y"}']


def test_samples_are_bounded_and_do_not_depend_on_order(spark):
    df = spark.range(5000).selectExpr("concat('bad', id) AS v")
    todo = quality.parse("x.t\n  v_known  validity  error  row: v IN ('good')")
    run = lambda d: quality.run(spark, todo, {"x.t": lambda: d}, "r", dt.datetime(2026, 1, 1)).first()
    one, two = run(df), run(df.repartition(7).orderBy(F.desc("v")))
    assert one["sample"] == two["sample"] and one["sample"].count('"bad') == quality.SAMPLES and one["unexpected_count"] == 5000


def test_checks_are_searched(spark):
    rows = [("gold", "orders", "id_not_null", "completeness", "each row has an ID", "passed"), ("gold", "lines", "amount", "validity", "100% of rows", "failed"), ("silver", "orders", "id_unique", "uniqueness", "no two rows share an id", "failed")]
    df = spark.createDataFrame(rows, "layer string, table_name string, check_name string, dimension string, description string, status string")
    found = lambda *told: sorted(r["check_name"] for r in quality.search(df, *told).collect())
    assert found() == ["amount", "id_not_null", "id_unique"] and found(" AN ID ") == ["id_not_null", "id_unique"] and found("gold.orders") == ["id_not_null"]
    assert found("id", "failed") == ["amount", "id_unique"] and found("100%") == ["amount"] and found("_", "passed") == ["id_not_null"] and found("%%") == []
