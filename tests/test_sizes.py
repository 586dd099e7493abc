"""What must not grow beyond the input: rows that are made meet no shuffle, and a table's facts are dealt out once."""

from __future__ import annotations

from souk.plans import marts
from souk.queries.base import Shop

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(df) -> int:
    return plan(df).split("== Initial Plan ==")[-1].count("Exchange hashpartitioning")


def test_days_of_products_meet_no_shuffle(spark, monkeypatch):
    """The tree of a plan has what comes last first: no exchange stands before the days are made."""
    s = Shop.of(spark, SMALL)
    monkeypatch.setattr(marts, "DAYS_PER_TASK", 50_000)
    features = marts.demand_features(s.dim_products, s.fct_sales, s.dim_dates)
    assert "Exchange hashpartitioning" not in plan(features).split("Generate")[0]
    assert features.rdd.getNumPartitions() > 4
    days = marts.product_days(s.dim_products, s.fct_sales)
    assert days.rdd.getNumPartitions() > 4
    assert days.count() == features.count()


def test_the_feature_table_makes_what_a_query_asks_for(spark):
    """A sum of units needs no window over the days."""
    assert "Window" not in plan(Shop.of(spark, SMALL).mart_features.groupBy().sum("units_sold"))


def test_tables_are_dealt_out_once(spark):
    """Lines by their order in silver, sales by their product in demand, versions by their record."""
    from souk.operators import history

    s = Shop.of(spark, SMALL)
    one_product = marts.daily_demand(s.fct_sales)
    assert shuffled(one_product) == 1
    versions = spark.createDataFrame([("a", 1, 0, 1)], "k string, at int, made int, n int")
    assert shuffled(history.validity_periods(versions, "k", "at", "made", [versions["n"].desc()])) == 1


def test_lines_of_silver_are_dealt_out_by_order(spark, monkeypatch):
    """Copies of a line, what ships an order and the order itself meet where its lines are."""
    made = []
    monkeypatch.setattr("souk.queries.base.stored", lambda df, name: made.append(df) or df)
    Shop(spark, SMALL).silver_lines  # noqa: B018
    assert "l_linenumber" not in "".join(x for x in plan(made[0]).split("\n") if "Exchange hashpartitioning" in x)


def test_keys_are_counted_without_what_rows_refer_to(spark, monkeypatch):
    import datetime as dt

    from souk.plans import quality

    seen = []
    monkeypatch.setattr(quality, "_key_counts", lambda df, text: seen.append(df.columns) or (0, 0))
    child, parent = spark.createDataFrame([(1, 2)], "id int, of int"), spark.createDataFrame([(2,)], "of int")
    own = quality.parse("a.child\n  unique  uniqueness  error  key: id\n  known  consistency  error  found: of IN a.parent")
    found = quality.look(child, own, {"a.parent": lambda: parent}, dt.datetime(2001, 8, 2))
    assert seen == [["id", "of"]] and found[own[1]].unexpected == 0


def test_export_rows_are_dealt_out_by_product_and_by_order(spark, monkeypatch):
    """Copies are looked for among rejects only, and rows meet products without being sorted."""
    from souk.plans import cleaning

    made, s = {}, Shop.of(spark, SMALL)
    monkeypatch.setattr(cleaning, "stored", lambda df, name: made.setdefault(name, df))
    export, catalogue = s.bronze_export, s.catalogue
    lines = cleaning.marketplace_lines(export, catalogue)[0]
    judged = plan(made["judged-export"]).split("== Initial Plan ==")[-1]
    assert "SortMergeJoin" not in judged and "Aggregate" not in judged.replace("HashAggregate(keys=[_ref", "")
    assert shuffled(lines) == shuffled(made["judged-export"]) + 1


def test_copies_of_export_rows_change_nothing(spark):
    from souk.plans import cleaning

    s = Shop.of(spark, SMALL)
    once = cleaning.marketplace_lines(s.bronze_export, s.catalogue)
    twice = cleaning.marketplace_lines(s.bronze_export.unionByName(s.bronze_export), s.catalogue)
    for a, b in zip(once, twice, strict=True):
        a, b = a.drop("rejected_at"), b.drop("rejected_at")
        assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_the_document_reads_the_facts_once(spark, monkeypatch):
    """What its sections share is made once; sales that no product tells are summed over orders."""
    from souk.plans import quality
    from souk.queries import checks, document  # noqa: F401  checks names the results

    monkeypatch.setattr(Shop, "check_results", property(lambda s: s.spark.createDataFrame([], quality.RESULT)))
    Shop.of(spark, SMALL).__dict__.pop("check_results", None)
    read = document._document(Shop.of(spark, SMALL))._jdf.queryExecution().analyzed().toString()
    assert len([x for x in read.split("\n") if "Relation [" in x and "line_number" in x]) == 1


def test_the_store_is_asked_for_buckets_of_orders(spark):
    """A batch of a hundred orders of a bucket reads and writes its state once and sets one timer; so does its end."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from souk.streaming import stateful

    asked, kept = [], {}
    state = SimpleNamespace(get=lambda: asked.append("get") or kept.get("v"), update=lambda v: asked.append("update") or kept.update(v=v), clear=lambda: asked.append("clear") or kept.clear(), exists=lambda: asked.append("exists") or "v" in kept)
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=lambda t: asked.append(f"at {t}"), deleteTimer=lambda t: asked.append("not"))
    p = stateful.OrderStates(10)
    p.init(handle)
    rows = [Row(order_id=f"o{i}", status="paid", us=i * 1000) for i in range(100)]
    assert len(list(p.handleInputRows((0,), iter(rows), None))) == 100 and asked == ["get", "at 10", "update"]
    asked.clear()
    closed = list(p.handleExpiredTimer((0,), SimpleNamespace(getCurrentWatermarkInMs=lambda: 50), SimpleNamespace(getExpiryTimeInMs=lambda: 10)))
    assert sorted(r["order_id"] for r in closed) == sorted(f"o{i}" for i in range(41)) and all(r["closed"] for r in closed) and asked == ["get", "at 51", "update"]


def test_features_are_made_by_stretches_of_days(spark):
    """The summary makes no row for each day, a stretch's features are those of its days, and no list is made twice to ask whether it is empty."""
    from pyspark.sql import functions as F

    from souk.queries import models  # noqa: F401
    from souk.queries.base import QUERIES

    s = Shop.of(spark, SMALL)
    made = plan(QUERIES["demand_features"](spark, SMALL))
    assert "Window [" not in made.split("BroadcastExchange")[0] and made.count("Generate explode") == 1 and "size(transform" not in made
    stretches = marts.demand_stretches(s.dim_products, s.fct_sales)
    days = marts.demand_features(s.dim_products, s.fct_sales, s.dim_dates)
    assert stretches.count() * 3 < days.count() == stretches.agg(F.sum(F.expr("_last - _first + 1"))).first()[0]


def test_the_grain_of_features_is_told_by_stretches(spark):
    """Days that two stretches of a product hold are rows twice and product days once; no row is made for a day."""
    from souk.queries import checks  # noqa: F401
    from souk.queries.base import QUERIES

    rows = [("a", "2000-01-01", 0, 4), ("a", "2000-01-01", 3, 9), ("a", "2000-01-01", 20, 20), ("b", "2000-01-01", 0, 0), ("b", "2000-01-01", 0, 0), ("c", "2000-01-03", 0, 1), ("c", "2000-01-01", 0, 9)]
    stretches = spark.createDataFrame(rows, "product_key string, first_day string, _first int, _last int").selectExpr("product_key", "CAST(first_day AS DATE) AS first_day", "_first", "_last")
    assert tuple(marts.feature_grain(stretches).first()) == (5 + 7 + 1 + 2 + 2 + 10, 11 + 1 + 10)
    for name in ("reconcile_feature_grain", "reconcile_demand_units"):
        assert "sequence(_first" not in plan(QUERIES[name](spark, SMALL))


def test_a_test_asks_only_for_the_tables_that_it_looks_at(spark):
    """Rows that fail tests on orders need no facts of lines and no marts; nothing is asked for before rows are."""
    import datetime as dt

    from souk.plans import warehouse

    asked, orders = [], Shop.of(spark, SMALL).fct_orders
    tables = {n: (lambda n=n: asked.append(n) or orders) for n in ("fct_orders", "fct_sales", "order_lines", "mart_daily_sales", "mart_product_demand_features")}
    failing = warehouse.failing_rows(tables, dt.date(2001, 8, 2))
    assert len(failing) == 10 and not asked
    for name in ("order_steps", "declared_totals", "no_future_order"):
        failing[name]()
    assert set(asked) == {"fct_orders"}


def test_references_are_counted_by_key(spark, monkeypatch):
    """Rows meet no parent: each key does once, with how many rows have it. Null keys are not found."""
    import datetime as dt

    from souk.plans import quality

    met, flagged = [], quality.flagged
    monkeypatch.setattr(quality, "flagged", lambda df, *others: met.append((sorted(df.columns), df.count())) or flagged(df, *others))
    child = spark.createDataFrame([(i, k, "wide") for i, k in enumerate([2, 2, 2, 7, 7, None])], "id int, of int, other string")
    own = quality.parse("a.child\n  unique  uniqueness  error  key: id\n  known  consistency  error  found: of IN a.parent BY at")
    seen = quality.look(child, own, {"a.parent": lambda: spark.createDataFrame([(2,), (3,)], "at int")}, dt.datetime(2001, 8, 2))[own[1]]
    assert met == [(["_rows", "of"], 3)] and (seen.elements, seen.concerned, seen.unexpected, seen.sample) == (6, 6, 3, '["7"]')
