"""Sources as queries: all rows arrive."""

import datetime as dt
from collections import Counter

import duckdb

from souk.queries import storage
from souk.queries.base import ORACLES, QUERIES, Shop


def oracle(name, sf):
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return Counter(con.execute(ORACLES[name]).fetchall())


def test_whole_export_is_loaded(spark):
    sf = "/root/testdata/sf0.001"
    rows = {n: Counter(map(tuple, QUERIES[n](spark, sf).collect())) for n in ("csv_ingest", "csv_lineage", "missing_days")}
    for n, found in rows.items():
        assert found == oracle(n, sf), n
    assert sum(rows["csv_ingest"].values()) == sum(n * k for (*_, n), k in rows["csv_lineage"].items()) == Shop(spark, sf).bronze_export.count()


def test_a_range_of_days_is_loaded_alone(spark):
    shop, first, last = Shop(spark, "/root/testdata/sf0.001"), dt.date(1997, 3, 1), dt.date(1997, 3, 31)
    count = lambda df: Counter(map(tuple, df.collect()))
    whole, month = count(storage._loaded(shop)), count(storage._loaded(shop, first, last))
    assert month == Counter({r: n for r, n in whole.items() if first <= r[1] <= last})
    assert 0 < sum(month.values()) < sum(whole.values())
