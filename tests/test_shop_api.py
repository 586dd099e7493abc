"""The paginated source: pages dealt out to executors, retries, records that appear meanwhile, and the load of versions."""

import json

import pytest
from pyspark.sql import functions as F

from souk.sources import records, shop_api
from souk.sources.lake import Lake
from tests.shop_server import Shop, serving


def products(n, changed="2026-01-02T00:00:00.000Z"):
    return [{"product_id": f"P{i:04d}", "name": "Thé d'été ", "unit_price": 48.9, "is_active": i % 2 == 0, "brand": None, "more": [i], "created_at": "2025-03-01T00:00:00.000Z", "updated_at": changed} for i in range(n)]


def test_ranges_of_pages():
    assert shop_api.page_ranges(0, 5) == [shop_api.PageRange(1, 1, True)]
    assert shop_api.page_ranges(5, 5) == [shop_api.PageRange(1, 5, True)]
    assert shop_api.page_ranges(11, 5) == [shop_api.PageRange(1, 5, False), shop_api.PageRange(6, 10, False), shop_api.PageRange(11, 11, True)]


def test_every_page_is_read_once_by_the_tasks(spark):
    shop = Shop({"products": products(250)})
    with serving(shop) as url:
        df = shop_api.read(spark, url, "products", page_size=10, pages_per_task=4)
        assert df.columns == [*shop_api.FIELDS["products"], "_raw", "_page"] and {t for _, t in df.dtypes} == {"string", "bigint"}
        rows = df.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r["product_id"] for r in rows) == [p["product_id"] for p in shop.entities["products"]]
    assert sorted(p for _, p, size, _ in shop.calls if size == 10) == list(range(1, 26))
    assert len({r["task"] for r in rows}) == 7 and all(len({r["task"] for r in rows if (r["_page"] - 1) // 4 == k}) == 1 for k in range(7))
    r = rows[0]
    assert (r["unit_price"], r["is_active"], r["brand"], r["name"]) == ("48.9", "true" if json.loads(r["_raw"])["is_active"] else "false", None, "Thé d'été ")
    assert json.loads(r["_raw"])["more"] == [int(r["product_id"][1:])]


def test_pages_are_tried_again_one_by_one(spark):
    shop = Shop({"products": products(30)}, {("products", 2): [(503, {"Retry-After": "0"}), (429, {"Retry-After": "0"}), (500, {})]})
    with serving(shop) as url:
        assert shop_api.read(spark, url, "products", page_size=10, longest_pause=0.01).count() == 30
    assert [p for _, p, size, _ in shop.calls if size == 10] == [1, 2, 2, 2, 2, 3]


def test_a_page_that_stays_broken_fails_the_read(spark):
    shop = Shop({"products": products(30)}, {("products", 3): [(503, {})] * 99})
    with serving(shop) as url, pytest.raises(Exception, match="after 2 tries"):
        shop_api.read(spark, url, "products", page_size=10, tries=2, longest_pause=0.01).count()
    shop = Shop({"products": products(30)}, {("products", 1): [(422, {})] * 99})
    with serving(shop) as url, pytest.raises(Exception, match="422"):
        shop_api.read(spark, url, "products", page_size=10).count()
    assert [p for _, p, size, _ in shop.calls if size == 10] == [1]


def test_records_that_appear_meanwhile_and_an_api_that_counts_nothing(spark):
    shop = Shop({"products": products(25)})
    with serving(shop) as url:
        df = shop_api.read(spark, url, "products", page_size=10)
        df.rdd.getNumPartitions()
        shop.entities["products"] += [p | {"product_id": p["product_id"].replace("P", "Q")} for p in products(12)]
        assert df.count() == 37
    for n in (0, 1, 25):
        with serving(Shop({"products": products(n)}, counts=False)) as url:
            assert shop_api.read(spark, url, "products", page_size=10).count() == n


def test_only_changes_are_asked_for_on_every_page(spark):
    shop = Shop({"customers": [{"customer_id": f"C{i}", "updated_at": f"2026-01-{i % 28 + 1:02d}"} for i in range(100)]})
    with serving(shop) as url:
        got = shop_api.read(spark, url, "customers", "2026-01-20", page_size=10, pages_per_task=1).count()
    assert got == sum(r["updated_at"] >= "2026-01-20" for r in shop.entities["customers"]) and {s for *_, s in shop.calls} == {"2026-01-20"}


def test_versions_are_loaded_once(spark, tmp_path):
    shop, lake = Shop({"products": products(30)}), Lake(spark, str(tmp_path / "lake"))
    load = lambda run, **told: records.load_versions(spark, lake, url, "products", str(tmp_path / "landing"), run, page_size=10, **told)
    with serving(shop) as url:
        assert load("a") == {"fetched": 30, "stored": 30}
        assert load("b") == {"fetched": 30, "stored": 0}  # within the margin of the newest change
        shop.entities["products"] += products(2, "2026-02-01T00:00:00.000Z")
        assert load("c") == {"fetched": 32, "stored": 2}
        assert load("d") == {"fetched": 2, "stored": 0} and shop.calls[-1][3] == "2026-01-31T23:50:00.000Z"
        assert load("e", full=True) == {"fetched": 32, "stored": 0}
        shop.entities["products"] = []
        assert load("f") == {"fetched": 0, "stored": 0} and not (tmp_path / "landing/f").exists()
        shop.failures["products", 1] = [(404, {})] * 9
        with pytest.raises(Exception, match="404"):
            load("g")
    assert sorted(p.name for p in (tmp_path / "landing").iterdir()) == ["a", "b", "c", "d", "e"]
    stored = lake.read("bronze/products")
    assert stored.count() == 32 and {r["_run_id"] for r in stored.select("_run_id").distinct().collect()} == {"a", "c"}
    assert json.loads(stored.first()["_raw"])["more"] is not None and stored.where("name LIKE 'Thé d%'").count() == 32


def test_a_line_that_is_no_json_is_kept(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run/x.txt").write_text('{"customer_id": "C1", "postal_code": "06000", "extra": 1}\n{"customer_id": "C2", "fi\n', encoding="utf-8")
    rows = {r["customer_id"]: r for r in records.read_lines(spark, str(tmp_path / "run"), "customers", "r").collect()}
    assert rows["C1"]["postal_code"] == "06000" and rows[None]["_raw"] == '{"customer_id": "C2", "fi' and rows[None]["_source_file"] == "x.txt"
