"""The driver's tables in the shapes that the engine takes. Plain arithmetic on keys injects each class of defect; no key is left out:
unknown customers and products are references that facts make to keys of no table.

Texts in SHARED are read by Spark and by DuckDB alike, so a query and its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SHARED: dict[str, str] = {
    # an order in the shop, with what its key says about it
    "shop_orders": """
      SELECT CAST(o_orderkey AS STRING) AS order_id, o_orderkey AS order_no, o_orderpriority AS channel,
        CASE WHEN o_orderpriority >= '4' THEN 'marketplace' ELSE 'web_shop' END AS source,
        CASE WHEN o_orderkey % 333 = 0 THEN NULL WHEN o_custkey % 50 = 0 THEN 'C' || CAST(o_custkey AS STRING) || '-unlisted' ELSE 'C' || CAST(o_custkey AS STRING) END AS customer_id, o_orderstatus AS mark,
        o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS order_ts,
        CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'card' WHEN 1 THEN 'paypal' WHEN 2 THEN 'apple_pay' WHEN 3 THEN 'installments' ELSE NULL END AS payment_method,
        'City ' || CAST(o_custkey % 20 AS STRING) AS shipping_city, lpad(CAST(o_custkey % 950 * 100 AS STRING), 5, '0') AS shipping_postal_code,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 5 AS DECIMAL(10,2)) END AS shipping_fee,
        CASE WHEN o_orderpriority >= '4' THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END AS source_total_amount FROM orders""",
    # the latest of the rows that share a line
    "shop_lines": """
      SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS place FROM lineitem l) t WHERE place = 1""",
    "shop_shipping": """
      SELECT l_orderkey AS order_no, min(CASE WHEN l_shipdate >= order_ts THEN l_shipdate END) AS shipped_at, max(l_shipdate) AS last_at,
        max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS has_return FROM shop_lines JOIN shop_orders ON l_orderkey = order_no GROUP BY l_orderkey""",
    "shop_states": """
      SELECT o.*, CASE WHEN o.order_no % 11 = 0 THEN NULL ELSE order_ts + INTERVAL '1' HOUR END AS paid_at, s.shipped_at,
        CASE WHEN mark = 'F' THEN last_at END AS delivered_at, CASE WHEN mark = 'P' THEN order_ts + INTERVAL '2' HOUR END AS cancelled_at,
        CASE WHEN mark = 'F' AND has_return = 1 AND o.order_no % 3 = 0 THEN last_at + INTERVAL '3' DAY END AS returned_at
      FROM shop_orders o JOIN shop_shipping s ON o.order_no = s.order_no""",
    # the layout that both sources share in silver
    "silver_lines": """
      SELECT order_id, l_linenumber AS line_number, source, channel, customer_id, order_ts,
        CASE WHEN returned_at IS NOT NULL THEN 'returned' WHEN cancelled_at IS NOT NULL THEN 'cancelled' WHEN delivered_at IS NOT NULL THEN 'delivered'
          WHEN shipped_at IS NOT NULL THEN 'shipped' WHEN paid_at IS NOT NULL THEN 'paid' ELSE 'created' END AS status,
        coalesce(returned_at, cancelled_at, delivered_at, shipped_at, paid_at, order_ts) AS status_ts, paid_at, shipped_at, delivered_at, cancelled_at, returned_at,
        payment_method, shipping_city, shipping_postal_code, shipping_fee, source_total_amount, 'P' || CAST(l_partkey AS STRING) || CASE WHEN l_partkey % 50 = 0 THEN '-unlisted' ELSE '' END AS product_id, CAST(l_quantity AS INT) AS quantity,
        CAST(l_extendedprice AS DECIMAL(10,2)) AS unit_price, CAST(round(l_discount * 100) AS INT) AS discount_pct
      FROM shop_lines JOIN shop_states ON l_orderkey = order_no""",
    "holidays": """
      SELECT CAST(d AS DATE) AS holiday_date, n AS holiday_name FROM (VALUES ('1995-05-01', 'Labour Day'), ('1996-05-01', 'Labour Day'), ('1997-05-01', 'Labour Day'),
        ('1998-05-01', 'Labour Day'), ('1995-12-25', 'Christmas'), ('1996-12-25', 'Christmas'), ('1997-12-25', 'Christmas'), ('1998-12-25', 'Christmas'),
        ('1999-12-25', 'Christmas'), ('2000-01-01', 'New Year'), ('2001-07-14', 'National Day')) AS t(d, n)""",
    "sales_windows": """
      SELECT n AS event_name, CAST(a AS DATE) AS start_date, CAST(b AS DATE) AS end_date FROM (VALUES ('Winter sales', '1995-01-10', '1995-02-06'), ('Summer sales', '1996-06-26', '1996-07-23'),
        ('Black Friday', '1997-11-28', '1997-11-30'), ('Winter sales', '1998-01-07', '1998-02-03'), ('Summer sales', '2000-06-28', '2000-07-25')) AS t(n, a, b)""",
    # versions of customers as the API gives them: text, with blanks, bad values, and versions fetched twice
    "bronze_customers": """
      SELECT CASE WHEN o_orderkey % 401 = 0 THEN '  ' ELSE ' C' || CAST(o_custkey AS STRING) || ' ' END AS customer_id, 'First' || CAST(o_custkey % 13 AS STRING) AS first_name,
        CASE WHEN o_custkey % 17 = 0 THEN '' ELSE 'Last' || CAST(o_custkey % 29 AS STRING) END AS last_name,
        CASE WHEN o_orderkey % 11 = 0 THEN 'not an address' ELSE ' User' || CAST(o_custkey AS STRING) || '@Example.COM' END AS email, '+33' || CAST(o_custkey AS STRING) AS phone,
        'City ' || CAST(o_orderkey % 20 AS STRING) AS city, CASE WHEN o_orderkey % 13 = 0 THEN '7501' ELSE lpad(CAST(o_custkey % 950 * 100 AS STRING), 5, '0') END AS postal_code, 'FR' AS country,
        CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(CAST('1994-01-01 10:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' DAY * CAST(o_custkey % 300 AS INT) AS STRING) END AS created_at,
        CASE WHEN o_orderkey % 97 = 0 THEN 'yesterday' ELSE CAST(o_orderdate AS STRING) END AS updated_at, o_orderkey AS _ingested_at, CAST(o_orderkey AS STRING) AS _raw, 'api' AS _source_file
      FROM orders""",
    "bronze_products": """
      SELECT 'P' || CAST(p_partkey AS STRING) AS product_id, p_name AS name, CASE WHEN p_partkey % 25 = 0 THEN ' ' ELSE p_type END AS category, p_brand AS brand,
        CASE WHEN p_partkey % 90 = 0 THEN '0' ELSE CAST(CAST(p_retailprice + v AS DECIMAL(10,2)) AS STRING) END AS unit_price, 'EUR' AS currency,
        CASE WHEN v = 1 AND p_partkey % 10 = 3 THEN ' False' ELSE 'TRUE' END AS is_active, CAST(CAST('1994-12-01 00:00:00' AS TIMESTAMP_NTZ) + INTERVAL '1' DAY * CAST(p_partkey % 500 AS INT) AS STRING) AS created_at,
        CASE WHEN v = 0 THEN '1995-01-01 00:00:00' WHEN p_partkey % 89 = 0 THEN '' ELSE '1998-06-01 12:00:00' END AS updated_at, v AS _ingested_at, p_name AS _raw, 'api' AS _source_file
      FROM part CROSS JOIN (VALUES (0), (1)) AS versions(v) WHERE v = 0 OR p_partkey % 4 = 3""",
    "catalogue": "SELECT 'P' || CAST(p_partkey AS STRING) AS product_id FROM part",
    # what each event stands for, before it is written as a message
    "event_facts": """
      SELECT event_id, CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS order_id, ts AS event_ts,
        CASE WHEN event_id % 83 = 0 THEN 'order_viewed' WHEN event_type = 'signup' THEN 'order_created' ELSE 'order_status_changed' END AS kind,
        CASE WHEN event_id % 71 = 0 THEN 'lost' ELSE CASE event_type WHEN 'view' THEN 'paid' WHEN 'click' THEN 'shipped' WHEN 'purchase' THEN 'delivered' WHEN 'error' THEN 'cancelled' END END AS status,
        event_type = 'signup' AS creates, CASE WHEN event_id % 333 = 0 THEN NULL ELSE 'C' || CAST(user_id AS STRING) END AS customer_id, CAST(value AS DECIMAL(10,2)) AS price,
        event_id % 97 = 0 AS truncated, event_id % 89 = 0 AS nameless, event_id % 79 = 0 AS undated, event_id % 61 = 0 AS empty, event_id % 100 = 7 AS twice,
        CAST(event_id % 7 AS INT) AS quantity, CAST(event_id % 120 AS INT) AS percent, 'P' || CAST(event_id % 211 AS STRING) AS product_id FROM events""",
    # rows of the marketplace export, before they are written as text
    "export_facts": """
      SELECT 'MKP-' || CAST(l_orderkey AS STRING) AS order_id, o_orderdate + INTERVAL '9' HOUR AS ordered_local, l_shipdate + INTERVAL '12' HOUR AS updated_local, l_linenumber AS line_number,
        CASE WHEN l_orderkey % 41 = 0 THEN 'inconnu' WHEN l_returnflag = 'R' THEN 'Retournée' WHEN l_returnflag = 'A' THEN 'LIVRÉE ' WHEN l_linestatus = 'O' THEN 'expédiée' ELSE 'payée' END AS label,
        CASE WHEN l_suppkey % 10 = 0 THEN '' ELSE 'C' || CAST(o_custkey AS STRING) END AS customer, l_partkey, 'P' || CAST(l_partkey AS STRING) || CASE WHEN l_partkey % 50 = 0 THEN '-unlisted' ELSE '' END AS product_ref, CAST(l_quantity AS INT) AS quantity, CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
        CAST(round(l_discount * 100) AS INT) AS percent, l_partkey % 101 = 0 AS wordy, l_partkey % 103 = 0 AS undated, l_partkey % 107 = 0 AS torn, CAST(l_shipdate AS DATE) AS file_date,
        CAST(l_orderkey % 5 AS DECIMAL(10,2)) AS fee, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority >= '4'""",
    "reject_runs": """
      SELECT 'run-' || CAST(year(o_orderdate) AS STRING) AS run_id, CAST(CAST(year(o_orderdate) AS STRING) || '-12-31 06:00:00' AS TIMESTAMP_NTZ) AS checked_at,
        CASE WHEN o_orderpriority >= '4' THEN 'marketplace_orders' ELSE 'order_events' END AS source, CASE WHEN o_orderstatus = 'P' THEN 'unknown_product' ELSE 'invalid_quantity' END AS reason,
        count(*) AS rejected FROM orders GROUP BY 1, 2, 3, 4""",
}

_NAME = re.compile(r"\b[a-z_]\w*\b")


def closure(sql: str, views: dict[str, str]) -> list[str]:
    """The views that a text needs, each after those that it needs itself."""
    found: list[str] = []
    begun: set[str] = set()

    def visit(text: str) -> None:
        for name in dict.fromkeys(_NAME.findall(text)):
            if name in views and name not in begun:
                begun.add(name)
                visit(views[name])
                found.append(name)

    visit(sql)
    return found


def compose(sql: str, views: dict[str, str]) -> str:
    """A text with the views it needs as common table expressions."""
    needed = closure(sql, views)
    return ("WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in needed) + "\n" if needed else "") + sql


def shared(spark: SparkSession, sf_dir: str, name: str, **dealt: str) -> DataFrame:
    """A view of SHARED over the tables of a folder, on Spark. dealt: the key by which a table is dealt out where it is read, so that all that the
    view groups and joins by the key is one shuffle of the table."""
    hint = {t: f"/*+ REPARTITION({key}) */ " for t, key in dealt.items()}
    files = {t: f"SELECT {hint.get(t, '')}* FROM parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(compose(f"SELECT * FROM {name}", SHARED | files))


def bronze_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of order events (value, topic, partition, offset, kafka_timestamp), with re-deliveries and cut payloads."""
    f = shared(spark, sf_dir, "event_facts")
    record = lambda **fields: F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])
    items = "array<struct<line_number:int,product_id:string,quantity:int,unit_price:decimal(10,2),discount_pct:int>>"
    item = record(line_number=F.lit(1), product_id=F.col("product_id"), quantity=F.col("quantity"), unit_price=F.col("price"), discount_pct=F.col("percent"))
    creates = F.col("creates")
    payload = F.to_json(
        record(
            event_id=F.when(~F.col("nameless"), F.concat(F.lit("E"), F.col("event_id").cast("string"))).otherwise(F.lit(" ")),
            event_type=F.col("kind"),
            event_ts=F.when(F.col("undated"), F.lit("soon")).otherwise(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")),
            schema_version=F.lit(1),
            order_id=F.col("order_id"),
            status=F.when(~creates, F.col("status")),
            customer_id=F.col("customer_id"),
            channel=F.lit("web"),
            payment_method=F.lit("card"),
            currency=F.lit("EUR"),
            shipping=F.when(creates, record(city=F.lit("Nice"), postal_code=F.lit("06000"), fee=F.lit(4.9).cast("decimal(10,2)"))),
            items=F.when(creates, F.when(F.col("empty"), F.array().cast(items)).otherwise(F.array(item))),
            total_amount=F.when(creates, F.col("price")),
        )
    )
    cut = F.when(F.col("truncated"), F.substring(payload, 1, 40)).otherwise(payload)
    deliveries = F.explode(F.when(F.col("twice"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return f.select("event_id", cut.alias("value"), deliveries.alias("_again"), F.col("event_ts").alias("kafka_timestamp")).select(
        "value", F.lit("shop.orders").alias("topic"), (F.col("event_id") % 3).cast("int").alias("partition"), (F.col("event_id") * 2 + F.col("_again")).alias("offset"), "kafka_timestamp"
    )


def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marketplace export as the text of its 14 columns, with its file's date."""
    f = shared(spark, sf_dir, "export_facts")
    comma = lambda x: F.translate(F.col(x).cast("string"), ".", ",")
    return f.select(
        F.col("order_id").alias("numero_commande"),
        F.when(F.col("undated"), F.date_format("ordered_local", "yyyy-MM-dd")).otherwise(F.date_format("ordered_local", "dd/MM/yyyy HH:mm:ss")).alias("date_commande"),
        F.date_format("updated_local", "dd/MM/yyyy HH:mm:ss").alias("date_maj"),
        F.col("label").alias("statut"),
        F.col("customer").alias("id_client"),
        F.col("line_number").cast("string").alias("ligne"),
        F.col("product_ref").alias("ref_produit"),
        F.when(F.col("wordy"), F.lit("deux")).otherwise(F.col("quantity").cast("string")).alias("quantite"),
        comma("price").alias("prix_unitaire"),
        F.col("percent").cast("string").alias("remise_pct"),
        comma("fee").alias("frais_port"),
        F.lit("CB").alias("mode_paiement"),
        F.lit("Nice").alias("ville_livraison"),
        F.lit("06000").alias("code_postal"),
        F.col("file_date"),
        F.col("torn"),
    )


def bronze_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export rows with lineage, as the CSV source reads them; torn rows carry their raw line."""
    rows = export_rows(spark, sf_dir)
    raw = F.when(F.col("torn"), F.concat_ws(";", "numero_commande", "date_commande"))
    return rows.select("*", raw.alias("_corrupt_record"), F.concat(F.lit("marketplace_orders_"), F.col("file_date").cast("string"), F.lit(".csv")).alias("_source_file"), F.col("file_date").alias("_file_date")).drop("file_date", "torn")
