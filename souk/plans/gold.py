"""Silver to gold: business rows with exact amounts and business days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions import columns as c
from souk.operators.lifecycle import REACHED


def order_lines(silver: DataFrame) -> DataFrame:
    """Order lines with their amounts."""
    return silver.withColumns(c.line_amounts()).select("order_id", "line_number", "source", "product_id", "quantity", "unit_price", "discount_pct", "gross_amount", "discount_amount", "net_amount")


def orders(silver: DataFrame) -> DataFrame:
    """Lines folded into orders. Silver repeats an order's facts on its lines; the greatest value is taken, which ignores nulls."""
    facts = ("source", "channel", "customer_id", "order_ts", "status", "status_ts", *(f"{s}_at" for s in REACHED), "payment_method", "shipping_city", "shipping_postal_code", "shipping_fee", "source_total_amount")
    amounts = ("gross_amount", "discount_amount", "net_amount")
    folded = silver.withColumns(c.line_amounts()).groupBy("order_id").agg(
        *[F.max(x).alias(x) for x in facts], F.count(F.lit(1)).cast("int").alias("lines_count"), F.sum("quantity").cast("int").alias("units"), *[F.sum(x).cast(c.MONEY).alias(x) for x in amounts]
    )
    fee = F.coalesce("shipping_fee", F.lit(0)).cast("decimal(10,2)")
    return folded.select(
        "order_id", "source", "channel", "customer_id", "order_ts", c.business_day("order_ts").alias("order_date"), "status", "status_ts", F.col("cancelled_at").isNotNull().alias("is_cancelled"), F.col("returned_at").isNotNull().alias("is_returned"),
        *[f"{s}_at" for s in REACHED], "payment_method", "shipping_city", "shipping_postal_code", "lines_count", "units", *amounts, fee.alias("shipping_fee"), (F.col("net_amount") + fee).cast(c.MONEY).alias("total_amount"), "source_total_amount",
    )


#: The columns of current records, each with what it is made of.
CUSTOMERS = dict.fromkeys("customer_id first_name last_name email phone city postal_code country".split()) | {"signup_ts": "created_at", "signup_date": None, "updated_at": None}
PRODUCTS = dict.fromkeys("product_id name category brand unit_price currency is_active created_at updated_at".split())


def _current(versions: DataFrame, columns: dict[str, str | None], **made: Column) -> DataFrame:
    return versions.where("is_current").select(*[made.get(name, F.col(of or name)).alias(name) for name, of in columns.items()])


def customers(versions: DataFrame) -> DataFrame:
    """The current version of each customer."""
    return _current(versions, CUSTOMERS, signup_date=c.business_day("created_at"))


def products(versions: DataFrame) -> DataFrame:
    """The current version of each product; a missing category or brand is Unknown."""
    return _current(versions, PRODUCTS, **{x: F.coalesce(x, F.lit(c.UNKNOWN)) for x in ("category", "brand")})
