"""What each table of the lake holds: rows, and some facts of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The facts of each table, as SQL aggregates.
FACTS = {
    "bronze/customers": {"distinct customers": "count(DISTINCT customer_id)", "newest updated_at": "max(updated_at)", "last ingested at": "max(_ingested_at)"},
    "bronze/products": {"distinct products": "count(DISTINCT product_id)", "newest updated_at": "max(updated_at)", "last ingested at": "max(_ingested_at)"},
    "bronze/marketplace_orders": {"files": "count(DISTINCT _source_file)", "first day": "min(_file_date)", "last day": "max(_file_date)", "last ingested at": "max(_ingested_at)"},
    "bronze/order_events": {"partitions": "count(DISTINCT partition)", "newest kafka_timestamp": "max(kafka_timestamp)", "last ingested at": "max(_ingested_at)"},
    "silver/customers": {"current customers": "count_if(is_current)"},
    "silver/products": {"current products": "count_if(is_current)"},
    "silver/order_events": {"newest event_ts": "max(event_ts)"},
    "silver/web_order_lines": {"orders": "count(DISTINCT order_id)"},
    "silver/marketplace_order_lines": {"orders": "count(DISTINCT order_id)"},
    "silver/rejects": {"distinct reasons": "count(DISTINCT reason)"},
    "gold/orders": {"first order date": "min(order_date)", "last order date": "max(order_date)", "total amount": "sum(total_amount)"},
    "gold/order_lines": {"units sold": "sum(quantity)"},
    "quality/check_results": {"runs": "count(DISTINCT run_id)", "last run": "max(checked_at)", "failed checks, all runs": "count_if(status = 'failed')", "warnings, all runs": "count_if(status = 'warning')"},
    "quality/reject_history": {"runs": "count(DISTINCT run_id)"},
}


def facts(df: DataFrame, name: str) -> dict[str, object]:
    """rows, and the table's facts as text, in one aggregate."""
    told = FACTS.get(name, {})
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.expr(sql).cast("string").alias(label) for label, sql in told.items()]).first()
    return row.asDict()


def render(report: list[dict]) -> str:
    lines = []
    for entry in report:
        lines.append(f"{entry['table']}  {entry['rows']:,} rows" if entry["exists"] else f"{entry['table']}  does not exist yet")
        lines += [f"  {k} = {v}" for k, v in entry.items() if k not in ("table", "exists", "rows")]
    return "\n".join(lines)
