"""Column factories: pure expressions, no UDF. Instants are TIMESTAMP_NTZ in UTC, money is exact decimal."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BUSINESS_ZONE = "Europe/Paris"
UNKNOWN = "Unknown"
MONEY = "decimal(12,2)"
#: What an e-mail address and a postal code look like.
EMAIL = r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$"
POSTAL_CODE = r"^[0-9]{5}$"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def blank_to_null(x: Column | str) -> Column:
    """The trimmed text; nothing where that is empty."""
    return F.nullif(F.trim(_c(x)), F.lit(""))


def labelled(x: Column | str, labels: Mapping[str, str]) -> Column:
    """The code of a label, after trimming and lower-casing; null for one that is not listed."""
    table = F.create_map(*[F.lit(part) for pair in labels.items() for part in pair])
    return F.try_element_at(table, F.lower(F.trim(_c(x))))


def first_true(rules: Sequence[tuple[Column, str]]) -> Column:
    """The name of the first rule that holds; a rule that is null does not hold."""
    held = [F.when(rule, F.lit(name)) for rule, name in rules]
    return F.coalesce(*held)


def tolerant_int(x: Column | str) -> Column:
    return F.trim(_c(x)).try_cast("int")


def tolerant_money(x: Column | str) -> Column:
    """decimal(10,2) from text with a decimal comma or point; null for anything else."""
    return F.translate(F.trim(_c(x)), ",", ".").try_cast("decimal(10,2)")


def tolerant_instant(x: Column | str) -> Column:
    """An instant from ISO text that may carry a zone; null for anything else. The session's zone must be UTC."""
    return _c(x).try_cast("timestamp").cast("timestamp_ntz")


def local_to_utc(x: Column | str, pattern: str = "dd/MM/yyyy HH:mm:ss", zone: str = BUSINESS_ZONE) -> Column:
    """UTC instant of a local time written by pattern; null for text that does not fit."""
    local = F.try_to_timestamp(F.trim(_c(x)), F.lit(pattern)).cast("timestamp_ntz")
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def business_day(instant: Column | str, zone: str = BUSINESS_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(instant)).cast("date")


def email(x: Column | str) -> Column:
    cleaned = F.lower(F.trim(_c(x)))
    return F.when(cleaned.rlike(EMAIL), cleaned)


def postal_code(x: Column | str) -> Column:
    cleaned = F.trim(_c(x))
    return F.when(cleaned.rlike(POSTAL_CODE), cleaned)


def positive(x: Column | str) -> Column:
    return F.when(_c(x) > 0, _c(x))


def text_flag(x: Column | str) -> Column:
    """Whether the text says true; null stays null."""
    return F.lower(F.trim(_c(x))) == "true"


def surrogate_key(*parts: Column | str) -> Column:
    """md5 of the parts as text, joined by |; a null part is written _null_."""
    return F.md5(F.concat_ws("|", *[F.coalesce(_c(p).cast("string"), F.lit("_null_")) for p in parts]))


def unknown_key() -> Column:
    return F.md5(F.lit("_unknown_"))


def date_key(day: Column | str) -> Column:
    d = _c(day)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def line_amounts(quantity: Column | str = "quantity", price: Column | str = "unit_price", percent: Column | str = "discount_pct") -> dict[str, Column]:
    """Gross, net (rounded half up) and discount of an order line, exact."""
    gross = (_c(quantity) * _c(price)).cast(MONEY)
    net = F.round(gross * (100 - _c(percent)) * F.lit(0.01).cast("decimal(3,2)"), 2).cast(MONEY)
    return {"gross_amount": gross, "discount_amount": (gross - net).cast(MONEY), "net_amount": net}


def elapsed(later: Column | str, earlier: Column | str, unit_seconds: int, digits: int) -> Column:
    """Time between two instants in a unit, rounded half up."""
    micros = F.timestamp_diff("MICROSECOND", _c(earlier), _c(later)).cast("decimal(20,0)")
    return F.round(micros / F.lit(unit_seconds * 1_000_000).cast("decimal(20,0)"), digits).cast(f"decimal(12,{digits})")


def zero_if(flag: Column | str, amount: Column | str) -> Column:
    return F.when(_c(flag), F.lit(0)).otherwise(_c(amount))


def department(code: Column | str) -> Column:
    return F.left(_c(code), F.lit(2))


def segment(orders: Column | str) -> Column:
    n = _c(orders)
    return F.when(n == 0, "No purchase").when(n == 1, "One-time").when(n < 5, "Repeat").otherwise("Loyal")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; null where whole is 0 or null."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def utc_text(instant: Column | str) -> Column:
    """Microsecond text with a UTC offset, as a relational bulk load takes it."""
    return F.date_format(_c(instant), "yyyy-MM-dd HH:mm:ss.SSSSSS'+00'")
