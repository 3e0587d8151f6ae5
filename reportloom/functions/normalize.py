"""Normal forms of dates, units, numbers and recorded values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reportloom.functions import vocab as V
from reportloom.functions.arrays import literal_map
from reportloom.functions.text import name_key, strip


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.concat_ws("-", F.lpad(y, 4, "0"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))


def _dated(iso: Column, confidence) -> Column:
    return F.struct(iso.alias("iso"), F.lit(confidence).cast("double").alias("confidence"))


def normalize_date(raw: Column, fmt: str) -> Column:
    """``struct<iso, confidence>``; ISO and month names are not range-checked."""
    raw = strip(raw)
    none = F.lit(None).cast("string")
    pattern = {
        "iso": r"^(\d{4})-(\d{2})-(\d{2})",
        "us_textual": r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})",
        "us_numeric": r"^(\d{1,2})/(\d{1,2})/(\d{4})",
        "dash": r"^(\d{1,2})-(\d{1,2})-(\d{4})",
    }.get(fmt)
    if pattern is None:
        return _dated(none, 0.2)
    a, b, c = (F.regexp_extract(raw, pattern, g) for g in (1, 2, 3))
    if fmt == "iso":
        ok = _dated(_iso(a, b, c), 1.0)
    elif fmt == "us_textual":
        month = F.element_at(
            literal_map({m.lower(): str(i + 1) for i, m in enumerate(V.MONTHS)}), F.lower(a))
        ok = F.when(month.isNotNull(), _dated(_iso(c, month, b), 1.0)).otherwise(_dated(none, 0.3))
    else:
        m, d = (a, b) if fmt == "us_numeric" else (b, a)
        fits = (m.try_cast("int").between(1, 12) & d.try_cast("int").between(1, 31)
                & c.try_cast("int").between(1900, 2100))
        ok = F.when(fits, _dated(_iso(c, m, d), 0.9)).otherwise(_dated(none, 0.3))
    return F.when(raw.rlike(pattern), ok).otherwise(_dated(none, 0.2))


def normalize_unit(unit: Column) -> Column:
    """``struct<unit, confidence>``; an unknown unit is kept and marked uncertain."""
    text = strip(unit)
    known = F.element_at(literal_map(V.UNITS), F.lower(text))
    return (F.when(unit.isNull() | (unit == ""), F.struct(
                F.lit(None).cast("string").alias("unit"), F.lit(1.0).alias("confidence")))
            .when(known.isNotNull(), F.struct(known.alias("unit"), F.lit(1.0).alias("confidence")))
            .otherwise(F.struct(text.alias("unit"), F.lit(0.5).alias("confidence"))))


def same_value(a_num: Column, a_raw: Column, b_num: Column, b_raw: Column) -> Column:
    return F.when(a_num.isNotNull() & b_num.isNotNull(), F.abs(a_num - b_num) < 1e-9).otherwise(
        F.coalesce(name_key(a_raw), F.lit("")) == F.coalesce(name_key(b_raw), F.lit("")))


def format_measurement(raw: Column, unit: Column, ref: Column, flag: Column) -> Column:
    blank = F.lit("")
    return F.concat(
        F.coalesce(raw, blank),
        F.coalesce(F.concat(F.lit(" "), F.nullif(unit, blank)), blank),
        F.coalesce(F.concat(F.lit(" (ref "), F.nullif(ref, blank), F.lit(")")), blank),
        F.coalesce(F.concat(F.lit(" ["), F.nullif(flag, blank), F.lit("]")), blank))
