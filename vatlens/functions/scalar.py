"""Scalar Column helpers (F1-F12); all built-in expressions, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def basename(path) -> Column:
    """last path element, splitting on both ``/`` and ``\\``."""
    return F.element_at(F.split(_c(path), r"[/\\]"), -1)


def date_part(ts) -> Column:
    """the date part of a timestamp (or of its ``'YYYY-MM-DD HH:MM:SS'`` text)."""
    return F.split(_c(ts).cast("string"), " ")[0]


def format_fixed(x, decimals: int) -> Column:
    """fixed decimals, half-up on ``x * 10^d`` (same IEEE steps in any SQL engine).

    ``format_string('%.2f')`` rounds the shortest decimal string in Spark but
    the binary value elsewhere; this keeps results engine-independent.
    """
    x = _c(x).cast("double")
    scale = 10 ** decimals
    # beyond 2^53 a double has no fraction, and its units may not fit in a long
    large = F.abs(x) >= F.lit(float(2 ** 53))
    units = F.floor(F.when(large, F.lit(0.0)).otherwise(F.abs(x)) * F.lit(float(scale)) + F.lit(0.5)).cast("long")
    huge = F.abs(x).try_cast("decimal(38,0)").cast("string")
    whole = (units / F.lit(scale)).cast("long") if decimals else units
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    if decimals == 0:
        return F.when(x.isNotNull(), F.concat(sign, F.when(large, huge).otherwise(whole.cast("string"))))
    frac = F.lpad((units % F.lit(scale)).cast("string"), decimals, "0")
    return F.when(x.isNotNull(), F.concat(sign, F.when(large, huge).otherwise(whole.cast("string")), F.lit("."), frac))


def thousands(n) -> Column:
    """integer with thousands separators (``f"{n:,}"``)."""
    return F.format_number(_c(n).cast("long"), 0)


def json_field(js, field: str, default: str | None = None) -> Column:
    """a field of a JSON text, with a default when absent."""
    v = F.get_json_object(_c(js), f"$.{field}")
    return F.coalesce(v, F.lit(default)) if default is not None else v


def has_json_key(js, field: str) -> Column:
    """key-presence test (``'R2' in res``)."""
    return F.get_json_object(_c(js), f"$.{field}").isNotNull()


def timestamp_text(ts) -> Column:
    """F8: a timestamp formatted to the second."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


def log_grid(start: float, stop: float, num: int) -> Column:
    """``logspace(start, stop, num)`` as an array column."""
    step = (stop - start) / (num - 1) if num > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)),
                       lambda i: F.pow(F.lit(10.0), F.lit(start) + i * F.lit(step)))


def to_int_flag(b) -> Column:
    """boolean -> 0/1 (NULL -> 0)."""
    return F.coalesce(_c(b), F.lit(False)).cast("int")
