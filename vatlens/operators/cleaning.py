"""Projection, filtering and cleaning operators.

Missing values: pandas marks them with NaN, Spark separates NULL and NaN.
``nan_to_null`` turns NaN into NULL once on ingest; everything after works on
NULL only (``NaN > 1`` is true in Spark, false in numpy).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that pandas' to_numeric rejects but Spark's cast accepts: a Java
# float/double suffix (``1d``, ``2.5f``). Checked before the cast.
_JAVA_SUFFIX = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[dDfF]\s*$"


def _names(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


# ---------------------------------------------------------------- P1, P6, P22
def strip_column_names(df: DataFrame) -> DataFrame:
    """Remove surrounding whitespace from every column name."""
    return df.toDF(*[c.strip() for c in df.columns])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the named columns that exist."""
    return df.drop(*[c for c in _names(cols) if c in df.columns])


def relabel(df: DataFrame, mapping: dict[str, str], keep_others: bool = False) -> DataFrame:
    """Select and rename columns for display, in ``mapping`` order."""
    sel = [F.col(src).alias(dst) for src, dst in mapping.items()]
    if keep_others:
        sel += [F.col(c) for c in df.columns if c not in mapping]
    return df.select(*sel)


# ---------------------------------------------------------------- NaN, P2
def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN into NULL in floating columns (all of them by default)."""
    fl = {c for c, t in df.dtypes if t in ("double", "float")}
    targets = [c for c in (_names(cols) or df.columns) if c in fl]
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast(df.schema[c].dataType))
                           for c in targets}) if targets else df


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any missing value (NULL or NaN) in ``subset`` (default all)."""
    return df.na.drop(how="any", subset=_names(subset) or None)


# ---------------------------------------------------------------- P5, P3, P4
def to_number(col: str | Column, dtype: T.DataType | None = None) -> Column:
    """P5: numeric coercion, unparsable text and NaN -> NULL (``to_numeric(errors='coerce')``).

    ``dtype`` is the source type when known: numerics are cast, booleans go
    through 0/1, text is trimmed and ``try_cast`` with a guard against Java
    literal suffixes.
    """
    c = F.col(col) if isinstance(col, str) else col
    if isinstance(dtype, T.BooleanType):
        return c.cast("int").cast("double")
    null = F.lit(None).cast("double")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.nanvl(c.cast("double"), null)
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    s = c.cast("string")
    return F.when(s.rlike(_JAVA_SUFFIX), null).otherwise(F.nanvl(F.trim(s).try_cast("double"), null))


def align_columns(df: DataFrame, features: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """Add missing features as NULL, drop extras, order as ``features``, coerce to double.

    ``keep`` columns (row ids) are passed through in front, untouched.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    sel = [F.col(k) for k in _names(keep)]
    for c in features:
        if c in types:
            sel.append(to_number(F.col(c), types[c]).alias(c))
        else:
            sel.append(F.lit(None).cast("double").alias(c))
    return df.select(*sel)


def alignment_report(spark: SparkSession, columns: Sequence[str], features: Sequence[str],
                     target: str | None = None) -> DataFrame:
    """Which columns were found, expected, missing, and dropped as extra.

    Long form ``(kind, position, column_name)``; the target is not counted as
    an extra. Built from schema metadata only, no data is read.
    """
    cols, feats = list(columns), list(features)
    rows = [("original", i, c) for i, c in enumerate(cols)]
    rows += [("expected", i, c) for i, c in enumerate(feats)]
    rows += [("missing", i, c) for i, c in enumerate([c for c in feats if c not in cols])]
    extra = [c for c in cols if c not in feats and c != target]
    rows += [("extra_dropped", i, c) for i, c in enumerate(extra)]
    schema = "kind string, position int, column_name string"
    return spark.createDataFrame(rows, schema)


def alignment_losses(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per expected column ``(column_name, n_rows, n_lost)``: cells that are there but no
    number and become NULL, or every row where the column is missing. One pass."""
    feats, types = _names(features), {f.name: f.dataType for f in df.schema.fields}
    lost = [F.count_if(F.col(c).isNotNull() & to_number(F.col(c), types[c]).isNull()) if c in types
            else F.count(F.lit(1)) for c in feats]
    wide = df.agg(F.count(F.lit(1)).alias("_vl_n"), *[x.cast("long").alias(c) for c, x in zip(feats, lost)])
    return wide.unpivot(["_vl_n"], feats, "column_name", "n_lost").select(
        "column_name", F.col("_vl_n").cast("long").alias("n_rows"), "n_lost")


# ---------------------------------------------------------------- P7
def numeric_columns(df: DataFrame, exclude: Sequence[str] | None = None) -> list[str]:
    """Names of numeric columns (booleans excluded)."""
    ex = set(_names(exclude))
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in ex]


# ---------------------------------------------------------------- P8, P9
def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` with NULL for a zero (or -0.0) or NULL divisor.

    Plain ``/`` raises under ANSI mode; pandas would give inf/NaN, which a
    model cannot take either, so NULL (then imputed) is the rule here.
    """
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return F.try_divide(n.cast("double"), d.cast("double"))


_OPS = {">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v}


def flag(col: str | Column, op: str, threshold) -> Column:
    """0/1 int flag of a strict/loose comparison; NULL compares false -> 0."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_OPS[op](c, F.lit(threshold)), F.lit(False)).cast("int")


# ---------------------------------------------------------------- P11, P18-P20
def valid_target(df: DataFrame, target: str) -> DataFrame:
    """Keep rows whose target parses as a number (then cast to double)."""
    t = to_number(F.col(target), df.schema[target].dataType)
    return df.withColumn(target, t).filter(F.col(target).isNotNull())


def split_by_cutoff(df: DataFrame, col: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """Rows with ``col <= cutoff`` and the complement (NULL goes to the complement)."""
    cond = F.coalesce(F.col(col) <= F.lit(cutoff), F.lit(False))
    return df.filter(cond), df.filter(~cond)


def filter_equals(df: DataFrame, **conditions) -> DataFrame:
    """Conjunctive equality filter, e.g. ``filter_equals(runs, username="a", id=3)``."""
    cond = F.lit(True)
    for k, v in conditions.items():
        cond = cond & (F.col(k) == F.lit(v))
    return df.filter(cond)


def pending(df: DataFrame, flag_col: str = "approved") -> DataFrame:
    """P20: rows whose boolean flag is false or missing."""
    return df.filter(~F.coalesce(F.col(flag_col), F.lit(False)))


# ---------------------------------------------------------------- P12, P13
def fill_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace NULL and NaN with the column's exact median (linear interpolation).

    The median of integers can lie between two of them, so filled columns are double.

    The medians come from the distributed exact quantile (``quantiles``) and
    enter the plan as literals. (``ml.Imputer`` takes a lower median, not the
    interpolated one.)
    """
    cols = _names(cols)
    if not cols:
        return df
    from vatlens.operators.quantiles import quantile_row
    df = df.withColumns({c: to_number(F.col(c), df.schema[c].dataType) for c in cols})
    q = quantile_row(df, cols, [0.5])
    row = {c: q.get((c, 0.5)) for c in cols}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(row[c])) if row[c] is not None else F.col(c)
                           for c in cols})


def fill_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace NULL with the most frequent value; ties -> smallest value."""
    cols = _names(cols)
    if not cols:
        return df
    from vatlens.operators.quantiles import MAP_LIMIT, max_distinct
    # ``mode`` merges one value -> count map per column in a single task:
    # used only while the estimated distinct counts add up to a small number,
    # otherwise the counts are a distributed groupBy and two one-row reductions
    nd, held, small = max_distinct(df, cols), 0, []
    for c in sorted(cols, key=nd.get):
        held += nd[c]
        if held <= MAP_LIMIT:
            small.append(c)
    row = df.agg(*[F.mode(F.col(c), True).alias(c) for c in small]).first().asDict() if small else {}
    for c in cols:
        if c in small:
            continue
        counts = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_vl_n"))
        top = counts.agg(F.max("_vl_n")).first()[0]
        row[c] = (counts.filter(F.col("_vl_n") == F.lit(top)).agg(F.min(c)).first()[0]
                  if top is not None else None)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(row[c]).cast(df.schema[c].dataType))
                           if row[c] is not None else F.col(c) for c in cols})


# ---------------------------------------------------------------- P14, P15
def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop exact duplicate rows (NULLs compare equal)."""
    return df.dropDuplicates(_names(subset) or None)


def duplicate_count(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """One row ``n_rows, n_distinct, n_duplicates``.

    Grouping by the full row pre-aggregates map-side, so a hot duplicate
    collapses before the shuffle.
    """
    keys = _names(subset) or df.columns
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_vl_c"))
    return g.agg(
        F.coalesce(F.sum("_vl_c"), F.lit(0)).cast("long").alias("n_rows"),
        F.count(F.lit(1)).cast("long").alias("n_distinct"),
    ).withColumn("n_duplicates", (F.col("n_rows") - F.col("n_distinct")).cast("long"))


# ---------------------------------------------------------------- P16, P17
def missing_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NULL (and NaN) count per column, long form ``(column_name, n_missing)``.

    One pass; the one-row result is unpivoted.
    """
    cols = _names(cols) or df.columns
    fl = {c for c, t in df.dtypes if t in ("double", "float")}

    def miss(c):
        m = F.col(c).isNull()
        if c in fl:
            m = m | F.isnan(F.col(c))
        return F.sum(m.cast("long"))

    wide = df.agg(*[F.coalesce(miss(c), F.lit(0)).cast("long").alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "n_missing")


def missing_mask(df: DataFrame, cols: Sequence[str] | None = None,
                 keep: Sequence[str] | None = None, suffix: str = "_missing") -> DataFrame:
    """Per-row 0/1 missing indicator for each column (heat-map data)."""
    cols = _names(cols) or [c for c in df.columns if c not in _names(keep)]
    fl = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[F.col(k) for k in _names(keep)],
                     *[(F.col(c).isNull() | (F.isnan(F.col(c)) if c in fl else F.lit(False)))
                       .cast("int").alias(c + suffix) for c in cols])


# ---------------------------------------------------------------- P21
def shape(df: DataFrame) -> tuple[int, int]:
    """(rows, columns); counting rows runs one job."""
    return df.count(), len(df.columns)


def dtypes_frame(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Column names and types as a table."""
    return spark.createDataFrame([(i, c, t) for i, (c, t) in enumerate(df.dtypes)],
                                 "position int, column_name string, data_type string")


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows in an explicit order (a top-k, not a sample)."""
    return df.orderBy(*_names(order_by)).limit(n)
