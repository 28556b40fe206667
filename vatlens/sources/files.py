"""Readers and writers.

CSV: pandas treats a list of tokens as missing; Spark's ``nullValue`` takes
one string. So a CSV is read as text with a declared (or all-string)
schema - no ``inferSchema`` pass - the tokens are mapped to NULL, and the
columns are ``try_cast`` to the wanted types. Type inference, when asked
for, is one distributed aggregate that tests which columns parse as long /
double, not a driver-side scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vatlens.operators.cleaning import to_number

# The cells pandas' read_csv reads as missing by default.
MISSING_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                  "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                  "nan", "null"]


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("header", False).csv(path).limit(1).collect()
    return [str(c) if c is not None else f"_c{i}" for i, c in enumerate(first[0])] if first else []


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             infer: bool = True, missing: Sequence[str] = tuple(MISSING_TOKENS),
             strip_names: bool = True) -> DataFrame:
    """Header CSV with pandas' missing-value tokens; typed by ``schema`` or inference.

    Column names keep their header text unless ``strip_names`` (P1).
    """
    names = _header(spark, path)
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = (spark.read.option("header", True).option("mode", "PERMISSIVE")
           .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
           .schema(text_schema).csv(path))
    toks = list(missing)
    raw = raw.select(*[F.when(F.col(f"`{n}`").isin(toks) | F.col(f"`{n}`").isNull(),
                              F.lit(None).cast("string")).otherwise(F.col(f"`{n}`")).alias(n)
                       for n in names])
    if strip_names:
        raw = raw.toDF(*[n.strip() for n in names])
    cols = raw.columns
    if schema is not None:
        st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        types = {f.name: f.dataType for f in st.fields}
        return raw.select(*[F.trim(F.col(f"`{c}`")).try_cast(types[c]).alias(c) if c in types
                            else F.col(f"`{c}`") for c in cols])
    if not infer:
        return raw
    # one aggregate: does every non-null value parse as long / as double?
    aggs = []
    for i, c in enumerate(cols):
        v = F.trim(F.col(f"`{c}`"))
        aggs.append(F.bool_and(F.when(v.isNotNull(), v.try_cast("long").isNotNull())).alias(f"l{i}"))
        # a Java suffix (``1d``) is text to pandas, so it is no number here either
        aggs.append(F.bool_and(F.when(v.isNotNull(), to_number(v).isNotNull())).alias(f"d{i}"))
        aggs.append(F.bool_and(F.when(v.isNotNull(), v.isin("True", "False", "TRUE", "FALSE", "true", "false")))
                    .alias(f"b{i}"))
    row = raw.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        v = F.trim(F.col(f"`{c}`"))
        if row[f"l{i}"]:
            out.append(v.try_cast("long").alias(c))
        elif row[f"d{i}"] or row[f"d{i}"] is None:   # a column without values is double, as in pandas
            out.append(to_number(v).alias(c))
        elif row[f"b{i}"]:
            out.append(v.try_cast("boolean").alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return raw.select(*out)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> None:
    """Write processed / scored rows (Parquet by default, header CSV on request)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None,
               fmt: str = "parquet") -> DataFrame:
    """Scan a table, all or some columns (pruned at the scan)."""
    df = spark.read.format(fmt).load(path)
    return df.select(*columns) if columns else df


def snapshot(raw: DataFrame, clean: DataFrame, base: str, fmt: str = "parquet") -> dict[str, str]:
    """Keep the raw input and the cleaned table as separate versions.

    The reference backs the file up and overwrites it in place; Spark cannot
    overwrite the path it is reading, and an in-place rewrite loses the raw
    rows (its retraining drops another first row), so both are written side
    by side and the input is never touched.
    """
    paths = {"raw": f"{base}/raw", "clean": f"{base}/clean"}
    write_table(raw, paths["raw"], fmt)
    write_table(clean, paths["clean"], fmt)
    return paths
