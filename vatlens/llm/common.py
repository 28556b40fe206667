"""Helpers shared by the operators of this subpackage.

Conventions that hold for every operator here:

* a null ``text`` is an empty text unless the docstring says otherwise;
* only ``doc_id`` and ``text`` (and the columns a docstring names) are read, so
  extra columns never clash; filters hand every column of their input back;
* intermediate tables are Parquet files in the shared checkpoint folder, so a
  lost executor costs a reread and not a recomputation;
* a side is broadcast only after its rows were counted against a limit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vatlens.session import checkpoint_dir

#: A side with more rows than this is never broadcast. The rows joined this way
#: are a few fixed-width values or one short string, so 200,000 stay under 30 MB.
BROADCAST_ROWS = 200_000
#: Bytes of text that a Python task works on at a time.
SLICE = 12_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already saved) with a broadcast hint if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= limit else df


def text_hash() -> Column:
    """With ``doc_id`` the join key of a row: rows that share both are repeated rows."""
    return F.xxhash64(F.col("text"))


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["_id"].eqNullSafe(b["_id"]) & (a["_h"] == b["_h"])


def remainder(m: int) -> Column:
    """``crc32(doc_id as text) mod m``; null for a null ``doc_id``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(m))


def held_out(m: int, k: int) -> Column:
    """Whether a row is in the held-out part; a null ``doc_id`` is never held out,
    and never learned from either (``remainder(m) != k`` is null for it)."""
    return F.coalesce(remainder(m) == k, F.lit(False))


def map_texts(docs: DataFrame, keep: list[str], fields: list[T.StructField],
              make: Callable[[], Callable[[list], list]], size: int | None = None) -> DataFrame:
    """Append ``fields`` computed from ``text`` in Python, one Arrow batch at a time.

    ``make()`` runs once per task and returns a function from texts (null as None)
    to one list or Arrow array per field. ``keep`` columns pass through untouched.
    A batch is cut into slices of about ``size`` (``SLICE``) bytes of text, so memory is bounded
    by the slice and the longest single text. The text is sent once: if ``keep`` holds
    it, as ``text`` or as a field of ``_row``, it is read there.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + fields)
    kept, cols = len(keep), [f.name for f in fields]
    row = docs.schema["_row"].dataType.fieldNames() if "_row" in keep else []
    place = keep.index("text") if "text" in keep else keep.index("_row") if "text" in row else kept
    inside = row.index("text") if "text" in row and "text" not in keep else None

    def texts_of(b: pa.RecordBatch) -> pa.Array:
        # flatten() and not field(), which leaves out a slice's offset
        return b.column(place) if inside is None else b.column(place).flatten()[inside]

    arrow = [_arrow(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for b in _slices(batch, texts_of(batch), size):
                out = fn(texts_of(b).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b.column(i) for i in range(kept)]
                    + [v if isinstance(v, pa.Array) else pa.array(v, t) for v, t in zip(out, arrow)],
                    names=list(keep) + cols)

    sent = docs.select(*keep) if place < kept else docs.select(*keep, F.col("text").alias("_text"))
    return sent.mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, values: pa.Array, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` bytes (or list items) of ``values``, at least one row each."""
    most, at, size = most or SLICE, 0, 0
    length = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
    for k, n in enumerate(pc.fill_null(length(values), 0).to_pylist()):
        size += n
        if size >= most:
            yield batch.slice(at, k + 1 - at)
            at, size = k + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
            "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[t.simpleString()]


def field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, T.DataType.fromDDL(kind))


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """One row per labelled doc_id."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()) \
        .groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def isotonic(x: list[float], positive: list[float], weight: list[float]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: the non-decreasing share of positives along ``x``."""
    blocks: list[list[float]] = []  # first x, positives, weight
    for a, p, w in zip(x, positive, weight):
        blocks.append([a, p, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, p2, w2 = blocks.pop()
            blocks[-1][1] += p2
            blocks[-1][2] += w2
    return [b[0] for b in blocks], [b[1] / b[2] for b in blocks]
