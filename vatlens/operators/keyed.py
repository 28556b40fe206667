"""Keyed-table changes (M1-M5, J3) as new snapshots.

A temp view cannot take ``MERGE INTO`` and plain Parquet has no row-level
operations, so every change returns the *next version* of the table as a
DataFrame (write it to a new snapshot path, never over the one being read).
All are joins or aggregations on the key: a hot key is reduced map-side
(``max_by``) or handled by AQE's skew-join split; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _names(x) -> list[str]:
    if x is None:
        return []
    if isinstance(x, str):
        return [x]
    return list(x)


def _first_per_key(df: DataFrame, keys: list[str], order_by: Sequence[str] | None) -> DataFrame:
    """One row per key: the first by ``order_by`` (deterministic) or any."""
    order = _names(order_by)
    if not order:
        return df.dropDuplicates(keys)
    others = [c for c in df.columns if c not in keys]
    rec = F.struct(*[F.col(c) for c in others])
    # min_by over the ordering struct keeps the first row; map-side combined
    g = df.groupBy(*keys).agg(F.min_by(rec, F.struct(*[F.col(c) for c in order])).alias("_vl_r"))
    return g.select(*keys, *[F.col("_vl_r." + c).alias(c) for c in others]).select(*df.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: Sequence[str],
                  order_by: Sequence[str] | None = None) -> DataFrame:
    """M1: ``INSERT ... ON CONFLICT DO NOTHING``: keep old rows, add new keys only."""
    keys = _names(keys)
    fresh = _first_per_key(new.select(*old.columns), keys, order_by).join(
        old.select(*keys), on=keys, how="left_anti")
    return old.unionByName(fresh)


def _last_per_key(df: DataFrame, keys: list[str], version: Sequence[str]) -> DataFrame:
    """One row per key: the last write by ``version``; equal versions go by the other columns."""
    order = _names(version)
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    rec = F.struct(*[F.col(c) for c in others])
    g = df.groupBy(*keys).agg(F.max_by(rec, F.struct(*[F.col(c) for c in order], rec)).alias("_vl_r"))
    return g.select(*keys, *[F.col("_vl_r." + c).alias(c) for c in others]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str],
           version: Sequence[str] = ()) -> DataFrame:
    """M2: ``ON CONFLICT DO UPDATE``: the new row wins on a key conflict.

    ``old`` minus the keys present in ``new`` (``left_anti``), plus ``new``.
    Only the delta's keys have to meet the old table: AQE broadcasts them
    when the delta is small, and the old table is never re-aggregated.
    Of several new rows of a key the last write by ``version`` wins.
    """
    keys = _names(keys)
    cols = old.columns
    extra = [c for c in _names(version) if c not in cols]
    fresh = _last_per_key(new.select(*cols, *extra), keys, version).select(*cols)   # delta-sized shuffle
    kept = old.join(fresh.select(*keys), on=keys, how="left_anti")
    return kept.unionByName(fresh).select(*cols)


def update_by_key(df: DataFrame, changes: DataFrame, keys: Sequence[str],
                  cols: Sequence[str], version: Sequence[str] = ()) -> DataFrame:
    """M3: set ``cols`` from ``changes`` on matching keys; of several changes of a key the
    last by ``version`` holds, so no row is ever duplicated."""
    keys, cols = _names(keys), _names(cols)
    extra = [c for c in _names(version) if c not in cols + keys]
    changes = _last_per_key(changes.select(*keys, *cols, *extra), keys, version)
    ch = changes.select(*keys, *[F.col(c).alias("_vl_new_" + c) for c in cols],
                        F.lit(True).alias("_vl_hit"))
    j = df.join(ch, on=keys, how="left")
    j = j.withColumns({c: F.when(F.col("_vl_hit"), F.col("_vl_new_" + c)).otherwise(F.col(c))
                       for c in cols})
    return j.select(*df.columns)


def delete_by_key(df: DataFrame, doomed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """M4: remove rows whose key appears in ``doomed`` (``left_anti``)."""
    keys = _names(keys)
    return df.join(doomed.select(*keys).distinct(), on=keys, how="left_anti")


def delete_where(df: DataFrame, condition) -> DataFrame:
    """M4: remove rows matching a condition (NULL condition keeps the row)."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def cascade_delete(doomed_keys: DataFrame, key: str,
                   dependents: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Delete rows that depend on the doomed keys, table by table.

    ``dependents`` maps a name to ``(table, foreign-key column)``; returns the
    next version of each table.
    """
    keys = doomed_keys.select(F.col(key).alias("_vl_k")).distinct()
    out = {}
    for name, (t, fk) in dependents.items():
        out[name] = t.join(keys, t[fk] == keys["_vl_k"], "left_anti")
    return out
