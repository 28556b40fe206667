"""Train/test splits and fold ids.

Random splits are deterministic hashes of a row key - no global shuffle and
no driver-side permutation: ``bucket = int(first 8 hex of md5(key)) % k``.
The same expression runs in any SQL engine with ``md5``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vatlens.operators import cleaning, ordered, summary


def hash_bucket(key: str | Column, k: int, seed: str | None = None) -> Column:
    """``conv(substr(md5(key [|| seed]), 1, 8), 16, 10) % k`` as an int."""
    c = F.col(key) if isinstance(key, str) else key
    s = c.cast("string")
    if seed is not None:
        s = F.concat(s, F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % F.lit(k)).cast("int")


def hash_split(df: DataFrame, key: str, test_buckets: int = 1, k: int = 5,
               name: str = "split") -> DataFrame:
    """L7: 'train' / 'test' label; ``test_buckets`` of ``k`` go to test (1/5 = 20 %)."""
    b = hash_bucket(key, k)
    return df.withColumn(name, F.when(b < F.lit(k - test_buckets), F.lit("train")).otherwise(F.lit("test")))


def hash_folds(df: DataFrame, key: str, k: int = 5, name: str = "fold",
               seed: str | None = None) -> DataFrame:
    """Fold id by hash bucket (shuffled k-fold without moving rows).

    Give a ``seed`` when the rows were already selected by ``hash_split`` on
    the same key: without it the fold would be the split's own bucket and the
    training rows would fill only k-1 folds.
    """
    return df.withColumn(name, hash_bucket(key, k, seed))


def block_folds(df: DataFrame, order_by: Sequence[str], k: int = 5,
                partition_by: Sequence[str] | None = None, name: str = "fold") -> DataFrame:
    """Contiguous folds in row order (KFold without shuffle)."""
    return ordered.contiguous_folds(df, order_by, k, partition_by, name=name)


def time_split(df: DataFrame, time: str, q: float = 0.8) -> tuple[DataFrame, DataFrame, int]:
    """cutoff = int(quantile(time, q)); rows ``<= cutoff`` train, the rest test."""
    cut = summary.quantile_cutoff(df, time, q).first()["cutoff"]
    train, test = cleaning.split_by_cutoff(df, time, cut)
    return train, test, cut
