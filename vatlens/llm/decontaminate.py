"""Benchmark decontamination by winnowing (built-in functions only).

A window is ``WORDS`` consecutive words of an item, or the whole item if it
has fewer words. The hashes of the ``K``-word grams of a text are reduced to the
minimum of every ``WORDS - K + 1`` neighbours: two texts that share ``WORDS``
consecutive words share the minimum over them, so the join of these
fingerprints misses no shared window. Each hit is then extended: the window of
document words that the fingerprint stands for is compared word for word with
the windows of the items.

Defined results: null text and null item text have no words; an item without
words has no window; an item_id that is null still marks words but is not
listed; an item_id on several rows is one item; repeated document rows each get
their row; empty tables give empty results or no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vatlens.llm.common import same_row, saved, small, text_hash

WORDS, K = 10, 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text: A-Z lowered, split at every ASCII sign that is no digit or letter."""
    t = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(t, _GAP, -1), "")


def _grams(hashes: Column, k: int) -> Column:
    """Hash of every ``k`` consecutive words; the length is hashed too."""
    return F.when(F.size(hashes) >= k, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(hashes) - k, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)], F.lit(k)))
    ).otherwise(F.array().cast("array<bigint>"))


def _minima(grams: Column, w: int) -> Column:
    """Minimum of every ``w`` neighbours: one fingerprint per window."""
    return F.when(F.size(grams) >= w, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(grams) - w + 1, F.lit(1))),
        lambda i: F.array_min(F.slice(grams, i, w)))
    ).otherwise(F.array().cast("array<bigint>"))


def _prints(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds ``_p<L>`` for each window length: the fingerprint of the window at each word."""
    df = df.withColumn("_hash", F.transform("_words", lambda w: F.xxhash64(w)))
    full = {n: K if n == WORDS else n for n in lengths}
    df = df.withColumns({f"_g{n}": _grams(F.col("_hash"), k) for n, k in full.items()})
    return df.withColumns({f"_p{n}": _minima(F.col(f"_g{n}"), WORDS - K + 1) if n == WORDS else F.col(f"_g{n}")
                           for n in lengths})


def _windows(df: DataFrame, keys: list[str], lengths: list[int]) -> DataFrame:
    """One row per window of ``_words``: position, length, fingerprint and its words."""
    at = F.array(*[F.struct(F.lit(n).alias("len"), F.col(f"_p{n}").alias("prints")) for n in lengths])
    rows = _prints(df, lengths).select(*keys, "_words", F.explode(at).alias("_w")) \
        .select(*keys, "_words", F.col("_w.len").alias("len"), F.posexplode("_w.prints").alias("pos", "fp"))
    return rows.select(*keys, "pos", "len", "fp",
                       F.concat_ws(" ", F.slice("_words", F.col("pos") + 1, F.col("len"))).alias("window"))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, len, fp, window``: the distinct windows of each item."""
    items = benchmark.select("item_id", words(F.col("text")).alias("_words")) \
        .where(F.size("_words") > 0) \
        .withColumn("_len", F.least(F.size("_words"), F.lit(WORDS)))
    rows = _windows(items, ["item_id", "_len"], list(range(1, WORDS + 1)))
    return rows.where(F.col("len") == F.col("_len")).select("item_id", "len", "fp", "window").distinct()


def hits(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``_id, _h, pos, len, window``: every occurrence of an item's window in a document."""
    lengths = sorted(r["len"] for r in items.select("len").distinct().collect())  # at most WORDS values
    texts = docs.select(F.col("doc_id").alias("_id"), text_hash().alias("_h"), "text") \
        .where(F.col("text").isNotNull())
    if not lengths:
        return texts.select("_id", "_h", F.lit(0).alias("pos"), F.lit(0).alias("len"),
                            F.lit("").alias("window")).where(F.lit(False))
    split = texts.select("_id", "_h", words(F.col("text")).alias("_words"))
    prints = _prints(split, lengths).select("_id", "_h", F.explode(F.array_distinct(
        F.concat(*[F.col(f"_p{n}") for n in lengths]))).alias("fp"))
    known = saved(items.select("len", "fp", "window").distinct(), "item-windows")
    fps = saved(known.select("fp").distinct(), "item-prints")
    found = saved(prints.join(small(fps), "fp", "left_semi").select("_id", "_h").distinct(), "print-hits")
    # extend: only texts that share a fingerprint are split again
    near = texts.join(found, same_row(texts, found), "left_semi") \
        .select("_id", "_h", words(F.col("text")).alias("_words"))
    return _windows(near, ["_id", "_h"], lengths).join(small(known), ["len", "fp", "window"]) \
        .select("_id", "_h", "pos", "len", "window")


def _covered(spans: Column) -> Column:
    """Words covered by sorted ``(pos, end)`` spans."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["pos"], a["end"]))).alias("n"),
        F.greatest(a["end"], x["end"]).alias("end"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs``."""
    items = saved(item_windows(benchmark), "items")
    # an occurrence list is bounded by its own document
    found = saved(hits(docs, items).distinct(), "hits")
    spans = found.groupBy("_id", "_h").agg(_covered(F.sort_array(F.collect_set(
        F.struct("pos", (F.col("pos") + F.col("len")).alias("end"))))).alias("n_hit"))
    per_item = found.select("_id", "_h", "window").distinct() \
        .join(small(items.select("item_id", "window")), "window") \
        .groupBy("_id", "_h").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = spans.join(per_item.withColumnsRenamed({"_id": "_id2", "_h": "_h2"}),
                      F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2"))) \
        .select("_id", "_h", "n_hit", "items")
    # the hash of a null text is defined too, and no hit carries it
    rows = docs.select("doc_id", F.col("doc_id").alias("_id"), text_hash().alias("_h"),
                       F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return rows.join(both, same_row(rows, both), "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, all columns kept."""
    found = hits(docs, saved(item_windows(benchmark), "items")).select("_id", "_h").distinct()
    found = saved(found, "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_id"])
                     & (F.xxhash64(docs["text"]) == found["_h"]), "left_anti")
