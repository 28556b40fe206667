"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are 64 bits: a bit is 1 if set in over half of the shingle hashes
(XXH64, seed 42, of every ``shingle`` consecutive words, repeats included).
Two fingerprints link at ``radius`` or fewer differing bits, and a component is
what links reach.

Comparison: fingerprints within the radius agree on all but ``radius`` of ``n``
blocks of bits, so each distinct fingerprint goes, once per choice of agreeing
blocks, into the bucket of those bits. A task sorts the fingerprints of its
buckets and stores them vertically, one bit plane per bit. Small buckets are
compared all at once, planes against themselves shifted by 1, 2, ... rows; a large
one in blocks of fingerprints against all its planes. The XOR marks differing
bits, two carry-save counters and a sticky overflow add them up, and a block is
abandoned once every row of it has overflowed.

Skew: copies collapse to one distinct fingerprint before anything is shuffled.
A bucket with more than ``hot`` fingerprints is dealt again into finer buckets
by the same rule on the bits in which its members may still differ (exact,
since they agree on the others); what stays hot is compared chunk against chunk
in separate tasks.

Defined results: a text without words has fingerprint zero, linked like any
other; null is an empty text; ties (a bit set in exactly half) give 0; repeated
rows each get their row; a null doc_id gets a fingerprint, and a component only
through others (smallest non-null doc_id reachable, else null).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vatlens.llm.common import field, map_texts, saved, text_hash

SHINGLE, RADIUS = 3, 3
#: Fingerprints of a bucket that one task compares with each other.
HOT = 16_384
_FEW, _QUERIES = 64, 128  # rows of a small bucket; fingerprints in a block that can be abandoned


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``fp`` for every row; ``fp`` holds the 64 bits as a signed long."""
    def make():
        import xxhash
        digest = xxhash.xxh64_intdigest
        # Fixed: A-Z lowered; words end at space and \x09-\x0D, as bytes.split() does.
        lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

        def one(text) -> int:
            if not text:
                return 0
            words = text.encode().translate(lower).split()
            if not words:
                return 0
            if len(words) <= shingle:
                hashes = [digest(b" ".join(words), 42)]
            else:
                hashes = [digest(b" ".join(words[i:i + shingle]), 42) for i in range(len(words) - shingle + 1)]
            n, half = len(hashes), np.zeros(64, np.int64)
            for a in range(0, n, 1 << 16):  # bits of at most 65,536 hashes at a time
                part = np.array(hashes[a:a + (1 << 16)], dtype="<u8").view(np.uint8)
                half += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
            return int(np.packbits(half * 2 > n, bitorder="little").view("<i8")[0])

        return lambda texts: [[one(t) for t in texts]]

    return map_texts(docs, list(keep), [field("fp", "bigint")], make)


def _bits(n: int, blocks: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.arange(n), blocks)]


def _masks(positions: list[int], blocks: int, radius: int) -> list[int]:
    """For each choice of agreeing blocks of ``positions``, the mask of their bits."""
    parts = _bits(len(positions), blocks)
    return [sum(1 << positions[i] for p in pick for i in parts[p])
            for pick in combinations(range(blocks), blocks - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """``fp, mask, key``: a row for each mask; ``key`` is what the bucket agrees on."""
    each = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return fps.select("fp", each.alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _finer(hot: DataFrame, masks: list[int], blocks: int, radius: int) -> DataFrame:
    """Deal the rows of hot buckets again by blocks of the bits outside their mask."""
    finer = F.create_map(*[x for m in masks for x in (
        F.lit(_signed(m)),
        F.array(*[F.lit(_signed(m | more)) for more in
                  _masks([b for b in range(64) if not m >> b & 1], blocks, radius)]))])
    return hot.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Booleans to 64-bit words, first row in the lowest bit."""
    packed = np.packbits(bits, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view("<u8")


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every fingerprint, 64 fingerprints to a word."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).T
    return np.stack([_pack(b) for b in np.ascontiguousarray(bits)])


def _near(a: np.ndarray, b: np.ndarray, valid: np.ndarray, radius: int) -> np.ndarray:
    """Bits of ``valid`` at which the planes ``a`` and ``b`` differ in at most ``radius`` (0 to 3) places.

    Planes come first in ``a`` and ``b``; the rest broadcasts to the shape of ``valid``.
    """
    ones, twos, over = (np.zeros_like(valid) for _ in range(3))

    def within():
        return valid & ~(over | (ones & twos, twos, ones | twos)[2 - radius] if radius < 3 else over)

    for k in range(64):
        x = a[k] ^ b[k]
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if k % 8 == 7 and not (left := within()).any():
            return left
    return within()


def _rows(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")


def _shifted(planes: np.ndarray, by: int) -> np.ndarray:
    """The planes of the rows ``by`` further on (``by`` under 64)."""
    high = np.zeros_like(planes)
    high[:, :-1] = planes[:, 1:]
    return (planes >> np.uint64(by)) | (high << np.uint64(64 - by))


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the sets of ``root`` (smallest member first) along links ``a``, ``b``."""
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return root


def _bitmasks(fps: np.ndarray) -> np.ndarray:
    """Planes of single fingerprints: all ones or all zeros, one per fingerprint."""
    bits = (fps[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)
    return (np.uint64(0) - bits)[:, :, None]


def _against(root: np.ndarray, a: np.ndarray, b: np.ndarray, at: int, radius: int) -> np.ndarray:
    """Join rows of ``b`` (numbered from ``at``) with rows of ``a`` (from 0): blocks of
    ``_QUERIES`` fingerprints against all planes."""
    planes = _planes(a)[:, None, :]
    valid = _pack(np.ones(len(a), bool))
    for q in range(0, len(b), _QUERIES):
        part = b[q:q + _QUERIES]
        found = _near(planes, _bitmasks(part), np.tile(valid, (len(part), 1)), radius)
        i, j = np.nonzero(_rows(found)[:, :len(a)])
        root = _join(root, j, i + at + q)
    return root


def _within(fps: np.ndarray, bucket: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row that links to another of its bucket, with the first row it reaches by links
    inside the bucket; rows are sorted by bucket."""
    n, root = len(fps), np.arange(len(fps))
    _, first, size = np.unique(bucket, return_index=True, return_counts=True)
    few = np.repeat(size <= _FEW, size)
    rows = np.flatnonzero(few)
    if len(rows) > 1:  # small buckets, all at once: neighbours at distance 1, 2, ...
        planes, own = _planes(fps[rows]), bucket[rows]
        for by in range(1, min(_FEW, len(rows))):
            same = np.append(own[:-by] == own[by:], np.zeros(by, bool))
            if not same.any():
                break
            found = _near(planes, _shifted(planes, by), _pack(same), radius)
            hit = np.flatnonzero(_rows(found)[:len(rows)])
            root = _join(root, rows[hit], rows[hit + by])
    for x, m in zip(first[size > _FEW], size[size > _FEW]):
        part = fps[x:x + m]
        root[x:x + m] = _against(np.arange(m), part, part, 0, radius) + x
    moved = np.flatnonzero(root != np.arange(n))
    return fps[root[moved]], fps[moved]


def _across(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """The same between two chunks of one bucket."""
    both = np.concatenate([a, b])
    root = _against(np.arange(len(both)), a, b, len(a), radius)
    moved = np.flatnonzero(root != np.arange(len(both)))
    return both[root[moved]], both[moved]


def _links_out(found) -> pa.RecordBatch:
    a, b = (np.ascontiguousarray(x).view("<i8") for x in found)
    a, b = np.minimum(a, b), np.maximum(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, blocks: int | None = None, hot: int = HOT) -> DataFrame:
    """``a < b``: pairs that connect what links within ``radius`` (at most 3) connect.

    ``fps`` holds distinct fingerprints. All pairs of a bucket are compared, but a
    group of near copies gives a row per member, not per pair. ``blocks`` defaults by their number so
    that buckets stay small; the links do not depend on it.
    """
    spark = fps.sparkSession
    if blocks is None:
        n = fps.count()
        blocks = radius + (1 if n < 1 << 22 else 2 if n < 1 << 30 else 3)
    masks = _masks(list(range(64)), blocks, radius)
    keyed = _keyed(fps, masks, radius)
    sizes = keyed.groupBy("mask", "key").count()
    large = saved(sizes.where(F.col("count") > hot), "hot-buckets")
    schema, width = "a bigint, b bigint", int(spark.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches):
        """Whole buckets of one partition, sorted by bucket; a bucket may span batches."""
        rest = None
        for batch in batches:
            part = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            part = part if rest is None else np.concatenate([rest, part], axis=1)
            change = np.flatnonzero((part[1:, 1:] != part[1:, :-1]).any(0))
            cut = change[-1] + 1 if len(change) else 0
            if cut:
                yield _compared(part[:, :cut])
            rest = part[:, cut:]
        if rest is not None:
            yield _compared(rest)

    def _compared(part):
        new = np.append(True, (part[1:, 1:] != part[1:, :-1]).any(0))
        return _links_out(_within(part[0].view("<u8"), np.cumsum(new), radius))

    def by_bucket(rows):
        return rows.repartition(width, "mask", "key").sortWithinPartitions("mask", "key") \
            .mapInArrow(compare, schema)

    if not large.take(1):
        return by_bucket(keyed).distinct()
    # hot buckets: finer buckets, then chunk against chunk for those still hot
    plain = keyed.join(large, ["mask", "key"], "left_anti")
    fine = _finer(keyed.join(large, ["mask", "key"], "left_semi"), masks, radius + 1, radius)
    again = saved(fine.groupBy("mask", "key").count().where(F.col("count") > hot), "hot-buckets")
    found = by_bucket(plain.select("fp", "mask", "key").unionByName(
        fine.join(again, ["mask", "key"], "left_anti").select("fp", "mask", "key")))
    if again.take(1):
        chunks = fine.join(again, ["mask", "key"]).withColumn(
            "n", F.ceil(F.col("count") / F.lit(hot)).cast("int")) \
            .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        # a row meets every chunk of its bucket: the pair (lower chunk, higher chunk) is one group
        pairs = chunks.select("fp", "mask", "key", "c", F.explode(
            F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(
            "fp", "mask", "key", "c", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"))

        def pair(t: pa.Table) -> pa.Table:
            v, c = t.column("fp").to_numpy().view("<u8"), t.column("c").to_numpy()
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            got = _within(v, np.zeros(len(v), np.int64), radius) if i == j \
                else _across(v[c == i], v[c == j], radius)
            return pa.Table.from_batches([_links_out(got)])

        found = found.unionByName(pairs.groupBy("mask", "key", "i", "j").applyInArrow(pair, schema))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each linked node reaches.

    Alternating large-star and small-star steps on the edge table, each a
    minimum per node and a join; every round is saved, so lineage stays short.
    """
    e = saved(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        big = both.where(F.col("v") > F.col("u")).join(low, "u") \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        big = saved(big, "large-star")
        # now v < u on every row
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        small = saved(small, "small-star")
        change = small.join(e, ["u", "v"], "left_anti").take(1) or e.join(small, ["u", "v"], "left_anti").take(1)
        e = small
        if not change:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")) \
                .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _components_of(rows: DataFrame, radius: int) -> DataFrame:
    """``_fp, root, component_id`` of every distinct fingerprint of ``rows``; components whose smallest
    ``doc_id`` is the same differ by ``root``."""
    # partial aggregation leaves one row per distinct fingerprint and task
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    found = components(links(distinct.select("fp"), radius))
    linked = distinct.join(found, distinct["fp"] == found["node"], "left") \
        .select("fp", "low", F.coalesce("root", "fp").alias("root"))
    linked = saved(linked, "rooted")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    return linked.join(lowest, "root").select(F.col("fp").alias("_fp"), "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    rows = saved(fingerprints(docs, shingle), "fingerprints")
    of_print = _components_of(rows, radius)
    return rows.join(of_print, rows["fp"] == of_print["_fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component: that with the smallest ``doc_id``, of several texts with that ``doc_id`` the
    one with the smallest hash, of rows that repeat both, one. Rows without a ``doc_id`` stay."""
    keyed = docs.select(F.struct("*").alias("_row"), "doc_id", "text", text_hash().alias("_h"))
    rows = saved(fingerprints(keyed.select("doc_id", "_h", "text").where(F.col("doc_id").isNotNull()), shingle, ("doc_id", "_h")),
                 "fingerprints")
    of_print = _components_of(rows, radius)
    member = rows.join(of_print, rows["fp"] == of_print["_fp"])
    stays = member.groupBy("root").agg(F.min(F.struct("doc_id", "_h")).alias("_stay"))
    # (doc_id, text) pairs that go, and those that stay but are there more than once
    pairs = member.groupBy("root", "doc_id", "_h").count()
    judged = saved(pairs.join(stays, "root").select(
        F.col("doc_id").alias("_id"), F.col("_h").alias("_hash"), "count",
        (F.struct("doc_id", "_h") == F.col("_stay")).alias("_stays")).where(~F.col("_stays") | (F.col("count") > 1)), "copies")
    gone, twice = judged.where(~F.col("_stays")), judged.where("_stays")
    same = (keyed["doc_id"] == F.col("_id")) & (keyed["_h"] == F.col("_hash"))
    left = keyed.join(gone, same, "left_anti")
    if not twice.take(1):
        return left.select("_row.*")
    same = (left["doc_id"] == F.col("_id")) & (left["_h"] == F.col("_hash"))
    once = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "_h"])
    return left.join(twice, same, "left_anti").unionByName(once).select("_row.*")
