"""Exact substring dedup with a sparse, range-partitioned suffix array.

Removed is each byte covered by a ``LENGTH``-byte string that also starts in a
document with a smaller doc_id. Sorting a suffix for every byte would shuffle
many times the input, so only anchored suffixes are sorted: of the ``GRAM``-byte
grams of each window of ``LENGTH`` bytes the one with the smallest hash is its anchor,
equal windows have equal anchors, and neighbouring windows mostly share one. The
windows of an anchor form a segment.

1. Documents are packed into compressed blocks, saved once.
2. Every block sends its distinct segments, dealt by sampled splitters on (leading
   bytes of the anchored suffix, hash of the segment's bytes). A bucket sorts them
   digit by digit (8 bytes at a time) and compares neighbours: of equal segments all
   but those of the smallest doc_id are removed whole. Where one anchor has
   different segments, the first of each is undecided; an anchor that equals a
   splitter goes on in the next bucket and counts as having several.
3. Undecided segments are sent with their bytes and compared window by window
   per anchor. Anchors with over ``HOT`` of them (a line that very many documents
   share, at its rims) are decided by an aggregation over window hashes instead,
   which Spark pre-aggregates and splits.
4. Each block puts together what it was told and cuts its documents.

Equality of segments and windows is that of two independent 64-bit hashes or of
a 64-bit hash and the 16 leading bytes.

Blocks send an equal segment once, so copies do not add up in a bucket. No step
depends on the order of rows, and every intermediate table is saved.

Defined results: null is an empty text; a text under ``LENGTH`` bytes loses
nothing; rows with a null doc_id neither lose bytes nor cost others any; rows that
share a doc_id do not cost each other; empty tables give no rows. ``doc_id`` is an integer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vatlens.llm.common import saved

LENGTH, GRAM, HOT = 50, 16, 20_000
#: Bytes of a block, and of the texts whose segments one bucket compares.
BLOCK, BUCKET = 2_000_000, 8_000_000
#: Most stretches between splitters, which are broadcast (24 bytes each); beyond, a stretch is several buckets.
STRETCHES = 32_768
#: Sampled keys of a stretch, and the segments of a sampled block of which one is taken.
KEYS, SAMPLED = 20, 199
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x2545F4914F6CDD1D, 0xC2B2AE3D27D4EB4F))
_NONE = -(1 << 63)  # a null doc_id in a block
FULL, OPEN, HOT_OPEN = 1, 2, 4


def _zip(*columns: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unzip(blob: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(blob)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(32))


def _eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as a number."""
    out = np.empty(max(len(raw) - 7, 0), "<u8")
    for r in range(min(8, len(out))):
        part = out[r::8]
        part[:] = raw[r:r + 8 * len(part)].view("<u8")
    return out


def _grams(raw: np.ndarray) -> np.ndarray:
    a = _eights(raw)
    return _mix(a[:-8] * _A ^ _mix(a[8:]))


class _Sums:
    """Hashes of byte ranges from prefix sums of gram hashes."""

    def __init__(self, grams: np.ndarray, factor: np.uint64):
        n = len(grams)
        inverse = np.uint64(pow(int(factor), -1, 1 << 64))
        powers = np.cumprod(np.r_[np.uint64(1), np.full(max(n - 1, 0), factor)])[:n]
        self.sums = np.r_[np.uint64(0), np.cumsum(grams * powers, dtype=np.uint64)]
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes ``start`` to ``end`` (at least ``GRAM``)."""
        size = (end - start).astype(np.uint64)
        return _mix((self.sums[end - GRAM + 1] - self.sums[start]) * self.back[start] ^ (size * _D))


def _minima(grams: np.ndarray) -> np.ndarray:
    """Smallest gram hash of the window at each place."""
    wide, m, s = LENGTH - GRAM + 1, grams, 1
    while 2 * s <= wide:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    return np.minimum(m[:len(m) - (wide - s)], m[wide - s:]) if wide > s else m


class Block:
    """The texts of a block and their segments."""

    def __init__(self, ids, sizes, data: bytes):
        self.ids = np.array([_NONE if x is None else x for x in ids], np.int64)
        self.sizes = np.asarray(sizes, np.int64)
        self.ends = np.cumsum(self.sizes)
        self.raw = np.frombuffer(_unzip(data), np.uint8)
        n = len(self.raw) - LENGTH + 1
        self.first = self.last = self.doc = np.zeros(0, np.int64)
        if n < 1:
            return
        self.grams = _grams(self.raw)
        least = _minima(self.grams)[:n]
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[:n]
        at = np.flatnonzero((np.arange(n) + LENGTH <= self.ends[doc]) & (self.ids[doc] != _NONE))
        if not len(at):
            return
        v = least[at]
        new = np.r_[True, (v[1:] != v[:-1]) | (at[1:] != at[:-1] + 1) | (doc[at[1:]] != doc[at[:-1]])]
        start = np.flatnonzero(new)
        self.first, self.last = at[start], at[np.r_[start[1:], len(at)] - 1]
        self.value, self.doc = v[start], self.ids[doc[self.first]]
        self.sums = _Sums(self.grams, _C)
        self.whole = self.sums.of(self.first, self.last + LENGTH)
        # of equal segments the first of the smallest doc_id stands for all
        order = np.lexsort((np.arange(len(start)), self.doc, self.whole, self.value))
        lead = np.r_[True, (self.whole[order][1:] != self.whole[order][:-1])
                     | (self.value[order][1:] != self.value[order][:-1])]
        self.stands = np.empty(len(start), np.int64)
        self.stands[order] = order[np.flatnonzero(lead)][np.cumsum(lead) - 1]

    def anchors(self, segments: np.ndarray) -> np.ndarray:
        """Place of the first gram with the smallest hash in the first window."""
        out = np.empty(len(segments), np.int64)
        for a in range(0, len(segments), 100_000):
            f, v = self.first[segments[a:a + 100_000]], self.value[segments[a:a + 100_000]]
            out[a:a + 100_000] = f + np.argmax(
                self.grams[f[:, None] + np.arange(LENGTH - GRAM + 1)] == v[:, None], axis=1)
        return out

    def leads(self, segments: np.ndarray) -> np.ndarray:
        """The leading ``GRAM`` bytes of the anchored suffixes, one row each."""
        return self.raw[self.anchors(segments)[:, None] + np.arange(GRAM)]


def _blocks(rows: DataFrame) -> DataFrame:
    """``block, ids, sizes, data``: documents packed into compressed blocks."""
    def run(batches):
        part, k = TaskContext.get().partitionId(), 0
        ids, texts, size = [], [], 0

        def packed():
            return pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k]), pa.array([ids], pa.list_(pa.int64())),
                 pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
                 pa.array([_zip(np.frombuffer(b"".join(texts), np.uint8))], pa.binary())],
                names=["block", "ids", "sizes", "data"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(i)
                texts.append((t or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= BLOCK:
                    yield packed()
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield packed()

    return rows.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "block bigint, ids array<bigint>, sizes array<bigint>, data binary")


def _each_block(batches):
    for b in batches:
        for i in range(b.num_rows):
            row = [c[i].as_py() for c in b.columns]
            yield row[0], Block(row[1], row[2], row[3]), row


def _digits(leads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading bytes as two numbers in the order of the bytes."""
    both = np.ascontiguousarray(leads).view(">u8").astype(np.uint64)
    return both[:, 0], both[:, 1]


def _keys(leads: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Sort keys of segments: leading bytes, then the hash."""
    return np.ascontiguousarray(np.hstack([leads, whole.astype(">u8").view(np.uint8).reshape(-1, 8)])) \
        .view(f"S{GRAM + 8}").ravel()


def _buckets(total: int) -> tuple[int, int]:
    """Stretches between splitters, and buckets that each is dealt to by a hash of the anchor."""
    wanted = max(8, -(-total // BUCKET))
    stretches = min(wanted, STRETCHES)
    return stretches, -(-wanted // stretches)


def _splitters(blocks: DataFrame, total: int) -> np.ndarray:
    """Sort keys that cut the segments into about equal stretches, from a sample in proportion to their number."""
    stretches, _ = _buckets(total)
    # blocks whose segments are sampled: 100 MB of text, or what gives ``KEYS`` keys a stretch
    wanted = max(100_000_000, stretches * KEYS * SAMPLED * LENGTH)
    every = max(1, total // wanted)

    def run(batches):
        for _, b, _ in _each_block(batches):
            pick = np.unique(b.stands)[::SAMPLED] if len(b.first) else b.first
            if len(pick):
                keys = _keys(b.leads(pick), b.whole[pick])
                yield pa.RecordBatch.from_arrays([pa.array([x.ljust(GRAM + 8, b"\0") for x in keys.tolist()])], names=["key"])

    keys = blocks.where(F.pmod(F.xxhash64("block"), F.lit(every)) == 0).mapInArrow(run, "key binary")
    # a few keys for each of a bounded number of stretches
    found = sorted(bytes(r["key"]) for r in keys.collect())
    cuts = [found[len(found) * i // stretches] for i in range(1, stretches)] if len(found) >= stretches else found
    return np.array(sorted(set(cuts)), f"S{GRAM + 8}")


def _dealt(stretch: np.ndarray, leads: np.ndarray, share: int) -> np.ndarray:
    """Bucket of segments: equal anchors of a stretch stay together."""
    if share == 1:
        return stretch
    high, low = _digits(leads)
    return stretch * share + (_mix(high ^ _mix(low)) % np.uint64(share)).astype(np.int64)


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0)


def _entries(blocks: DataFrame, splitters, share: int) -> DataFrame:
    """``bucket, block, n, blob``: the distinct segments of each block."""
    def run(batches):
        cuts = splitters.value
        for block, b, _ in _each_block(batches):
            if not len(b.first):
                continue
            own = np.unique(b.stands)
            leads = b.leads(own)
            bucket = _dealt(np.searchsorted(cuts, _keys(leads, b.whole[own]), side="right"), leads, share)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            parts = np.split(order, cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[p[0]]) for p in parts], pa.int32()), pa.array([block] * len(parts)),
                 pa.array([len(p) for p in parts], pa.int32()),
                 pa.array([_zip(leads[p], b.whole[own[p]], _deltas(b.doc[own[p]]), _deltas(own[p])) for p in parts],
                          pa.binary())], names=["bucket", "block", "n", "blob"])

    return blocks.mapInArrow(run, "bucket int, block bigint, n int, blob binary")


def _told(block: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """``block, blob``: one row for each block with its rows of ``columns``."""
    order = np.argsort(block, kind="stable")
    cut = np.flatnonzero(np.diff(block[order])) + 1
    parts = [p for p in np.split(order, cut) if len(p)]
    return pa.table({"block": pa.array([int(block[p[0]]) for p in parts], pa.int64()),
                     "hot": pa.array([bool((columns[-1][p] == HOT_OPEN).any()) for p in parts], pa.bool_()),
                     "open": pa.array([bool((columns[-1][p] == OPEN).any()) for p in parts], pa.bool_()),
                     "blob": pa.array([_zip(*[c[p] for c in columns]) for p in parts], pa.binary())})


def _compare(splitters):
    """Sorts the segments of a bucket and says which are removed and which undecided."""
    def run(t: pa.Table) -> pa.Table:
        leads, whole, doc, own, block = [], [], [], [], []
        for b, n, blob in zip(*[t.column(c).to_pylist() for c in ("block", "n", "blob")]):
            raw = _unzip(blob)
            leads.append(np.frombuffer(raw, np.uint8, GRAM * n).reshape(n, GRAM))
            rest = np.frombuffer(raw, "<i8", 3 * n, GRAM * n).reshape(3, n)
            whole.append(rest[0].view("<u8"))
            doc.append(np.cumsum(rest[1]))
            own.append(np.cumsum(rest[2]))
            block.append(np.full(n, b))
        leads, whole, doc, own, block = map(np.concatenate, (leads, whole, doc, own, block))
        high, low = _digits(leads)
        order = np.lexsort((doc, whole, low, high))
        high, low, whole, doc = high[order], low[order], whole[order], doc[order]
        anchor = np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]
        equal = anchor | np.r_[True, whole[1:] != whole[:-1]]
        start = np.flatnonzero(anchor)
        first = doc[np.flatnonzero(equal)][np.cumsum(equal) - 1]
        removed = doc > first
        which = np.cumsum(anchor) - 1
        kinds = np.bincount(which[equal], minlength=len(start))  # different segments of an anchor
        several = (kinds > 1) & (np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start))
        # an anchor that a splitter cut through goes on in another bucket
        cuts = np.unique(splitters.value.astype(f"S{GRAM}"))
        names = np.ascontiguousarray(leads[order][start]).view(f"S{GRAM}").ravel()
        cut = np.isin(names, cuts)
        flag = np.where(removed, FULL, np.where(
            equal & (several | cut)[which],  # the first of equal segments has the smallest doc_id
            np.where((kinds > HOT)[which] | cut[which], HOT_OPEN, OPEN), 0)).astype(np.int64)
        say = flag > 0
        return _told(block[order][say], own[order][say], flag[say])

    return run


def _open_windows(b: Block, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the segments: the segment and the place of each."""
    count = b.last[segments] - b.first[segments] + 1
    which = np.repeat(np.arange(len(segments)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return segments[which], b.first[segments][which] + step


def _flags(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Segments and flags of a block from what buckets told it."""
    parts = [np.frombuffer(_unzip(x), "<i8").reshape(2, -1) for x in blobs or []]
    both = np.concatenate([np.zeros((2, 0), np.int64), *parts], axis=1)
    return both[0], both[1]


def _open_entries(rows: DataFrame, splitters, share: int) -> DataFrame:
    """``bucket, block, n, blob``: undecided segments with their bytes, dealt by anchor."""
    def run(batches):
        cuts = np.unique(splitters.value.astype(f"S{GRAM}"))
        for block, b, row in _each_block(batches):
            own, flag = _flags(row[4])
            own = np.sort(own[flag == OPEN])
            if not len(own):
                continue
            leads = b.leads(own)
            bucket = _dealt(np.searchsorted(cuts, np.ascontiguousarray(leads).view(f"S{GRAM}").ravel(), side="right"), leads, share)
            for k in np.unique(bucket):
                s = own[bucket == k]
                size = b.last[s] + LENGTH - b.first[s]
                text = b"".join(b.raw[x:x + m].tobytes() for x, m in zip(b.first[s], size))
                blob = _zip(_deltas(s), _deltas(b.doc[s]), size, np.frombuffer(text, np.uint8))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(k)], pa.int32()), pa.array([block]), pa.array([len(s)], pa.int32()),
                     pa.array([blob], pa.binary())], names=["bucket", "block", "n", "blob"])

    return rows.mapInArrow(run, "bucket int, block bigint, n int, blob binary")


def _compare_windows(t: pa.Table) -> pa.Table:
    """Windows of undecided segments that a document with a smaller doc_id has too."""
    own, doc, size, text, block = [], [], [], [], []
    for b, n, blob in zip(*[t.column(c).to_pylist() for c in ("block", "n", "blob")]):
        raw = _unzip(blob)
        head = np.frombuffer(raw, "<i8", 3 * n).reshape(3, n)
        own.append(np.cumsum(head[0]))
        doc.append(np.cumsum(head[1]))
        size.append(head[2])
        text.append(np.frombuffer(raw, np.uint8, -1, 24 * n))
        block.append(np.full(n, b))
    own, doc, size, text, block = map(np.concatenate, (own, doc, size, text, block))
    grams = _grams(text)
    one, two = _Sums(grams, _C), _Sums(grams, _A)
    begin = np.cumsum(size) - size
    count = size - LENGTH + 1
    which = np.repeat(np.arange(len(own)), count)
    step = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    place = begin[which] + step
    a, b = one.of(place, place + LENGTH), two.of(place, place + LENGTH)
    order = np.lexsort((doc[which], b, a))
    a, b, d = a[order], b[order], doc[which][order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    hit = order[d > d[np.flatnonzero(new)][np.cumsum(new) - 1]]
    return _told(block[which[hit]], own[which[hit]], step[hit]).select(["block", "blob"])


def _hot_windows(rows: DataFrame) -> DataFrame:
    """``a, b, doc, block, own, step``: windows of undecided segments of hot anchors, once a block and document."""
    def run(batches):
        for block, x, row in _each_block(batches):
            own, flag = _flags(row[4])
            own = np.sort(own[flag == HOT_OPEN])
            if len(own):
                seg, place = _open_windows(x, own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.of(place, place + LENGTH).view(np.int64)) for s in (x.sums, _Sums(x.grams, _A))]
                    + [pa.array(x.doc[seg]), pa.array(np.full(len(seg), block)), pa.array(seg),
                       pa.array(place - x.first[seg])], names=["a", "b", "doc", "block", "own", "step"])

    return rows.mapInArrow(run, "a bigint, b bigint, doc bigint, block bigint, own bigint, step bigint")


def _cut(rows: DataFrame) -> DataFrame:
    """The documents of each block without what was found."""
    def run(batches):
        for _, b, row in _each_block(batches):
            n = len(b.raw)
            edge = np.zeros(n + 1, np.int32)
            if len(b.first):
                own, flag = _flags(row[4])
                full = np.zeros(len(b.first), bool)
                full[own[flag == FULL]] = True
                # equal segments of the block: those of a larger doc_id go whole, those of the same one alike
                full = full[b.stands] | (b.doc > b.doc[b.stands])
                np.add.at(edge, b.first[full], 1)
                np.add.at(edge, b.last[full] + LENGTH, -1)
                seg, step = (np.concatenate(x) for x in zip(_flags(row[5]), _flags(row[6])))
                if len(seg):
                    # a told segment stands for the equal ones of its document
                    order = np.argsort(b.stands, kind="stable")
                    left = np.searchsorted(b.stands[order], seg, side="left")
                    right = np.searchsorted(b.stands[order], seg, side="right")
                    times = right - left
                    member = order[np.repeat(left, times) + np.arange(times.sum())
                                   - np.repeat(np.cumsum(times) - times, times)]
                    place = b.first[member] + np.repeat(step, times)
                    np.add.at(edge, place, 1)
                    np.add.at(edge, place + LENGTH, -1)
            gone = np.cumsum(edge[:n]) > 0
            begin = b.ends - b.sizes
            starts, ends, kept = [], [], []
            for x, y in zip(begin.tolist(), b.ends.tolist()):
                g = gone[x:y]
                if g.any():
                    turn = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
                    starts.append(turn[::2])
                    ends.append(turn[1::2])
                    kept.append(b.raw[x:y][~g].tobytes())
                else:
                    starts.append([])
                    ends.append([])
                    kept.append(b.raw[x:y].tobytes())
            for a in range(0, len(kept), 500):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if i == _NONE else int(i) for i in b.ids[a:a + 500]], pa.int64()),
                     pa.array(b.sizes[a:a + 500]), pa.array(starts[a:a + 500], pa.list_(pa.int64())),
                     pa.array(ends[a:a + 500], pa.list_(pa.int64())), pa.array(kept[a:a + 500], pa.binary())],
                    names=["doc_id", "n_bytes", "starts", "ends", "kept"])

    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, kept binary")


def _per_block(told: DataFrame, name: str, *more) -> DataFrame:
    """What each block was told, as one list; it is bounded by the block."""
    return told.groupBy("block").agg(F.collect_list("blob").alias(name), *more)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, starts, ends, kept`` for every row of ``docs``: the maximal removed
    runs (byte places, end exclusive) and the remaining bytes."""
    spark = docs.sparkSession
    blocks = saved(_blocks(docs), "blocks")
    total = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()[0] or 0
    share = _buckets(total)[1]
    cuts = spark.sparkContext.broadcast(_splitters(blocks, total))
    answer = "block bigint, hot boolean, open boolean, blob binary"
    told = saved(_entries(blocks, cuts, share).groupBy("bucket").applyInArrow(_compare(cuts), answer), "told")
    per_block = saved(_per_block(told, "flags", F.max("open").alias("open"), F.max("hot").alias("hot")), "flags")
    flagged = blocks.join(per_block, "block")
    windows = saved(_open_entries(flagged.where("open"), cuts, share).groupBy("bucket")
                    .applyInArrow(_compare_windows, "block bigint, blob binary"), "windows")
    late = spark.createDataFrame([], "block bigint, late array<binary>")
    if per_block.where("hot").take(1):
        rows = saved(_hot_windows(flagged.where("hot")), "hot-windows")
        first = rows.groupBy("a", "b").agg(F.min("doc").alias("first"), F.max("doc").alias("other")) \
            .where("first < other").select("a", "b", "first")
        gone = rows.join(first, ["a", "b"]).where("doc > first").select("block", "own", "step").distinct()
        late = gone.groupBy("block").agg(F.collect_list(F.struct("own", "step")).alias("_p")) \
            .select("block", F.col("_p.own").alias("own"), F.col("_p.step").alias("step"))
        late = saved(late.mapInArrow(_zipped, "block bigint, late array<binary>"), "late")
    joined = blocks.join(per_block.select("block", "flags"), "block", "left").join(_per_block(windows, "found"), "block", "left") \
        .join(late, "block", "left").select("block", "ids", "sizes", "data", "flags", "found", "late")
    return _cut(joined)


def _zipped(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([[_zip(np.array(o, np.int64), np.array(s, np.int64))] for o, s in
                                    zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.list_(pa.binary()))],
            names=["block", "late"])


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    return deduplicated(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("bigint").alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
