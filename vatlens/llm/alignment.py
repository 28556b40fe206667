"""Alignment of the tokens of two tokenizers over the same bytes, by pointer jumping.

A is a byte-level tokenizer of the tokenizers library, B a piece vocabulary of the
sentencepiece library. Both see a space before the text. Tokens whose byte ranges
overlap belong to one group; groups end where a token of A and one of B both end.

Every token points to the farthest-right token that overlaps it; where an A and a B
token end together, the B token points to itself. Replacing each pointer by its
pointer's pointer, for all tokens at once, doubles the way covered, so after log2 of
the longest chain every token points to the last token of its component, its label.

Both tokenizers begin a token at a space that follows a character other than white
space, so a text is cut there into units, the tokens and groups of a unit are its own,
and a task works on each distinct unit once. ``SLICE`` bytes of text form a block.

Counts over the corpus: a block gives each of its distinct id pairs once, with the
number of its documents that link it; Spark sums them, takes the highest sum of each
A id (one row per id of A, at most the vocabulary) and hands every block the sums of
its own pairs. Nothing of the size of the corpus meets in one task, and a pair that
all documents hold is one row per block.

Defined results: texts that are null, empty, or that A or B do not spell byte for byte
(B reads U+2581 as a space) have no tokens: zeros and an empty ``groups_sha256``, and
count for no pair. Repeated rows are documents of their own. Other columns are not read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vatlens.llm.common import _slices, field, saved

#: Size of the units whose results a task keeps, in characters, 16 more a unit.
CACHE = 8_000_000
#: Units that the tokenizers get at a time.
BATCH = 40_000
#: Before the first id of a unit, an id of the same side, the B side, the next group.
SIGNS = np.array(["", ",", "|", ";"], object)


def _content(spark, path: str) -> bytes:
    """A path with a scheme is read by Spark, any other on the driver."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable Latin-1 signs stand for
    themselves, the other bytes in order for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places ``starts[k] .. starts[k] + counts[k] - 1`` of all k in one array."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def distinct(v: np.ndarray) -> np.ndarray:
    v = np.sort(v)
    return v[np.append(True, v[1:] != v[:-1])] if len(v) else v


def labels(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ends of A and B tokens over the same bytes (strictly ascending, the last equal): the label
    of each A and each B token, which is the place of the B token that ends its group."""
    to_b = np.searchsorted(b_end, a_end - 1, side="right")
    to_a = np.searchsorted(a_end, b_end - 1, side="right")
    n = len(a_end)
    last = a_end[to_a] == b_end
    point = np.concatenate([to_b + n, np.where(last, np.arange(len(b_end)) + n, to_a)])
    while True:
        far = point[point]
        if np.array_equal(far, point):
            return far[:n] - n, far[n:] - n
        point = far


class Aligner:
    """Records of units, kept between blocks: token counts, group text and linked id pairs."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        vocabulary = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [bytes(letters[c] for c in vocabulary[i]) if i in vocabulary and all(c in letters for c in vocabulary[i])
                        else vocabulary.get(i, "").encode() for i in range(max(vocabulary) + 1)]
        self.width = self.b.get_piece_size()
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.width)))]
        self.a_len = np.array([len(x) for x in self.a_bytes])
        self.b_len = np.array([len(x) for x in self.b_bytes])
        self.lone = [self.b.piece_to_id("\u2581")]
        self.digits = np.array([str(i) for i in range(max(self.width, len(self.a_bytes)))], object)
        self.places = np.array([len(x) for x in self.digits])
        self.cut = re.compile(r"(?<=\S) ").split
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.size = 0
        self.good, self.n_a, self.n_b = np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.n_groups, self.n_links, self.first = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text: list[str] = []
        self.pair = np.zeros(0, np.int64)

    def learn(self, units: list[str]) -> None:
        """Align ``units`` (the space before each left out) that are not known yet, ``BATCH`` at a time."""
        for at in range(0, len(units), BATCH):
            self._learn(units[at:at + BATCH])

    def _learn(self, units: list[str]) -> None:
        ids_a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        ids_b = self.b.encode(units, num_threads=1)
        for k, u in enumerate(units):
            if not u:
                ids_b[k] = self.lone  # the library adds no space to an empty text
        want = (" " + " ".join(units)).encode()
        good = np.ones(len(units), bool)
        if any(b"".join(map(spell.__getitem__, chain.from_iterable(ids))) != want
               for spell, ids in ((self.a_bytes, ids_a), (self.b_bytes, ids_b))):
            for k, u in enumerate(units):
                want = (" " + u).encode()
                good[k] = b"".join(map(self.a_bytes.__getitem__, ids_a[k])) == want \
                    and b"".join(map(self.b_bytes.__getitem__, ids_b[k])) == want
                if not good[k]:
                    ids_a[k] = ids_b[k] = []
        n_a = np.fromiter(map(len, ids_a), np.int64, len(units))
        n_b = np.fromiter(map(len, ids_b), np.int64, len(units))
        a = np.fromiter(chain.from_iterable(ids_a), np.int64, n_a.sum())
        b = np.fromiter(chain.from_iterable(ids_b), np.int64, n_b.sum())
        unit_a, unit_b = np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)
        text = [""] * len(units)
        n_groups, n_links = np.zeros((2, len(units)), np.int64)
        pair = np.zeros(0, np.int64)
        if len(a):
            a_end, b_end = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
            label_a, label_b = labels(a_end, b_end)
            n_groups = np.bincount(unit_b[label_b == np.arange(len(b))], minlength=len(units))
            low = np.searchsorted(b_end, a_end - self.a_len[a], side="right")
            many = np.searchsorted(b_end, a_end - 1, side="right") - low + 1
            pair = np.repeat(a, many) * self.width + b[ragged(low, many)]
            n_links = np.bincount(unit_a, weights=many, minlength=len(units)).astype(np.int64)
            # group by group, A before B: a sign before each id, none before a unit's first
            side = np.concatenate([label_a * 2, label_b * 2 + 1])
            order = np.argsort(side, kind="stable")
            side, unit, ids = side[order], np.concatenate([unit_a, unit_b])[order], np.concatenate([a, b])[order]
            step, begin = np.diff(side, prepend=-2), np.diff(unit, prepend=-1) > 0
            sign = np.where(begin, 0, np.where(step == 0, 1, np.where(side % 2 == 1, 2, 3)))
            every = "".join((SIGNS[sign] + self.digits[ids]).tolist())
            ends = np.append(0, np.cumsum(np.bincount(unit, weights=self.places[ids] + (sign > 0), minlength=len(units))))
            ends = ends.astype(np.int64).tolist()
            text = [every[x:y] for x, y in zip(ends, ends[1:])]
        self.known.update(zip(units, range(len(self.text), len(self.text) + len(units))))
        self.text += text
        self.first = np.concatenate([self.first, len(self.pair) + np.cumsum(n_links) - n_links])
        self.pair = np.concatenate([self.pair, pair])
        self.good, self.n_a = np.concatenate([self.good, good]), np.concatenate([self.n_a, n_a])
        self.n_b, self.n_groups = np.concatenate([self.n_b, n_b]), np.concatenate([self.n_groups, n_groups])
        self.n_links = np.concatenate([self.n_links, n_links])

    def block(self, texts: list) -> tuple[dict, dict]:
        """Columns of the documents of a block, and the block's own row."""
        number = Numbers()
        local = [np.fromiter(map(number.__getitem__, self.cut(t)), np.int32) if t else np.zeros(0, np.int32) for t in texts]
        new = [u for u in number if u not in self.known]
        size = sum(map(len, new)) + 16 * len(new)
        if self.known and self.size + size > CACHE:
            self.clear()
            new = list(number)
            size = sum(map(len, new)) + 16 * len(new)
        self.size += size
        self.learn(new)
        used = np.fromiter(map(self.known.__getitem__, number), np.int64, len(number))
        bad = np.array([not self.good[used[x]].all() for x in local])
        digests = ["" if odd or not len(x) else
                   sha256(";".join(map(self.text.__getitem__, used[x].tolist())).encode()).hexdigest() for x, odd in zip(local, bad)]
        local = [x[:0] if odd else x for x, odd in zip(local, bad)]
        n = np.fromiter(map(len, local), np.int64, len(local))
        unit, doc = np.concatenate(local), np.repeat(np.arange(len(texts)), n)
        sums = [np.bincount(doc, weights=v[used][unit], minlength=len(texts)).astype(np.int64)
                for v in (self.n_a, self.n_b, self.n_groups, self.n_links)]
        many = self.n_links[used]
        keys, links = np.unique(self.pair[ragged(self.first[used], many)], return_inverse=True)
        first = np.cumsum(many) - many
        # how many documents hold each pair: distinct units of a document, then distinct pairs
        d, u = np.divmod(distinct(doc * max(len(used), 1) + unit), max(len(used), 1))
        held = distinct(np.repeat(d, many[u]) * max(len(keys), 1) + links[ragged(first[u], many[u])])
        holders = np.bincount(held % max(len(keys), 1), minlength=len(keys))
        docs = {"n_a": sums[0], "n_b": sums[1], "n_groups": sums[2], "n_links": sums[3], "groups_sha256": digests,
                "_units": pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), unit)}
        return docs, {"_keys": keys, "_held": holders, "_many": many.astype(np.int32), "_links": links.astype(np.int32)}


class Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = at = len(self)
        return at


_ARRAYS = {"_keys": pa.list_(pa.int64()), "_held": pa.list_(pa.int64()),
           "_many": pa.list_(pa.int32()), "_links": pa.list_(pa.int32())}
_DOC = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups_sha256": "string",
        "_units": "array<int>"}
_BLOCK = {"_keys": "array<bigint>", "_held": "array<bigint>", "_many": "array<int>", "_links": "array<int>",
          "_block": "bigint"}


def blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document and one for each block (``_keys`` not null), both with ``_block``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((_content(spark, a_path), _content(spark, b_path)))
    # a block's own row has no doc_id
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType),
                           *[field(c, t) for c, t in (_DOC | _BLOCK).items()]])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for b in _slices(batch, batch.column(1)):
                rows, own = aligner.block(b.column(1).to_pylist())
                n = b.num_rows
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *[v if isinstance(v, pa.Array) else pa.array(v) for v in rows.values()],
                     *[pa.nulls(n, t) for t in _ARRAYS.values()], pa.array(np.full(n, number, np.int64))], names=names)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, b.column(0).type), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()),
                     pa.nulls(1, pa.list_(pa.int32())),
                     *[pa.array([own[k]], t) for k, t in _ARRAYS.items()], pa.array([number], pa.int64())], names=names)
                number += 1

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """``_key`` (A id * ``width`` + B id), ``count`` of documents, ``best``: no pair of the A id has more."""
    pairs = rows.where(F.col("_keys").isNotNull()).select(F.explode(F.arrays_zip("_keys", "_held")).alias("p"))
    counts = saved(pairs.groupBy(F.col("p._keys").alias("_key")).agg(F.sum("p._held").alias("count")), "pair-counts")
    a = F.floor(F.col("_key") / F.lit(width)).cast("bigint").alias("_a")
    # one row per id of A, at most its vocabulary
    top = F.broadcast(counts.groupBy(a).agg(F.max("count").alias("_top")))
    return counts.withColumn("_a", a).join(top, "_a").select("_key", "count", (F.col("count") == F.col("_top")).alias("best"))


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``."""
    import sentencepiece
    spark = docs.sparkSession
    width = sentencepiece.SentencePieceProcessor(model_proto=_content(spark, b_path)).get_piece_size()
    rows = saved(blocks(docs, a_path, b_path), "alignment-blocks")
    own = rows.where(F.col("_keys").isNotNull()).select(F.col("_block").alias("_of"), F.posexplode("_keys").alias("_at", "_key"))
    sums = own.join(pair_counts(rows, width), "_key").select("_of", "_at", "count", "best")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = T.StructType([rows.schema["doc_id"], *[field(c, "bigint") for c in
                                                 ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
                        field("groups_sha256", "string")])

    def finish(block: pa.Table, known: pa.Table) -> pa.Table:
        is_own = block.column("_many").is_valid().to_numpy()
        at = int(np.flatnonzero(is_own)[0])
        many = block.column("_many")[at].values.to_numpy(zero_copy_only=False)
        links = block.column("_links")[at].values.to_numpy(zero_copy_only=False)
        place = known.column("_at").to_numpy()
        pair = np.zeros((2, len(place)), np.int64)
        pair[0][place], pair[1][place] = known.column("best").to_numpy().astype(np.int64), known.column("count").to_numpy()
        ends = np.cumsum(many)
        rest = block.filter(pa.array(~is_own))
        units = rest.column("_units").combine_chunks()
        unit = units.flatten().to_numpy(zero_copy_only=False)
        stop = np.append(0, np.cumsum(np.diff(units.offsets.to_numpy())))
        total = []
        for v in pair:
            run = np.append(0, np.cumsum(v[links]))
            of_unit = run[ends] - run[ends - many]
            run = np.append(0, np.cumsum(of_unit[unit]))
            total.append(pa.array(run[stop[1:]] - run[stop[:-1]], pa.int64()))
        return pa.table([rest.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
                        + total + [rest.column("groups_sha256")], names=names)

    left = rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_units", "_many", "_links", "_block")
    return left.groupBy("_block").cogroup(sums.groupBy("_of")).applyInArrow(finish, out)
