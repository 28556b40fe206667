"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one on ordinary and one on
toxic texts. Both hold the ordinary words at the same distances, so a window of ordinary
words costs the same under both; the toxic one holds the toxic stretches as well, between
the rare and the common words. A text is cut into overlapping windows, each window is
compressed with either dictionary, and the bytes that the toxic dictionary saves, as a
mean over the windows, are the distance. Isotonic regression on labelled rows that no
dictionary saw turns it into a score.

Training: a byte gram or a pair of neighbouring words is telling if it is in more texts of
the toxic class than chance explains (likelihood ratio of ``EVIDENCE``, at least ``MIN_TEXTS``
texts and ``MIN_SHARE`` of the class), and if it is ``RATIO`` times as dense there. Density is
its share of a text's words, averaged over texts, so a long text or one that repeats itself
counts once, and what long ordinary texts hold here and there does not hide it. The toxic
dictionary holds the words of toxic texts with a telling gram and the telling pairs, by
frequency; the ordinary one leaves those words out. The fit uses a documented, bounded
sample of labelled rows (``TOXIC_ROWS``, ``ORDINARY_ROWS``, drawn by a hash of doc_id) and
dictionaries of a set size; scoring is over every whole text.

Defined results: null is an empty text; a text without words scores as the
smallest distance; a doc_id labelled more than once is toxic if any row says so;
null labels are not learned from; without both classes to learn from every
score is the share of toxic labels (0 without labels); repeated rows each get
their row; words longer than ``PIECE`` bytes are cut into pieces; a score of 0.5 is toxic.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vatlens.llm.common import field, held_out, isotonic, labels_of, map_texts, remainder, saved, small

WINDOW, STEP = 6, 3
GRAM, RATIO, EVIDENCE, MIN_TEXTS, MIN_SHARE = 5, 10.0, 15.0, 5, 0.01
TOXIC_ROWS, ORDINARY_ROWS = 4_000, 12_000
#: Entries of the dictionaries; the last ``COMMON`` of the ordinary words come after the toxic part.
TOXIC_WORDS, ORDINARY_WORDS, COMMON = 4_000, 60_000, 5_000
#: Density is counted in millionths of a text's words; this much is added to the ordinary side.
_UNIT, _FLOOR = 1_000_000, 1_000
#: Different keys that a task adds up at a time.
HELD = 300_000
PIECE, LEVEL = 64, 6
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _words(text) -> list[bytes]:
    words = text.encode().translate(_LOWER).split() if text else []
    if any(len(w) > PIECE for w in words):
        words = [w[i:i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def _shingle(text) -> int:
    """Smallest hash of four consecutive words."""
    import xxhash
    words = _words(text)
    return min(xxhash.xxh64_intdigest(b" ".join(words[i:i + 4])) for i in range(max(1, len(words) - 3))) - (1 << 63)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, label, rate, fold``: the bounded training sample; ``rate`` is the
    sampled share of its class, fold 1 is kept for the calibration."""
    learn = saved(labels_of(labels, "toxic").where(remainder(5) != 0), "labels")
    counts = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    rate = {0: min(1.0, ORDINARY_ROWS / max(counts.get(0, 0), 1)), 1: min(1.0, TOXIC_ROWS / max(counts.get(1, 0), 1))}
    share = F.when(F.col("label") == 1, rate[1]).otherwise(rate[0])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    ids = saved(learn.withColumn("rate", share).where(place < F.col("rate"))
                .withColumn("fold", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(10)) < 3).cast("int")), "sample-ids")
    rows = docs.select("doc_id", "text").join(small(ids), "doc_id")
    # a group of copies says what one text says: of rows with the same smallest shingle hash and
    # label the lowest doc_id is learned from
    keyed = map_texts(rows, ["doc_id", "text", "label", "rate", "fold"], [field("key", "bigint")],
                      lambda: lambda texts: [[_shingle(t) for t in texts]])
    pick = keyed.groupBy("label", "key").agg(F.min(F.struct("doc_id", "text", "rate", "fold")).alias("_r"))
    return saved(pick.select("_r.doc_id", "_r.text", "label", "_r.rate", "_r.fold"), "sample")


_COUNTS = "key binary, ordinary bigint, toxic bigint, ordinary_rate bigint, toxic_rate bigint"


def _counts(rows: DataFrame, of) -> DataFrame:
    """Texts of either class that hold a key, and the sums of its density in them; ``of(words)``
    gives how often each key is in a text."""
    def run(batches):
        total: dict[bytes, list[int]] = {}
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = _words(text)
                for key, k in of(words).items():
                    t = total.setdefault(key, [0, 0, 0, 0])
                    t[label] += 1
                    t[2 + label] += k * _UNIT // len(words)
                if len(total) > HELD:  # at most this and the keys of one text
                    yield _flushed(total)
        yield _flushed(total)

    def _flushed(total):
        cols = list(zip(*total.values())) or [()] * 4
        out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary())] + [pa.array(c, pa.int64()) for c in cols],
                                         names=["key", "ordinary", "toxic", "ordinary_rate", "toxic_rate"])
        total.clear()
        return out

    return rows.select("text", "label").mapInArrow(run, _COUNTS).groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("ordinary", "toxic", "ordinary_rate", "toxic_rate")])


def _telling(n_ordinary: int, n_toxic: int) -> Column:
    """Whether the counts of a key are those of a mark of the toxic class."""
    a, c, part = F.col("toxic"), F.col("ordinary"), n_toxic / (n_ordinary + n_toxic)
    evidence = 2 * (a * F.log(a / ((a + c) * part))
                    + F.when(c > 0, c * F.log(c / ((a + c) * (1 - part)))).otherwise(0.0))
    return (a >= max(MIN_TEXTS, MIN_SHARE * n_toxic)) & (a / n_toxic > (c + 1) / n_ordinary) & (evidence >= EVIDENCE) \
        & (F.col("toxic_rate") / n_toxic >= RATIO * (F.col("ordinary_rate") + _FLOOR) / n_ordinary)


def _grams(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i:i + GRAM] for i in range(len(w) - GRAM + 1)}


def _gram_counts(words: list[bytes]) -> Counter:
    out: Counter = Counter()
    for w, k in Counter(words).items():
        for g in _grams(w):
            out[g] += k
    return out


def _pair_counts(words: list[bytes]) -> Counter:
    return Counter(a + b" " + b for a, b in zip(words, words[1:]))


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The model: two dictionaries (bytes) and the calibration steps."""
    rows = sample(docs, labels)
    build = rows.where("fold = 0")
    size = {r["label"]: r["count"] for r in build.groupBy("label").count().collect()}
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.sum(1 / F.col("rate")).alias("n")).collect()}
    base = total.get(1, 0.0) / max(sum(total.values()), 1.0)
    if not size.get(0) or not size.get(1):
        return {"ordinary": b"", "toxic": b"", "x": [0.0], "y": [base]}
    telling = _telling(size[0], size[1])
    least = max(MIN_TEXTS, MIN_SHARE * size[1])
    keys = lambda df: {bytes(r["key"]) for r in df.select("key").collect()}
    # each is in a share of the bounded sample's toxic texts, which bounds their number
    marks = keys(_counts(build, _gram_counts).where(telling))
    marked = lambda w: not marks.isdisjoint(_grams(w))
    often = keys(_counts(build.where("label = 1"), _pair_counts).where(F.col("toxic") >= least))
    often = {p for p in often if not any(marked(w) for w in p.split(b" "))}
    pairs = _counts(build, lambda words: {p: k for p, k in _pair_counts(words).items() if p in often}).where(telling)
    of_words = lambda which: lambda words: {w: k for w, k in Counter(words).items() if marked(w) == which}
    denser = F.col("toxic_rate") / size[1] >= 2 * F.col("ordinary_rate") / size[0]
    top = lambda df, c, n: [(r[c], bytes(r["key"])) for r in df.where(F.col(c) > 0).orderBy(
        F.desc(c), "key").limit(n).select(c, "key").collect()]
    found = top(_counts(build, of_words(True)).where(denser), "toxic", TOXIC_WORDS) + top(pairs, "toxic", TOXIC_WORDS)
    toxic = [w for _, w in sorted(found, key=lambda x: (-x[0], x[1]))[:TOXIC_WORDS]]
    plain = [w for _, w in top(_counts(build.where("label = 0"), of_words(False)), "ordinary", ORDINARY_WORDS)]
    # the most frequent words stand last, where offsets are shortest
    joined = lambda x: b" ".join(x[::-1]) + b" "
    rare, common = b" " + joined(plain[COMMON:]), joined(plain[:COMMON])
    model = {"ordinary": rare + common, "toxic": rare + (joined(toxic) if toxic else b"") + common}
    held = map_texts(rows.where("fold = 1"), ["label", "rate"], [field("s", "double")], lambda: _distances(model))
    # at most one step per row of the sample
    steps = held.groupBy("s").agg(F.sum(1 / F.col("rate")).alias("n"),
                                  F.sum(F.col("label") / F.col("rate")).alias("pos")).orderBy("s").collect()
    x, y = isotonic([r["s"] for r in steps], [r["pos"] for r in steps], [r["n"] for r in steps])
    return model | ({"x": x, "y": y} if x else {"x": [0.0], "y": [base]})


def _distances(model: dict):
    """Function from the texts of a batch to the bytes saved in the best windows of each."""
    if len(model["toxic"]) <= len(model["ordinary"]):
        return lambda texts: [[0.0] * len(texts)]
    import zstandard as zs
    how = zs.ZstdCompressionParameters.from_level(
        LEVEL, format=zs.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)

    def compressor(content: bytes):
        d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return zs.ZstdCompressor(dict_data=d, compression_params=how).compress

    plain, toxic = compressor(model["ordinary"]), compressor(model["toxic"])

    def one(text) -> float:
        words = _words(text)
        if not words:
            return 0.0
        saves = [max(len(plain(w)) - len(toxic(w)), 0) for w in (
            b" " + b" ".join(words[i:i + WINDOW]) + b" "
            for i in range(0, max(1, len(words) - WINDOW + STEP), STEP))]
        return round(sum(saves) / len(saves), 4)

    return lambda texts: [[one(t) for t in texts]]


def scored(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """Adds ``score`` to the ``keep`` columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most 64,000 words

    def make():
        m = shared.value
        distance = _distances(m)
        x, y = np.array(m["x"]), np.array(m["y"])
        x[:-1] = (x[:-1] + x[1:]) / 2  # a step holds in its middle, scores between are in proportion

        def run(texts):
            return [np.interp(distance(texts)[0], x, y)]
        return run

    return map_texts(docs, keep, [field("score", "double")], make)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    return scored(docs, fit(docs, labels), ["doc_id"]).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, all columns kept."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    kept = scored(rows, fit(docs, labels), ["_row"]).where(F.col("score") < threshold)
    return kept.select("_row.*")
