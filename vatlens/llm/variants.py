"""Spelling variants: words one edit apart, by permuterm rotations.

Each word gets a terminator; all its rotations are sorted. A replaced character is
moved to the end of a rotation, so the rotation without its last character is a prefix
that the other word has too; a word without that character is the prefix itself::

    colour$  ->  our$col, r$colou, ...        prefix  r$colo  skips the u
    color$   ->  r$colo                       is that prefix

Rows ``(prefix, skipped character)`` are range-partitioned and sorted by prefix, which
keeps equal prefixes together, and one scan over each partition emits the neighbours of
every prefix. A prefix has at most one word per character of the alphabet (90) and the
word without it, so no group grows with the data, however the words are distributed.

* two words that skip different characters at a prefix differ by one replacement; that
  pair meets at this prefix only;
* the prefix word and a word that skips a character differ by an insertion; in a run of
  equal characters the pair meets once per character, and counts at the first.

A word of more than ``LONG`` letters would make rotations of the square of its length, so
its prefixes are given by checksums, and pairs that meet are compared letter by letter.

Words are counted with partial sums before anything is shuffled. The root of a word
follows forms, each with at least ``RATIO`` times the occurrences, so chains are short;
the ends are found by pointer doubling with joins.

Defined results: null and empty texts have no words; a null ``doc_id`` is the empty text
where it is hashed; repeated rows count again; texts of any length are read whole; a word
without near words has ``n_near`` 0 and no form and is its own root; extra columns are not
read; without words the result is empty.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vatlens.llm.common import saved

#: Shortest word, in code points, and fewest occurrences.
LETTERS, OCCURRENCES = 7, 2
#: How many times more often a form occurs than its variant.
RATIO = 10
#: One in this many (document, word) pairs loses a character.
LOSS = 31
TERMINATOR = "$"
#: Longer words are handled by checksums of their rotations.
LONG = 64
#: Two primes below 2^31, and the base of the checksums.
PRIMES, BASE = (2147483647, 2147483629), 1_000_003
#: Rows of the sorted rotations that the scan keeps at a time.
ROWS = 200_000


def occurrences(docs: DataFrame) -> DataFrame:
    """``word``, one row per occurrence: runs of letters, A-Z lower-cased. One run in ``LOSS`` of a
    document, by its checksum, loses one character. Runs too short to be words are left out."""
    # a maximal run of fewer letters holds no match, so the bound can stand in the pattern
    runs = F.regexp_extract_all(F.col("text"), F.lit(rf"[A-Za-zÀ-ÿ]{{{LETTERS},}}"), F.lit(0))
    d = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    run = F.translate("_run", string.ascii_uppercase, string.ascii_lowercase)
    d = d.select("_id", run.alias("_run"))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run").cast("binary"))
    at = (h % F.length("_run")).cast("int")
    short = F.concat(F.expr("left(_run, _at)"), F.expr("substring(_run, _at + 2)"))
    return d.select("_run", F.when(h % F.lit(LOSS) == 0, at).alias("_at")) \
        .select(F.when(F.col("_at").isNull(), F.col("_run")).otherwise(short).alias("word")) \
        .where(F.length("word") >= LETTERS)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n`` of the words with enough occurrences."""
    return occurrences(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OCCURRENCES)


def rotations(words: DataFrame) -> DataFrame:
    """``prefix``, the character it skips (empty where the prefix is the whole rotation), the prefix's
    ``last`` character, ``word`` and ``n``, for words of at most ``LONG`` letters.

    For a place i the prefix is what follows the skipped character, the terminator, and what comes before it.
    """
    n, i = F.length("word"), F.col("_i")
    at = words.where(n <= LONG).select("word", "n", F.explode(F.sequence(F.lit(0), n)).alias("_i"))
    before, after = F.expr("left(word, _i)"), F.expr("substring(word, _i + 1)")
    whole = F.struct(F.concat(after, F.lit(TERMINATOR), before).alias("prefix"), F.lit("").alias("skipped"))
    one = F.struct(F.concat(F.expr("substring(word, _i + 2)"), F.lit(TERMINATOR), before).alias("prefix"),
                   F.expr("substring(word, _i + 1, 1)").alias("skipped"))
    both = F.explode(F.when(i < n, F.array(whole, one)).otherwise(F.array(whole)))
    return at.select("word", "n", both.alias("_r")).select("_r.prefix", "_r.skipped", F.expr("right(_r.prefix, 1)").alias("last"),
                                                           "word", "n")


def _checksums(codes: np.ndarray) -> list[np.ndarray]:
    """Polynomial checksums, one per prime, of the first 0, 1, .. len(codes) code points."""
    out = []
    for prime in PRIMES:
        power, base = np.ones(1, np.int64), BASE
        while len(power) < len(codes):
            power, base = np.concatenate([power, power * base % prime]), base * base % prime
        out.append(np.concatenate([[0], np.cumsum(codes * power[:len(codes)] % prime) % prime]))
    return out


def long_rotations(words: DataFrame) -> DataFrame:
    """The same rows for longer words, in time and space linear in their length: a prefix is given by the
    checksums of its parts before and after the terminator, a word by its ``name``. Words of ``LONG``
    letters only give whole rotations, which longer words may meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, name, n in zip(*(b.column(k).to_pylist() for k in range(3))):
                codes = np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.int64)
                head = _checksums(codes)
                tail = [x[::-1] for x in _checksums(codes[::-1])]
                for skip in (0, 1)[:1 + (len(w) > LONG)]:
                    for x in range(0, len(w) + 1 - skip, ROWS):
                        at = range(x, min(x + ROWS, len(w) + 1 - skip))
                        sums = [v[at.start:at.stop].tolist() for v in head] \
                            + [v[at.start + skip:at.stop + skip].tolist() for v in tail]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(["#%d %d.%d.%d.%d" % (len(w) - skip, *v) for v in zip(*sums)]),
                             pa.array([w[i] if skip else "" for i in at]),
                             pa.array([w[i - 1] if i else TERMINATOR for i in at]),
                             pa.array([name] * len(at)), pa.array([n] * len(at), pa.int64())],
                            names=["prefix", "skipped", "last", "word", "n"])

    return words.select("word", "name", "n") \
        .mapInArrow(run, "prefix string, skipped string, last string, word string, n bigint")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbours within each prefix of rows sorted by prefix, in both directions."""
    group: list[tuple[str, str, int]] = []
    held, end, word, near, near_n = None, "", [], [], []

    def flush() -> None:
        for x, (c, w, _) in enumerate(group):
            for y, (d, v, m) in enumerate(group):
                # an insertion counts where the character before differs
                if x != y and (c and d or end != (c or d)):
                    word.append(w)
                    near.append(v)
                    near_n.append(m)

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()),
                                        pa.array(near_n, pa.int64())], names=["word", "near", "near_n"])
        word.clear(), near.clear(), near_n.clear()
        return b

    for b in batches:
        for prefix, skipped, last, w, n in zip(*(b.column(k).to_pylist() for k in range(5))):
            if prefix != held:
                if len(group) > 1:
                    flush()
                group, held, end = [], prefix, last
                if len(word) >= ROWS:
                    yield out()
            group.append((skipped, w, n))
    if len(group) > 1:
        flush()
    yield out()


def neighbours(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: each pair of words one edit apart, in both directions, once.
    Long words are compared letter by letter when their checksums meet."""
    name = F.concat(F.lit("#"), F.md5(F.col("word").cast("binary")))
    long = words.where(F.length("word") >= LONG).withColumn("name", name)
    rows = rotations(words).unionByName(long_rotations(long))
    pairs = saved(rows.repartitionByRange(F.col("prefix")).sortWithinPartitions("prefix")
                  .mapInArrow(_scan, "word string, near string, near_n bigint"), "variant-pairs")
    named = F.col("word").startswith("#")
    a = long.select(F.col("name").alias("word"), F.col("word").alias("_w"))
    b = long.select(F.col("name").alias("near"), F.col("word").alias("_v"))
    met = pairs.where(named).join(a, "word").join(b, "near").where(F.levenshtein("_w", "_v", 1) == 1)
    return pairs.where(~named).unionByName(met.select(F.col("_w").alias("word"), F.col("_v").alias("near"), "near_n"))


def forms(words: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n``: the near word of most occurrences, the smallest of equals,
    if it has ``RATIO`` times those of the word."""
    # the smallest of (-n, word) is the most frequent, then the smallest word
    best: Column = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    near = neighbours(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("_b"))
    is_form = -F.col("_b.m") >= RATIO * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.when(is_form, F.col("_b.w")).alias("form"), F.when(is_form, -F.col("_b.m")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """``found`` with ``root``: pointers of the words that have a form double until none moves."""
    links = saved(found.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to")), "variant-links")
    while True:
        onward = links.select(F.col("word").alias("to"), F.col("to").alias("_far"))
        moved = saved(links.join(onward, "to", "left").select("word", F.coalesce("_far", "to").alias("to"),
                                                              F.col("_far").isNotNull().alias("_moved")), "variant-links")
        links = moved.select("word", "to")
        if not moved.where("_moved").limit(1).count():
            break
    return found.join(links, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of ``docs``."""
    words = saved(vocabulary(docs), "variant-words")
    return roots(saved(forms(words), "variant-forms")).select("word", "form", "root", "n", "n_near", "form_n")
