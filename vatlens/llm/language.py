"""Language identification of mixed text.

Words are scored per language by naive Bayes over hashed character trigrams,
learned from the labelled rows. The script of a word narrows its candidates: a
language that writes under ``SHARE`` of its letters in that script is out. Viterbi
over the words of a text, with a penalty for switching, labels spans; the
predicted language is the one whose spans hold most letters, and the score is
their share.

The decoder treats a batch as one sequence of words whose switches are free at
text ends, cuts it into blocks, finds each block's best path between any two
languages for all blocks at once, and chains the blocks: the exact Viterbi
optimum, as max-marginals of a forward and a backward pass.

The model has ``2 ** BITS`` floats for each language and at most ``LANGS`` languages
(the most frequent labels), so its size is bounded; all training rows count.

Defined results: a text that is null or has no letter is ``und`` with score 0;
without any labelled row every text is ``und``; rows with a null doc_id or lang
are not learned from; equal scores go to the language first in order of name;
words over ``PIECE`` letters are scored in pieces.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vatlens.llm.common import field, held_out, map_texts, remainder, saved

BITS, HELD, SHARE, SWITCH, BLOCK, PIECE = 16, 128, 0.002, 12.0, 128, 64
#: ``HELD``: languages whose counts a task holds before it hands them on; every learned language is kept.
#: Words whose scores a task keeps.
CACHE = 200_000
#: Fixed: first code point of each range and the script it begins (Unicode blocks, merged by script).
RANGES = [
    (0x0, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"),
    (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"),
    (0xA80, "gujarati"), (0xB00, "oriya"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"),
    (0xD00, "malayalam"), (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"),
    (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"),
    (0xA000, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "other"),
    (0xFF21, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0x10000, "other"), (0x20000, "han"),
]
_STARTS = np.array([a for a, _ in RANGES])
SCRIPTS = sorted({s for _, s in RANGES})
_SCRIPT = np.array([SCRIPTS.index(s) for _, s in RANGES])
_GAP = re.compile(r"(?:[^\w\n]|[\d_])+")


def _words(pieces: list[str]) -> tuple[list[str], np.ndarray]:
    """The lower-case letter words of white-space pieces, long ones cut, and how many each has."""
    words, count = [], np.zeros(len(pieces), np.int64)
    for k, line in enumerate(_GAP.sub(" ", "\n".join(pieces).lower()).split("\n") if pieces else []):
        own = line.split()
        if len(own) != 1 or len(own[0]) > PIECE or not own[0].isalpha():
            own = [w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in own]
            own = [w[i:i + PIECE] for w in own for i in range(0, len(w), PIECE)]
        words += own
        count[k] = len(own)
    return words, count


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all words with their ends marked, one per letter; letters and script per word."""
    letters = np.fromiter(map(len, words), np.int64, len(words))
    p = np.frombuffer(("\1" + "\1\1".join(words) + "\1").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = (p[:-2] * np.uint64(0x9E3779B1) ^ p[1:-1] * np.uint64(0x85EBCA6B) ^ p[2:] * np.uint64(0xC2B2AE35)) \
        * np.uint64(0x27D4EB2F)
    first = np.cumsum(letters + 2) - letters - 2  # each word stands between two marks
    inside = np.ones(len(p), bool)
    inside[first + letters] = inside[first + letters + 1] = False
    grams = ((h >> np.uint64(13)) & np.uint64((1 << BITS) - 1)).astype(np.int64)[inside[:-2]]
    script = _SCRIPT[np.searchsorted(_STARTS, p[first + 1].astype(np.int64), side="right") - 1]
    return grams, letters, script


def fit(docs: DataFrame) -> dict:
    """Languages, log probabilities of trigrams and the scripts of each language."""
    learn = docs.where((remainder(4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()) \
        .select("lang", "text")

    def run(batches):
        total: dict[str, np.ndarray] = {}
        scripts: Counter = Counter()
        for b in batches:
            pieces: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces.setdefault(lang, Counter()).update(text.split())
            for lang, found in pieces.items():
                if lang not in total:
                    if len(total) >= HELD:
                        yield from flush(total, scripts)
                    total[lang] = np.zeros(1 << BITS, np.int64)
                words, count = _words(list(found))
                if not words:
                    continue
                grams, letters, script = _grams(words)
                times = np.repeat(np.fromiter(found.values(), np.int64, len(found)), count)
                total[lang] += np.bincount(grams, weights=np.repeat(times, letters), minlength=1 << BITS).astype(np.int64)
                for s, n in enumerate(np.bincount(script, weights=times * letters)):
                    scripts[lang, s] += int(n)
        yield from flush(total, scripts)

    def flush(total, scripts):
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            own = [(s, n) for (g, s), n in scripts.items() if g == lang]
            keys = np.concatenate([at, [(1 << BITS) + s for s, _ in own]]).astype(np.int64)
            n = np.concatenate([counts[at], [n for _, n in own]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(n)],
                                             names=["lang", "key", "n"])
        total.clear()
        scripts.clear()

    counted = saved(learn.withColumn("lang", F.col("lang").cast("string")).mapInArrow(
        run, "lang string, key bigint, n bigint").groupBy("lang", "key").agg(F.sum("n").alias("n")), "trigrams")
    is_gram = F.col("key") < (1 << BITS)
    langs = sorted(r["lang"] for r in counted.where(is_gram).select("lang").distinct().collect())
    logp = np.zeros((len(langs), 1 << BITS), np.float32)
    allowed = np.zeros((len(langs), len(SCRIPTS)), bool)
    for k, lang in enumerate(langs):  # 2 ** BITS rows at most, one language at a time
        t = counted.where(F.col("lang") == lang).select("key", "n").toArrow()
        key, n = t.column(0).to_numpy(), t.column(1).to_numpy()
        grams = key < (1 << BITS)
        counts = np.full(1 << BITS, 0.5)
        counts[key[grams]] += n[grams]
        logp[k] = np.log(counts / counts.sum())
        script = np.zeros(len(SCRIPTS))
        script[key[~grams] - (1 << BITS)] = n[~grams]
        allowed[k] = script >= SHARE * script.sum()
    return {"langs": langs, "logp": logp, "allowed": allowed}


def _forward(scores: np.ndarray, switch: np.ndarray) -> np.ndarray:
    """Best score of a path that ends at each word in each language.

    ``switch[t]`` is the penalty for a change of language before word ``t``.
    """
    n, size = scores.shape
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    s = np.pad(scores, ((0, pad), (0, 0))).reshape(blocks, BLOCK, size)
    p = np.pad(switch, (0, pad)).reshape(blocks, BLOCK)
    # best path of each block from each language before it (axis 1) to each at its end (axis 2)
    across = np.where(np.eye(size, dtype=bool), 0.0, -np.inf)[None].repeat(blocks, 0)
    for t in range(BLOCK):
        across = np.maximum(across, across.max(2, keepdims=True) - p[:, t, None, None]) + s[:, t, None, :]
    start = np.zeros((blocks, size))
    for b in range(1, blocks):
        start[b] = (start[b - 1][:, None] + across[b - 1]).max(0)
        start[b] -= start[b].max()
    out, v = np.empty_like(s), start
    for t in range(BLOCK):
        v = np.maximum(v, v.max(1, keepdims=True) - p[:, t, None]) + s[:, t]
        out[:, t] = v
    return out.reshape(-1, size)[:n]


def viterbi(scores: np.ndarray, ends: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Language of each word; ``ends`` marks the first word of each text."""
    if scores.shape[1] == 1 or not len(scores):
        return np.zeros(len(scores), np.int64)
    scores = scores - scores.max(1, keepdims=True)
    switch = np.where(ends, 0.0, penalty)
    ahead = _forward(scores, switch)
    back = _forward(scores[::-1], np.append(0.0, switch[1:][::-1]))[::-1]
    total = ahead + back - scores
    # blocks are shifted by constants, which no choice between languages sees
    return np.argmax(np.round(total - total.max(1, keepdims=True), 6), 1)


class Decoder:
    """Labels the words of texts; scores of words are kept per white-space piece."""

    def __init__(self, model: dict):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # number of a piece
        self.start = self.count = np.zeros(0, np.int64)  # its words
        self.letters = np.zeros(0, np.int64)
        self.scores = np.zeros((0, len(self.model["langs"])), np.float32)

    def learn(self, pieces: list[str]) -> None:
        if not pieces:
            return
        logp, allowed = self.model["logp"], self.model["allowed"]
        words, count = _words(pieces)
        at = len(self.letters)
        self.start = np.concatenate([self.start, at + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces))))
        if not words:
            return
        grams, letters, script = _grams(words)
        begin = np.cumsum(letters) - letters
        scores = np.stack([np.add.reduceat(row[grams], begin) for row in logp], 1)
        may = allowed[:, script].T
        may = may | ~may.any(1, keepdims=True)  # a script no language uses rules none out
        scores = np.where(may, scores, scores.min(1, keepdims=True) - 50.0)
        self.scores = np.concatenate([self.scores, scores.astype(np.float32)])
        self.letters = np.concatenate([self.letters, letters])

    def __call__(self, texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text the language of each letter word (index into ``langs``) and its letters."""
        if not self.model["langs"]:
            return [(np.zeros(0, np.int64),) * 2 for _ in texts]
        split = [t.split() if t else [] for t in texts]
        if len(self.known) > CACHE:
            self.clear()
        need = set()
        for s in split:
            need.update(s)
        self.learn(list(need.difference(self.known)))
        which = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64)
        count = self.count[which]
        ramp = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        words = np.repeat(self.start[which], count) + ramp
        # words per text, from its pieces
        upto = np.concatenate([[0], np.cumsum(count)])
        ends = upto[np.cumsum([len(s) for s in split])]
        begins = np.concatenate([[0], ends[:-1]])
        firsts = np.zeros(len(words), bool)
        firsts[begins[begins < ends]] = True
        path = viterbi(self.scores[words].astype(np.float64), firsts)
        letters = self.letters[words]
        return [(path[x:y], letters[x:y]) for x, y in zip(begins.tolist(), ends.tolist())]


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def make():
        m = shared.value
        decode, langs = Decoder(m), m["langs"]

        def some(texts):
            for path, letters in decode(texts):
                if not langs or not len(path):
                    yield "und", 0.0
                    continue
                held = np.bincount(path, weights=letters, minlength=len(langs))
                best = int(held.argmax())
                yield langs[best], float(held[best] / held.sum())

        def run(texts):
            out = [x for i in range(0, len(texts), 1000) for x in some(texts[i:i + 1000])]
            return [[a for a, _ in out], [b for _, b in out]]
        return run

    return map_texts(docs, ["doc_id"], [field("lang_pred", "string"), field("score", "double")], make) \
        .select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
