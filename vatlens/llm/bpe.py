"""Byte-level BPE by corpus merge replay.

A block of the corpus is some documents of a partition (a slice of 12 MB). The distinct
pre-tokens of a block are laid out as one sequence of byte tokens. An inverted
index maps the rank of each mergeable pair to its positions; ranks are replayed
in order, a merge links its neighbours and touches only the two pairs beside it.
Documents are then spelled from their pre-tokens. Blocks bound memory, and a task
forgets the units it knows when they have the size ``CACHE``.

A merge never needs text outside its pre-token, so a block gives what the whole
corpus would give; keeping one index for all of it would shuffle every
pre-token occurrence, several times the input.

The vocabulary is a rank file (base64 token, rank), a documented size (50,256
tokens); it is read on the driver and sent to the tasks. The pattern is the
tokenizer's own, with ``\\s`` spelled out so that it means Unicode white space.

Defined results: null and empty texts have no tokens; a text of any length is
encoded whole; repeated rows each get their row.
"""

from __future__ import annotations

import base64
import heapq
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vatlens.llm.alignment import Numbers
from vatlens.llm.common import field, map_texts

#: Size of the units whose results a task keeps, in characters, 16 more a unit; about 10 bytes of memory each.
CACHE = 10_000_000
#: Bytes of text encoded at a time: their distinct units and results are held at once beside the known ones.
PIECE = 4_000_000
#: Units learned at a time.
BATCH = 200_000
#: Fixed: the code points with the Unicode property White_Space.
WHITE = r"\t-\r \x85\xa0  -     　"


def ranks_of(spark, path: str) -> dict[bytes, int]:
    """Read a rank file; a path with a scheme is read by Spark, any other on the driver."""
    if "://" in path:
        lines = [r.value for r in spark.read.text(path).collect()]
    else:
        with open(path) as f:
            lines = f.read().splitlines()
    pairs = (line.split() for line in lines if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def tables(ranks: dict[bytes, int]) -> dict:
    """Tokens by rank, and every mergeable pair of tokens as a sorted array; plain values, built once on the driver."""
    base = max(ranks.values()) + 1
    found = sorted((ranks[t[:i]] * base + ranks[t[i:]], r, max(ranks[t[:i]], ranks[t[i:]]))
                   for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
    by_rank = [b""] * base
    for t, r in ranks.items():
        by_rank[r] = t
    return {
        "tokens": by_rank, "base": base, "byte": np.array([ranks[bytes([b])] for b in range(256)], np.int32),
        "keys": np.array([x[0] for x in found] + [np.iinfo(np.int64).max], np.int64),
        "values": np.array([x[1] for x in found] + [-1], np.int32),
        # ranks whose token can go on to a token of a lower rank, which then comes first
        "early": {high for _, r, high in found if r < high}}


class Vocabulary:
    """A vocabulary from its ranks, or from the tables made of them, and what a task derives from it."""

    def __init__(self, ranks: dict):
        t = ranks if "tokens" in ranks else tables(ranks)
        self.token, self.base, self.byte, self.early = t["tokens"], t["base"], t["byte"], t["early"]
        self.keys, self.values = t["keys"], t["values"]
        self.lengths = np.array([len(x) for x in self.token])
        self.decimal = np.array([str(r) for r in range(self.base)], object)
        self.places = np.array([len(x) for x in self.decimal])

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, -1 for none."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)


def replay(vocabulary: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in order, and where those of each word end: every merge in rank order over the words at once.

    ``index`` maps a rank to the positions (left token) at which its pair was
    seen; ``here`` holds the present rank of the pair at each position, so an
    entry that a neighbour's merge made void is recognised. Of overlapping
    places of one rank the leftmost goes first, as in one word alone.
    """
    if not words:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    n = len(raw)
    tok = vocabulary.byte[raw]
    nxt, prv = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    nxt[ends - 1] = -1
    prv[np.concatenate([[0], ends[:-1]])] = -1
    here = np.full(n, -1, np.int32)
    inner = np.flatnonzero(nxt >= 0)
    here[inner] = vocabulary.rank(tok[inner], tok[inner + 1])
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(at: np.ndarray, ranks: np.ndarray) -> None:
        """File positions under their ranks."""
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(at)]
        for x, y in zip(bounds, bounds[1:]):
            r = int(ranks[x])
            if r in index:
                index[r].append(at[x:y])
            else:
                index[r] = [at[x:y]]
                heapq.heappush(heap, r)

    def refresh(at: np.ndarray) -> None:
        """New ranks of the pairs at these positions."""
        right = nxt[at]
        now = np.where(right >= 0, vocabulary.rank(tok[at], tok[right]), -1)
        here[at] = now
        if (live := now >= 0).any():
            note(at[live], now[live])

    def one_by_one(at: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Split the places of ``r``: in a word where a merge can make a pair of lower
        rank beside it, only the first place merges now."""
        word = np.searchsorted(ends, at, side="right")
        again = np.concatenate([[False], word[1:] == word[:-1]])
        if not again.any():
            return at, at[:0]
        left, right = prv[at], nxt[nxt[at]]
        low = np.zeros(len(at), bool)
        for near in (left, right):
            some = near >= 0
            for other in (tok[near], np.full(len(at), r, np.int32)):
                pair = (other, np.full(len(at), r, np.int32)) if near is left else (np.full(len(at), r, np.int32), other)
                rank = vocabulary.rank(*pair)
                low |= some & (rank >= 0) & (rank < r)
        wait = again & np.isin(word, word[low])
        return at[~wait], at[wait]

    first = np.flatnonzero(here >= 0)
    if len(first):
        note(first, here[first])
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        at = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
        at = at[here[at] == r]
        if not len(at):
            continue
        if len(at) > 1 and (over := nxt[at[:-1]] == at[1:]).any():
            # overlapping places form runs: every other one merges
            place = np.arange(len(at))
            start = np.maximum.accumulate(np.where(np.concatenate([[True], ~over]), place, 0))
            at = at[(place - start) % 2 == 0]
        if r in vocabulary.early and len(at) > 1:
            at, later = one_by_one(at, r)
            if len(later):
                note(later, np.full(len(later), r, np.int32))
        gone = nxt[at]
        after = nxt[gone]
        tok[at], tok[gone], here[gone] = r, -1, -1
        nxt[at] = after
        some = after >= 0
        prv[after[some]] = at[some]
        before = prv[at]
        refresh(np.concatenate([before[before >= 0], at]))
    alive = tok >= 0
    return tok[alive], np.cumsum(alive)[ends - 1]


def splitter(pattern: str):
    """Functions ``units`` and ``match``: a text as units, a unit as pre-tokens.

    ``units`` gives the first unit and what follows each single space; no match of
    the pattern reaches over a space but to begin with it, unless white space
    stands on both sides of one. Such texts give None and are matched whole.
    """
    import regex
    white = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
    wide = regex.compile(f"[{WHITE}] [{WHITE}]").search
    return lambda text: None if wide(text) else text.split(" "), regex.compile(white).findall


def cut(whole, ends: np.ndarray) -> list:
    """Consecutive pieces of a text or of bytes."""
    ends = ends.tolist()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


def id_bytes(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids of each word as 32-bit numbers."""
    return cut(ids.astype(np.int32).tobytes(), ends * 4)


def spellings(vocabulary: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """Of each word the ids as decimal text, each with a space before it, and the bytes that its ids spell."""
    text = cut("".join((" " + vocabulary.decimal[ids]).tolist()), np.cumsum(vocabulary.places[ids] + 1)[ends - 1])
    back = cut(b"".join(map(vocabulary.token.__getitem__, ids.tolist())), np.cumsum(vocabulary.lengths[ids])[ends - 1])
    return list(zip(text, back))


def encoder(vocabulary: Vocabulary, pattern: str):
    """Function from a list of texts (None is empty) to, for each, ``(ids,)`` of its units in order."""
    encode = block_encoder(vocabulary, pattern, id_bytes, b"".join)

    def run(texts: list) -> list[list[tuple]]:
        result, places = encode(texts)
        ids = [(np.frombuffer(x, np.int32).tolist(),) for x in result]
        return [[ids[i] for i in x.tolist()] for x in places]

    return run


def block_encoder(vocabulary: Vocabulary, pattern: str, describe, joined):
    """Function from a list of texts (None is empty) to the results of its distinct units and, for each text,
    the places of its units among them, in order.

    ``describe(vocabulary, ids, ends)`` gives the result of each word, ``joined`` that of several in a row.
    """
    units, match = splitter(pattern)
    known: dict = {}  # a unit after a space (text), or one that begins as it is (text in a tuple)
    kept = 0

    def learn(new: list) -> None:
        parts = [match(k[0]) if type(k) is tuple else match(" " + k) for k in new]
        number = Numbers()
        places = [[number[w] for w in p] for p in parts]
        ids, ends = replay(vocabulary, [w.encode() for w in number])
        result = describe(vocabulary, ids, ends) if len(ends) else []
        for k, at in zip(new, places):
            known[k] = result[at[0]] if len(at) == 1 else joined([result[i] for i in at])

    def encode(texts: list) -> tuple[list, list[np.ndarray]]:
        nonlocal kept
        number, places = Numbers(), []
        for t in texts:
            x = units(t) if t else []
            if x is None:
                x = [(w,) for w in match(t)]
            elif x:
                x[0] = (x[0],)
            places.append(np.fromiter(map(number.__getitem__, x), np.int32, len(x)))
        for again in (False, True):
            new = [k for k in number if k not in known]
            size = sum(map(len, new)) + 16 * len(new)
            if again or not known or kept + size <= CACHE:
                break
            known.clear()
            kept = 0
        kept += size
        for at in range(0, len(new), BATCH):
            learn(new[at:at + BATCH])
        return list(map(known.__getitem__, number)), places

    return encode


def _shared(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(tables(ranks_of(docs.sparkSession, path)))


def encoded(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``docs`` with ``input_ids`` (array of int) and ``n_tokens``; columns of these names are replaced."""
    vocabulary = _shared(docs, path)

    def make():
        encode = block_encoder(Vocabulary(vocabulary.value), pattern, id_bytes, b"".join)

        def run(texts):
            result, places = encode(texts)
            ids = [b"".join(map(result.__getitem__, x.tolist())) for x in places]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            flat = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(ids))])
            return [pa.ListArray.from_arrays(np.append(0, np.cumsum(n)).astype(np.int32), flat), n]
        return run

    new = [field("input_ids", "array<int>"), field("n_tokens", "bigint")]
    keep = docs.select(F.struct("*").alias("_row"), "text")
    out = map_texts(keep, ["_row"], new, make, PIECE)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("input_ids", "n_tokens")],
                      "input_ids", "n_tokens")


def decoded(ids: DataFrame, path: str, column: str = "input_ids") -> DataFrame:
    """``ids`` with ``bytes``, what the ids of ``column`` spell (null for null)."""
    vocabulary = _shared(ids, path)

    def make():
        token = vocabulary.value["tokens"]
        return lambda rows: [[None if x is None else b"".join(map(token.__getitem__, x)) for x in rows]]

    # map_texts reads the column named text
    keep = ids.select(F.struct("*").alias("_all"), F.col(column).alias("text"))
    return map_texts(keep, ["_all"], [field("bytes", "binary")], make).select(
        *[F.col(f"_all.`{c}`").alias(c) for c in ids.columns if c.lower() != "bytes"], "bytes")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``."""
    vocabulary = _shared(docs, path)

    def make():
        encode = block_encoder(Vocabulary(vocabulary.value), pattern, spellings,
                         lambda parts: ("".join([x for x, _ in parts]), b"".join([x for _, x in parts])))

        def run(texts):
            result, places = encode(texts)
            decimal, spelled = [x for x, _ in result], [x for _, x in result]
            count, ids_hash, text_hash = [], [], []
            for x in places:
                x = x.tolist()
                ids = "".join(map(decimal.__getitem__, x))
                count.append(ids.count(" "))
                ids_hash.append(sha256(ids[1:].encode()).hexdigest())
                text_hash.append(sha256(b"".join(map(spelled.__getitem__, x))).hexdigest())
            return [count, ids_hash, text_hash]
        return run

    return map_texts(docs, ["doc_id"], [field("n_tokens", "bigint"), field("ids_sha256", "string"),
                                        field("decoded_sha256", "string")], make)
