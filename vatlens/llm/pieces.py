"""Encoding and decoding with merge-type piece vocabularies, by a score-ordered agenda.

A text is escaped (space to U+2581, one U+2581 before it) and cut before every
U+2581 that does not follow another one; no piece reaches over such a cut, which
is verified when the vocabulary is read. Units repeat, so a task learns each unit
once: the distinct new units of an Arrow batch go through the agenda together and
are then checked against the sentencepiece library; a unit on which the two
disagree raises an error.

The agenda of a unit holds its adjacent symbol pairs that spell a piece, best score
first, leftmost first among equal scores; taking a pair joins its two symbols and
replaces the pairs beside them. The agendas of all short units run side by side in
arrays, one pair a round and unit; a unit of more than ``SHORT`` characters has a
heap of its own, so a text without spaces costs n log n. Characters without a piece
become byte pieces.

The vocabulary is a model file (32,000 pieces); it is read on the driver and sent
as plain arrays and strings.

Defined results: null and empty texts have no pieces, only the end id; texts of any
length are encoded whole; repeated rows each get their row; other columns are not
read by ``round_trip`` and are handed back by ``encoded`` and ``decoded``.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vatlens.llm.common import field, map_texts

#: Longest unit, in characters, whose agenda runs in arrays beside the others.
SHORT = 48
#: Size of the units whose results a task keeps, in characters, 16 more a unit; about 14 bytes of memory each.
CACHE = 16_000_000
SPACE = "\u2581"
UNICODE = 0x110000
NONE = np.iinfo(np.int32).max


def model_bytes(spark, path: str) -> bytes:
    """A path with a scheme is read by Spark, any other on the driver."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).first()["content"])
    with open(path, "rb") as f:
        return f.read()


def vocabulary_of(model: bytes) -> dict:
    """The vocabulary as arrays: symbols are the pieces, then characters that only occur inside pieces.

    ``keys`` (left symbol * ``base`` + right symbol, sorted), ``joined`` and ``order`` (place of
    the score, best 0, equal scores equal) hold every split of a piece into two symbols.
    """
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    norm, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
    if proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback:
        raise ValueError("a merge-type vocabulary with byte pieces is needed")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix \
            or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("the vocabulary must take texts as they are, with a space before them")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
        raise ValueError("vocabularies with user-defined or unused pieces are not supported")
    if any(SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError("a piece holds a space after another character")
    symbol = dict(normal)
    for c in sorted({c for p in normal for c in p}):
        symbol.setdefault(c, len(proto.pieces) + len(symbol) - len(normal))
    size = max(symbol.values(), default=0) + 1
    base = size + UNICODE
    place = {s: k for k, s in enumerate(sorted({p.score for p in proto.pieces}, reverse=True))}
    found = sorted((symbol[p[:i]] * base + symbol[p[i:]], r, place[proto.pieces[r].score])
                   for p, r in normal.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol)
    single = {c: s for c, s in symbol.items() if len(c) == 1}
    return {
        "model": model,
        "pieces": [p.piece for p in proto.pieces],
        "control": [i for i, p in enumerate(proto.pieces) if p.type == kinds.CONTROL],
        "unknown": [i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN],
        "byte": {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE},
        "surface": proto.trainer_spec.unk_surface,
        "end": next(i for i, p in enumerate(proto.pieces) if p.piece == proto.trainer_spec.eos_piece),
        "size": size,
        "codes": np.array([ord(c) for c in single], np.int32),
        "symbols": np.array(list(single.values()), np.int32),
        "keys": np.array([x[0] for x in found] + [np.iinfo(np.int64).max], np.int64),
        "joined": np.array([x[1] for x in found] + [-1], np.int32),
        "order": np.array([x[2] for x in found] + [NONE], np.int32),
    }


class Agenda:
    """Ids of units. A character without a symbol is the symbol ``size + code point``, which joins nothing."""

    def __init__(self, v: dict):
        self.v, self.pieces, self.base = v, len(v["pieces"]), v["size"] + UNICODE
        self.symbol = np.arange(v["size"], v["size"] + UNICODE, dtype=np.int32)
        self.symbol[v["codes"]] = v["symbols"]
        self.letter = dict(zip(v["symbols"].tolist(), map(chr, v["codes"].tolist())))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of symbols its place in the order of scores, ``NONE`` for no piece, and the piece."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.v["keys"], key)
        hit = self.v["keys"][at] == key
        return np.where(hit, self.v["order"][at], NONE), self.v["joined"][at]

    def ids(self, units: list[str]) -> list[list[int]]:
        """``units`` are escaped texts."""
        out: list = [None] * len(units)
        long = [k for k, u in enumerate(units) if len(u) > SHORT]
        for k in long:
            out[k] = self._spelled(self._heap(units[k]))
        short = [k for k, u in enumerate(units) if len(u) <= SHORT]
        if short:
            tok, ends = self._rounds([units[k] for k in short])
            odd = np.flatnonzero(tok >= self.pieces)
            odd = set(np.searchsorted(ends, odd, side="right").tolist())
            tok, at = tok.tolist(), 0
            for k, end in zip(short, ends.tolist()):
                out[k] = tok[at:end]
                at = end
            for k in odd:
                out[short[k]] = self._spelled(out[short[k]])
        return out

    def _spelled(self, symbols: list[int]) -> list[int]:
        """Byte pieces for symbols that are no piece."""
        if all(s < self.pieces for s in symbols):
            return symbols
        out: list[int] = []
        for s in symbols:
            if s < self.pieces:
                out.append(s)
            else:
                c = self.letter[s] if s < self.v["size"] else chr(s - self.v["size"])
                out += [self.v["byte"][b] for b in c.encode()]
        return out

    def _symbols(self, text: str) -> np.ndarray:
        return self.symbol[np.frombuffer(text.encode("utf-32-le"), np.uint32)]

    def _rounds(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each round takes the first pair of every unit's agenda; a unit without pairs is done.
        Returns the symbols of all units in order and where each unit ends."""
        tok = self._symbols("".join(units))
        own = np.repeat(np.arange(len(units), dtype=np.int32), [len(u) for u in units])
        order, piece = np.full(len(tok), NONE, np.int32), np.full(len(tok), -1, np.int32)

        def look(at: np.ndarray) -> None:
            order[at], piece[at] = self.pairs(tok[at], tok[at + 1])

        look(np.flatnonzero(own[1:] == own[:-1]))
        done = []
        while len(tok):
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            best = np.minimum.reduceat(order, starts)
            sizes = np.diff(np.append(starts, len(tok)))
            wanted = np.repeat(best, sizes)
            over = wanted == NONE
            if over.any():
                done.append((own[over], tok[over]))
                on = ~over
                tok, own, order, piece, wanted = tok[on], own[on], order[on], piece[on], wanted[on]
                if not len(tok):
                    break
            at = np.flatnonzero(order == wanted)
            at = at[np.concatenate([[True], own[at[1:]] != own[at[:-1]]])]
            tok[at] = piece[at]
            on = np.ones(len(tok), bool)
            on[at + 1] = False
            at -= np.arange(len(at))  # one symbol goes before each later place
            tok, own, order, piece = tok[on], own[on], order[on], piece[on]
            order[at] = NONE
            near = np.concatenate([at[at > 0] - 1, at[at + 1 < len(tok)]])
            look(near[own[near] == own[near + 1]])
        if not done:
            return tok, np.zeros(len(units), np.int64)
        own, tok = (np.concatenate(x) for x in zip(*done))
        sort = np.argsort(own, kind="stable")
        return tok[sort], np.cumsum(np.bincount(own, minlength=len(units)))

    def _heap(self, unit: str) -> list[int]:
        tok = self._symbols(unit)
        n = len(tok)
        order, piece = self.pairs(tok[:-1], tok[1:])
        heap = [(o, i, p) for i, (o, p) in enumerate(zip(order.tolist(), piece.tolist())) if o != NONE]
        heapq.heapify(heap)
        order, piece, tok = order.tolist(), piece.tolist(), tok.tolist()
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        keys, joined, places, known = self.v["keys"], self.v["joined"], self.v["order"], {}

        def look(i: int) -> None:
            """File the pair that now begins at ``i``."""
            j = nxt[i]
            piece[i] = -1
            if j < n:
                key = tok[i] * self.base + tok[j]
                if key not in known:
                    at = int(np.searchsorted(keys, key))
                    known[key] = (int(places[at]), int(joined[at])) if keys[at] == key else None
                if known[key]:
                    piece[i] = known[key][1]
                    heapq.heappush(heap, (known[key][0], i, piece[i]))

        piece.append(-1)
        while heap:
            _, i, p = heapq.heappop(heap)
            # the piece alone does not tell an old entry from a new one: its two symbols must still spell it
            if tok[i] < 0 or piece[i] != p:
                continue
            j = nxt[i]
            tok[i], tok[j], nxt[i], piece[j] = p, -1, nxt[j], -1
            if nxt[i] < n:
                prv[nxt[i]] = i
            look(i)
            if prv[i] >= 0:
                look(prv[i])
        return [t for t in tok if t >= 0]


def _each_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "\ufffd", error.start + 1


def speller(v: dict):
    """Function from a list of ids to their text, as the library's ``decode``: byte pieces are read
    as UTF-8, each wrong byte U+FFFD; control pieces are left out; the space before the text goes."""
    codecs.register_error("each-byte", _each_byte)
    byte = {i: b for b, i in v["byte"].items()}
    control, unknown = set(v["control"]), set(v["unknown"])
    shown = [p.replace(SPACE, " ") for p in v["pieces"]]

    def spell(ids, begin: bool = True) -> str:
        out, run, empty = [], bytearray(), True
        for i in ids:
            if i in byte:
                run.append(byte[i])
                continue
            if run:
                out.append(run.decode("utf-8", "each-byte"))
                run.clear()
                empty = False
            if i in control:
                continue
            if i in unknown:
                text = v["surface"]
            else:
                text = shown[i]
                if begin and empty and text[:1] == " ":
                    text, begin = text[1:], False
            out.append(text)
            empty = empty and not text
        if run:
            out.append(run.decode("utf-8", "each-byte"))
        return "".join(out)

    return spell


def units_of(text: str) -> list[str]:
    """What follows the space of each unit, spaces unescaped."""
    text = text.replace(SPACE, " ")
    if text[0] == " " or "  " in text:
        return re.split("(?<=[^ ]) ", text)
    return text.split(" ")


def encoder(v: dict, make, check: bool = True):
    """Function from a list of texts (None is empty) to, for each, the list of ``make(ids)`` of its units.

    Results are kept until their units have the size ``CACHE``, then learned anew.
    """
    import sentencepiece
    agenda = Agenda(v)
    library = sentencepiece.SentencePieceProcessor(model_proto=v["model"]) if check else None
    known: dict[str, object] = {}
    kept = 0

    def encode(texts: list) -> list[list]:
        nonlocal kept
        split = [units_of(t) if t else [] for t in texts]
        new = set()
        for x in split:
            new.update(x)
        new.difference_update(known)
        size = sum(map(len, new)) + 16 * len(new)
        if known and kept + size > CACHE:
            known.clear()
            kept, new = 0, set()
            for x in split:
                new.update(x)
            size = sum(map(len, new)) + 16 * len(new)
        fresh = list(new)
        ids = agenda.ids([SPACE + u.replace(" ", SPACE) for u in fresh])
        if library is not None and fresh:
            # a unit is encoded with the space before it; for the empty one the library would add none
            for u, mine, theirs in zip(fresh, ids, library.encode(fresh, num_threads=1)):
                if mine != theirs and u:
                    raise ValueError(f"agenda and library differ on {u[:200]!r}")
        known.update(zip(fresh, map(make, ids)))
        kept += size
        return [list(map(known.__getitem__, x)) for x in split]

    return encode


def _shared(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(vocabulary_of(model_bytes(df.sparkSession, path)))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``piece_ids`` (array of int, end id last) and ``n_pieces``; columns of these names are replaced."""
    shared = _shared(docs, path)

    def make():
        encode, end = encoder(shared.value, lambda ids: array("i", ids)), shared.value["end"]

        def run(texts):
            ids, ends = array("i"), array("i", [0])
            for doc in encode(texts):
                for u in doc:
                    ids.extend(u)
                ids.append(end)
                ends.append(len(ids))
            ends = np.frombuffer(ends, np.int32)
            return [pa.ListArray.from_arrays(ends, np.frombuffer(ids, np.int32) if ids else pa.array([], pa.int32())),
                    np.diff(ends).astype(np.int64)]
        return run

    new = [field("piece_ids", "array<int>"), field("n_pieces", "bigint")]
    out = map_texts(docs.select(F.struct("*").alias("_row"), "text"), ["_row"], new, make)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c.lower() not in ("piece_ids", "n_pieces")],
                      "piece_ids", "n_pieces")


def decoded(ids: DataFrame, path: str, column: str = "piece_ids") -> DataFrame:
    """``ids`` with ``decoded``, the text that the ids of ``column`` spell (null for null)."""
    shared = _shared(ids, path)

    def make():
        spell = speller(shared.value)
        return lambda rows: [[None if x is None else spell(x) for x in rows]]

    keep = ids.select(F.struct("*").alias("_all"), F.col(column).alias("text"))
    return map_texts(keep, ["_all"], [field("decoded", "string")], make).select(
        *[F.col(f"_all.`{c}`").alias(c) for c in ids.columns if c.lower() != "decoded"], "decoded")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``docs``; the text is spelled
    from the ids, unit by unit."""
    shared = _shared(docs, path)

    def make():
        spell, end = speller(shared.value), shared.value["end"]
        encode = encoder(shared.value, lambda ids: (len(ids), " ".join(map(str, ids)), spell(ids, False)))
        tail = str(end)

        def run(texts):
            count, ids_hash, text_hash = [], [], []
            for doc in encode(texts):
                count.append(sum([u[0] for u in doc]) + 1)
                ids_hash.append(sha256(" ".join([*[u[1] for u in doc], tail]).encode()).hexdigest())
                text_hash.append(sha256("".join([u[2] for u in doc])[1:].encode()).hexdigest())
            return [count, ids_hash, text_hash]
        return run

    return map_texts(docs, ["doc_id"], [field("n_tokens", "bigint"), field("ids_sha256", "string"),
                                        field("decoded_sha256", "string")], make)


def compared(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, same``: whether whole texts give the library's own ids and decoded text, in Arrow batches."""
    shared = _shared(docs, path)

    def make():
        import sentencepiece
        library = sentencepiece.SentencePieceProcessor(model_proto=shared.value["model"])
        encode, spell = encoder(shared.value, list, check=False), speller(shared.value)

        def run(texts):
            mine = [[i for u in doc for i in u] + [shared.value["end"]] for doc in encode(texts)]
            theirs = library.encode([t or "" for t in texts], add_eos=True, num_threads=1)
            return [[a == b and spell(a) == library.decode(b) for a, b in zip(mine, theirs)]]
        return run

    return map_texts(docs, ["doc_id"], [field("same", "boolean")], make)
