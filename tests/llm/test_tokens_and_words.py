"""Spelling variants, token alignment and piece vocabularies against plain Python and the libraries."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import brute
from vatlens.llm import alignment, bpe, common, pieces, variants
from vatlens.llm.queries import tokenizers

DOCS = "doc_id bigint, text string, lang string, n string, word string, _h string, _block string, n_a string"
SIGNS = ["a", "b", " ", "  ", "the", "\n", "\t", "\x85", "　", "▁", "日", "é", ".", "'s", "T1", "😀", "\x00", "<s>",
         "<|endoftext|>", "ing", "<0x41>"]


def texts():
    rnd = random.Random(11)
    odd = [None, "", " ", "  ", "a", " a", "a ", "  a  b   c    ", "▁x▁▁ y", "<s>hi</s> <|endoftext|> x",
           "日本語テキスト", "a\n b\n\n  c\t\t", "\x00z", "😀😀 ", "é" * 100, " " * 160, "ab" * 200 + "  " + "x y" * 3,
           "the" * 700, "x\x85 y 　 z", "word " * 2_000, "nospaces" * 400]
    return odd + ["".join(rnd.choice(SIGNS) for _ in range(rnd.randint(1, 60))) for _ in range(300)]


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(texts()))
    return out + [out[4], out[19], out[19], (None, "a null id"), (None, None)]


def framed(spark, rows):
    return spark.createDataFrame([(i, t, "en", "n", "w", "h", "b", "a") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return framed(spark, rows).repartition(3)


def listed(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=tokenizers()[1])


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.vocabulary_of(pieces.model_bytes(None, tokenizers()[1]))


def test_pieces_are_the_library(spark, docs, rows, library):
    path = tokenizers()[1]
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_eos=True)
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids))))
    assert listed(pieces.round_trip(docs, path)) == sorted(want, key=repr)
    assert all(same for _, same in pieces.compared(docs, path).collect())
    assert pieces.round_trip(docs.limit(0), path).collect() == []
    both = pieces.decoded(pieces.encoded(docs.withColumn("piece_ids", F.lit("old")), path), path)
    assert both.columns == [*docs.columns, "piece_ids", "n_pieces", "decoded"]
    assert all(r.decoded == (r.text or "").replace("▁", " ") and r.n_pieces == len(r.piece_ids) for r in both.collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SIGNS), max_size=80).map("".join), max_size=4))
def test_agendas_of_any_text(library, vocabulary, given_texts):
    want = [library.encode(t) for t in given_texts]
    for short in (0, 8, 48):  # heaps alone, both, arrays for most
        old, pieces.SHORT = pieces.SHORT, short
        try:
            found = pieces.encoder(vocabulary, list, check=False)(given_texts)
        finally:
            pieces.SHORT = old
        assert [[i for u in doc for i in u] for doc in found] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_any_ids_are_spelled_as_the_library_does(library, vocabulary, ids):
    assert pieces.speller(vocabulary)(ids) == library.decode(ids)


def test_full_caches_change_nothing(spark, docs, monkeypatch):
    path = tokenizers()[1]
    whole, pairs = listed(pieces.round_trip(docs, path)), listed(alignment.aligned(docs, *tokenizers()))
    monkeypatch.setattr(pieces, "CACHE", 500)
    monkeypatch.setattr(alignment, "CACHE", 500)
    monkeypatch.setattr(common, "SLICE", 3_000)
    assert listed(pieces.round_trip(docs, path)) == whole
    assert listed(alignment.aligned(docs, *tokenizers())) == pairs


def test_a_wrong_agenda_is_noticed(vocabulary, monkeypatch):
    monkeypatch.setattr(pieces.Agenda, "ids", lambda self, units: [[5]] * len(units))
    with pytest.raises(ValueError, match="differ"):
        pieces.encoder(vocabulary, list)(["hello"])


def test_a_vocabulary_that_changes_texts_is_refused():
    from sentencepiece import sentencepiece_model_pb2
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(pieces.model_bytes(None, tokenizers()[1]))
    proto.normalizer_spec.remove_extra_whitespaces = True
    with pytest.raises(ValueError):
        pieces.vocabulary_of(proto.SerializeToString())


def test_alignment(spark, docs, rows, library):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    a_path, b_path = tokenizers()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    letters, entries = alignment.byte_letters(), {i: t for t, i in a.get_vocab().items()}

    def b_bytes(i):
        p = library.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode()

    want = brute.alignment(rows, lambda t: a.encode(t, add_special_tokens=False).ids, library.encode,
                           lambda i: bytes(letters[c] for c in entries[i]), b_bytes)
    assert listed(alignment.aligned(docs, a_path, b_path)) == sorted(want, key=repr)
    assert alignment.aligned(docs.limit(0), a_path, b_path).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.randoms())
def test_pointers_end_at_common_ends(n, rnd):
    a = np.array(sorted({n, *rnd.sample(range(1, n + 1), rnd.randint(0, n))}))
    b = np.array(sorted({n, *rnd.sample(range(1, n + 1), rnd.randint(0, n))}))
    common_ends = sorted(set(a.tolist()) & set(b.tolist()))
    got_a, got_b = alignment.labels(a, b)
    want = [next(c for c in common_ends if c >= e) for e in a]
    assert b[got_a].tolist() == want
    assert b[got_b].tolist() == [next(c for c in common_ends if c >= e) for e in b]


def words():
    rnd = random.Random(3)
    roots = ["colourful", "programme", "travelling", "aaaaaaaab", "éàüñöÿþß", "letters÷×x", "abcabcabc"]
    out = []
    for r in roots:
        near = [r[:i] + r[i + 1:] for i in range(len(r))] + [r[:i] + "aé"[i % 2] + r[i:] for i in range(len(r) + 1)] \
            + [r[:i] + "z" + r[i + 1:] for i in range(len(r))]
        out += [r] * 900 + [r.upper()] * 3 + near * 2 + [x[:-1] + "q" for x in near[::3]] * 2 + rnd.sample(near, 9) * 25
    rnd.shuffle(out)
    return out


def test_variants(spark, monkeypatch):
    every = words()
    rows = [(i, " ".join(every[k:k + 37])) for i, k in enumerate(range(0, len(every), 37))]
    gene = "".join(random.Random(1).choice("acgt") for _ in range(20_000))
    long = [gene, gene[:9_000] + gene[9_001:], gene[:70] + "n" + gene[71:], gene[:64], gene[:65], gene[:64] + "n", gene[1:65],
            gene[:63], gene[:30] + gene[31:65], gene[5:4_000], gene[5:4_000] + "a", "q" * 80, "q" * 81, "q" * 40 + "z" + "q" * 40]
    rows += [(100 + i, t) for i, t in enumerate(long * 2 + long[:1] * 30)]
    rows += [(5, None), (6, ""), (None, "Colourful, colourful_COLOURFUL 7 letter"), (8, "x" * 50_000), (9, "x" * 50_000),
             rows[0], rows[0], (10, "short words only")]
    docs, want = framed(spark, rows).repartition(4), sorted(brute.variants(rows), key=repr)
    assert sum(r[1] is not None for r in want) > 50 and any(r[1] != r[2] and r[2] != r[0] for r in want)
    assert listed(variants.variants(docs)) == want
    monkeypatch.setattr(variants, "ROWS", 3)
    assert listed(variants.variants(docs)) == want
    assert variants.variants(docs.limit(0)).collect() == []


def test_ids_are_encoded_in_small_slices(spark, monkeypatch):
    """The pipeline's executors keep what earlier stages took, so a task holds little text at a time."""
    sizes, slices = [], common._slices
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 1_500_000] * 8)], names=["text"])
    assert max(b.num_rows for b in slices(batch, batch.column(0), bpe.PIECE)) * 1_500_000 < bpe.PIECE + 1_500_000
    monkeypatch.setattr(bpe, "map_texts", lambda docs, keep, new, make, size=None: sizes.append(size) or docs.withColumns(
        {"input_ids": F.array(F.lit(1)), "n_tokens": F.lit(1)}))
    monkeypatch.setattr(bpe, "_shared", lambda docs, path: None)
    bpe.encoded(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "", "")
    assert sizes == [bpe.PIECE] and bpe.PIECE < common.SLICE
