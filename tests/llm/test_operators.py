"""The operators against plain Python, on small fixtures with odd rows, and on sf0.001."""

import base64
import random

import duckdb
import numpy as np
import pytest

import brute
from vatlens.llm import (bpe, chat, common, decontaminate, language, pii, quality, quality_rules, simhash,
                         substrings, toxicity)
from vatlens.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, score string, _h string, n_words string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omikron pi rho sigma tau".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + str(rnd.randrange(30)) for _ in range(n))


def odd_texts():
    rnd = random.Random(5)
    base = prose(rnd, 60)
    return [None, "", "   ", "\n\t", "a", "a b", base, base, base.upper(), base + " end", prose(rnd, 8),
            "a" * 30_000, "a b " * 4_000, prose(rnd, 9_000), "é漢字 😀 " * 20, "x\x00y \x85 z", "12.5.6.7 1.2.3.4",
            "Mail a@b.c_d@e.f, x.y@z and +1 (202) 555-0143 or 4111 1111 1111 1111; 999.1.1.1 1.1.1.1.1",
            "0" * 25 + " 4111-1111-1111-1111 +49 30 1234567 a@b..c q@w.e.r.t", "+1" + " " * 500, "@" * 300 + "a@a@a.b"]


@pytest.fixture(scope="module")
def rows():
    texts = odd_texts()
    out = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    return out + [out[6], out[6], (None, "alpha beta gamma " * 10), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None if (i or 0) % 2 else "en", "s", "9", "h", "w") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def listed(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_decontaminate(spark, docs, rows, empty):
    t = odd_texts()[13].split()
    items = [(1, " ".join(t[100:130])), (2, "alpha beta"), (3, None), (4, "!!!"), (2, "a b a"), (None, " ".join(t[400:411])),
             (10, odd_texts()[6]), (9, odd_texts()[6].upper())]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(brute.contamination(rows, items), key=repr)
    assert listed(decontaminate.contamination(docs, bench), "*") == want
    keep = decontaminate.clean(docs, bench)
    assert keep.columns == docs.columns
    assert sorted(map(repr, [r.doc_id for r in keep.collect()])) == sorted(repr(w[0]) for w in want if not w[5])
    assert decontaminate.contamination(empty, bench).count() == 0
    none = decontaminate.contamination(docs, spark.createDataFrame([], "item_id bigint, text string"))
    assert none.where("contaminated or n_hit > 0").count() == 0 and none.count() == len(rows)


def test_simhash(docs, rows, empty):
    fps = [(i, brute.fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(fps, brute.components(fps))), key=repr)
    assert listed(simhash.near_duplicates(docs), "*") == want
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for i, _, c in want if i == c and i is not None})
    assert ids.count(None) == 2 and simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    fps, bucket = [], []
    for k, m in enumerate([1, 5, 3, 70, 200, 2, 64, 65]):
        base = rng.integers(0, 2 ** 63, 30, dtype=np.uint64)
        v = base[rng.integers(0, 30, m)]
        for _ in range(3):
            flip = rng.integers(0, 64, m, dtype=np.uint64)
            v = np.where(rng.random(m) < .5, v ^ (np.uint64(1) << flip), v)
        v = np.unique(v)
        fps.append(v)
        bucket.append(np.full(len(v), k))
    a, b = simhash._within(np.concatenate(fps).astype("<u8"), np.concatenate(bucket), radius)
    pairs = set(zip(a.tolist(), b.tolist()))
    for v in fps:
        want = brute.components([(k, int(x)) for k, x in enumerate(v)], radius)
        got = {int(x): int(x) for x in v}
        own = [(x, y) for x, y in pairs if x in got and y in got]
        for x, y in own:
            got[y] = x
        assert len({w for w in want}) == len({got[int(x)] for x in v})


def test_hot_buckets_change_nothing(spark):
    rng = np.random.default_rng(1)
    v = [int(x) for x in rng.integers(0, 1 << 20, 600)] + [int(x) << 40 for x in rng.integers(0, 1 << 20, 300)]
    fps = spark.createDataFrame([(x,) for x in set(v)], "fp bigint")
    want = brute.components([(x, x) for x in sorted(set(v))])
    for hot in (20, 100, 10_000):
        root = {r.node: r.root for r in simhash.components(simhash.links(fps, hot=hot)).collect()}
        assert [root.get(x, x) for x in sorted(set(v))] == want


def test_bpe_is_tiktoken(docs, rows, empty):
    import tiktoken
    path, pattern = vocabulary()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t or "")))
    assert listed(bpe.round_trip(docs, path, pattern), "*") == sorted(want, key=repr)
    back = bpe.decoded(bpe.encoded(docs, path, pattern), path)
    assert back.columns == docs.columns + ["input_ids", "n_tokens", "bytes"]
    assert all(bytes(r.bytes).decode() == (r.text or "") for r in back.collect())
    assert bpe.round_trip(empty, path, pattern).count() == 0
    rnd = random.Random(1)
    signs = list("ab '\n\t  sS  \x85\x1c é漢字1²½😀.!,́lreve") + ["'s", "'ll", "  ", "\r\n", " \n", "the", "of"]
    texts = ["".join(rnd.choices(signs, k=rnd.randint(0, 30))) for _ in range(3000)] + ["ab" * 500, "a" * 700, " " * 90]
    got = bpe.encoder(bpe.Vocabulary(ranks), pattern)(texts)
    assert [[i for u in x for i in u[0]] for x in got] == [enc.encode_ordinary(t) for t in texts]


def test_pii_base(docs, rows, empty):
    out = pii.found(docs)
    got = listed(out, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for i, t in rows:
        s = brute.pii(t)
        want.append((i, *[sum(x[3] == k for x in s) for k in pii.KINDS],
                     brute.sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in s))))
    assert got == sorted(want, key=repr) and pii.found(empty).count() == 0
    text = {i: t for i, t in rows}
    for r in pii.redacted(docs).collect():
        assert (r.text is None) == (text.get(r.doc_id) is None) or r.doc_id is None
        assert not any(x[3] == "email" for x in brute.pii(r.text))


def test_pii_disclosing_terms(spark):
    rnd = random.Random(2)
    texts = [prose(rnd, 30) + " plain words here" for _ in range(60)]
    for k in range(6):  # a nickname that stands by one address only, and common words that stand by it too
        texts.append(f"{prose(rnd, 20)} words Zebulon writes from zeb@mail.org plain {prose(rnd, 20)}")
    texts += [texts[-1]] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.found(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    for k, t in enumerate(texts):
        if "zeb@" not in t:
            assert spans[k] == "" and clean[k] == t
        else:
            a = t.index("Zebulon")
            assert f"removed:{a}:{a + 7}" in spans[k].split(",")
            assert "Zebulon" not in clean[k] and "[EMAIL]" in clean[k]
            assert not any(s.startswith(("removed", "generalised")) and
                           t[int(s.split(":")[1]):int(s.split(":")[2])] in ("plain", "words") for s in spans[k].split(","))


def test_pii_unique_values(spark):
    """Values that are in one text each: what stands by them only goes, common words stay."""
    rnd = random.Random(4)
    texts = [f"common {' '.join(rnd.choice(WORDS) for _ in range(20))} words" for _ in range(1200)]
    names = ["Quorlin", "Vestapol", "Drymoor", "Hexwick"]
    for k, name in enumerate(names):
        texts[k * 100] += f" common {name} wrote from box{k}@host{k}.org words"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: r.spans.split(",") for r in pii.found(docs).collect()}
    for k, name in enumerate(names):
        t, own = texts[k * 100], spans[k * 100]
        extra = {t[int(a):int(b)] for x, a, b in (s.split(":") for s in own) if x in ("removed", "generalised")}
        assert name in extra and not extra & {"common", "words", *WORDS}
    assert sum(s != [""] for s in spans.values()) == len(names)


def test_pii_whole_documents(spark):
    """A short name far from its value, an identifier, their other places, and a text without the value."""
    rnd = random.Random(6)
    fill = lambda n: " ".join(rnd.choice(WORDS) for _ in range(n))
    texts = [f"common {fill(25)} words" for _ in range(1500)]
    for k in range(8):
        texts[k] = f"Li \x01 {fill(40)} ab12x {fill(40)} li@mail.org {fill(40)} Li, {fill(3)}"
    texts[20] += " Li was here"
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3])], "doc_id bigint, text string")
    out = pii.found(docs).collect()
    assert len(out) == 1501
    for r in out:
        t = texts[r.doc_id]
        got = [t[int(a):int(b)] for x, a, b in (s.split(":") for s in r.spans.split(",") if s) if x in ("removed", "generalised")]
        assert got == (["Li", "ab12x", "Li"] if r.doc_id < 8 else ["Li"] if r.doc_id == 20 else [])
    clean = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert not any("Li" in t or "ab12x" in t or "li@" in t for t in clean.values())


@pytest.mark.parametrize("sizes", [(8_000_000, 20_000, 32_000_000), (3_000, 1, 5_000)])
def test_substrings(spark, docs, rows, empty, monkeypatch, sizes):
    for name, x in zip(("BLOCK", "HOT", "BUCKET"), sizes):
        monkeypatch.setattr(substrings, name, x)
    rnd = random.Random(4)
    line = "The common line that very many documents share, word for word, every time it is seen here."
    more = [(2000 + k, prose(rnd, 12) + line + prose(rnd, 12)) for k in range(40)] + [(3000, line * 3), (3001, "x" * 49)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string"))
    want = sorted(brute.substrings(rows + more), key=repr)
    assert listed(substrings.digests(every.repartition(3)), "*") == want
    assert substrings.digests(empty).count() == 0


def test_quality_rules(docs, rows, empty):
    out = quality_rules.rules(docs)
    got = listed(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t in rows:
        c = brute.base_counts(t) if len(t or "") < 20_000 else quality_rules.base_counts(t)
        want.append((i, *c, c[0] < 10 or 100 * c[4] > 20 * c[0]))
    assert got == sorted(want, key=repr)
    assert out.where("base_failed and kept").count() == 0 and quality_rules.rules(empty).count() == 0


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    code, n = np.unique(rng.integers(0, 5, 4000) * 33 + (rng.integers(0, 6, 4000) << 10), return_counts=True)
    model = quality_rules.kneser_ney(code, n)
    for context in np.unique(code >> 5)[:5].tolist() + [12345]:
        p = np.exp(quality_rules._lookup(model, (context << 5) + np.arange(32), quality_rules.ORDER))
        assert p.min() > 0 and abs(p.sum() - 1) < 1e-9
    for keys, *_ in model:
        assert (np.diff(keys) > 0).all()


def test_bands_reject_noise(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "and", "house", "garden", "little", "walked", "home"]) for _ in range(300))
             for _ in range(150)] + ["".join(rnd.choice("zqxjkvw 0123#") for _ in range(1500)) for _ in range(3)]
    d = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_rules.rules(d).where("not base_failed").collect()}
    assert all(kept[i] for i in kept if i < 150) and not any(kept[i] for i in kept if i >= 150)


@pytest.mark.parametrize("codes", [quality_rules.CODES if hasattr(quality_rules, "CODES") else 0, 1])
def test_languages_share_no_model(spark, monkeypatch, codes):
    """Languages whose hashes agree mod 64 (de and pl, es and th) are scored as if alone; null is one, too."""
    monkeypatch.setattr(quality_rules, "CODES", codes, raising=False)
    rnd = random.Random(8)
    own = {"de": "und haus garten klein gehen", "pl": "dom oraz ogród mały iść", "es": "casa jardín pequeño",
           "th": "baan suan lek", None: "alpha beta gamma", "=": "one two three", "": "four five six"}
    rows = [(len(own) * k + j, " ".join(rnd.choice(w.split()) for _ in range(40)), lang)
            for j, (lang, w) in enumerate(own.items()) for k in range(60 if lang == "de" else 8)]
    schema = "doc_id bigint, text string, lang string"
    both = {r.doc_id: (r.log_ppl, r.kept) for r in quality_rules.rules(spark.createDataFrame(rows, schema)).collect()}
    assert len(both) == len(rows)
    for lang in ("de", "pl"):
        alone = quality_rules.rules(spark.createDataFrame([r for r in rows if r[2] == lang], schema)).collect()
        assert {r.doc_id: (r.log_ppl, r.kept) for r in alone} == {r[0]: both[r[0]] for r in rows if r[2] == lang}


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    for n in (1, 5, 300, 1000):
        s, f = rng.normal(size=(n, 4)) * 3, rng.random(n) < .05
        f[0] = True
        v, back = s[0].copy(), []
        for t in range(1, n):
            jump = v.max() - (0 if f[t] else 5.0)
            back.append(np.where(v >= jump, np.arange(4), v.argmax()))
            v = np.maximum(v, jump) + s[t]
        path = [int(v.argmax())]
        for b in back[::-1]:
            path.append(int(b[path[-1]]))
        assert language.viterbi(s, f, 5.0).tolist() == path[::-1]


def test_language(spark, docs, empty):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.identify(d)
    both = out.join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(both) > 20 and np.mean([r.lang == r.lang_pred for r in both]) > 0.95
    model = language.fit(d)
    odd = {(r.doc_id, r.lang_pred) for r in language.identify(docs, model).collect()}
    assert (0, "und") in odd and (7, "und") in odd
    assert language.identify(empty).count() == 0
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", common.F.lit(None).cast("string"))).collect()} == {"und"}
    mixed = language.Decoder(model)
    de, en = (next(r.text for r in d.where(f"lang = '{x}' and n_chars between 300 and 3000").collect()) for x in ("de", "en"))
    path, letters = mixed([de + " " + en])[0]
    names = [model["langs"][k] for k in path]
    assert names[5] == "de" and names[-5] == "en" and sum(a != b for a, b in zip(names, names[1:])) <= 6


@pytest.mark.parametrize("operator, label", [(quality.classify, "quality"), (toxicity.toxicity, "toxic")])
def test_classifiers(spark, docs, empty, operator, label):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = operator(d, labels)
    rows = out.join(labels, "doc_id").where("held_out").collect()
    y, s = np.array([r[label] for r in rows]), np.array([r.score for r in rows])
    assert out.count() == d.count() and 0 <= s.min() and s.max() <= 1
    assert np.mean(y == [r.predicted for r in rows]) > (0.95 if label == "quality" else 0.8)
    none = labels.where("doc_id < 0")
    assert operator(docs, none).count() == docs.count() and operator(empty, labels).count() == 0
    twice = labels.unionByName(labels).unionByName(labels.limit(3).withColumn(label, common.F.lit(None).cast("int")))
    again = {r.doc_id: r.score for r in operator(d, twice).collect()}
    assert again == {r.doc_id: r.score for r in out.collect()}


def test_toxic_windows_are_found(spark):
    rnd = random.Random(6)
    texts, labels = [], []
    for k in range(600):
        w, bad = prose(rnd, 80).split(), k % 4 == 0
        if bad:
            for _ in range(3):
                w.insert(rnd.randrange(80), rnd.choice(["blockhead", "numskull", "dimwitted"]))
        texts.append((k, " ".join(w)))
        labels.append((k, int(bad)))
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    out = toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id bigint, toxic int")).where("held_out").collect()
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in out]) > 0.95
    kept = {r.doc_id for r in toxicity.clean(d, spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()}
    assert {r.doc_id for r in out if not r.predicted} <= kept and not {r.doc_id for r in out if r.predicted} & kept


def test_toxic_phrases_long_texts_and_ties(spark):
    """Ordinary words that are toxic side by side only; one long word, one long text, a score of 0.5."""
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(4, 9))) for _ in range(400)]
    left, right = words[7], words[9]
    texts = []
    for k in range(800):
        w = rnd.choices(words, k=80)
        for _ in range(4):
            at = rnd.randrange(70)
            w[at:at + 2] = [left, right] if k % 4 == 0 else rnd.choice([[right, left], [left], [right]])
        texts.append((k, " ".join(w)))
    odd = [(900, "x" * 200_000), (901, " ".join(rnd.choices(words, k=40_000))), (902, f"{left} {right} " * 3)]
    d = spark.createDataFrame(texts + odd, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(800)], "doc_id bigint, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    assert len(out) == 803 and [out[k].predicted for k in (900, 901, 902)] == [0, 0, 1]
    assert np.mean([r.predicted == (k % 4 == 0) for k, r in out.items() if r.held_out and k < 800]) > 0.9  # pairs can overwrite one another
    one = {"ordinary": b"", "toxic": b"", "x": [0.0], "y": [0.5]}
    assert {r.score for r in toxicity.scored(d, one, ["doc_id"]).collect()} == {0.5}


def test_chat(spark):
    t = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (2, 1, "bot", "yo"), (2, 2, "user", None),
         (3, 0, "user", "hi"), (4, 0, "user", "hi"), (4, 1, "bot", "yo"), (4, 2, "user", None), (5, 0, "user", None),
         (6, 0, "user", ""), (7, 1, "bot", "b"), (7, 0, "user", "a"), (7, 0, "user", "a"), (None, 0, "user", "x"),
         (8, None, None, "z"), (9, 0, "use", "rhi")]
    turns = spark.createDataFrame(t, "conv_id bigint, turn int, role string, text string")
    out = {r.conv_id: (r.n_turns, r.text) for r in chat.render(turns).collect()}
    assert sorted(out) == [2, 5, 6, 7, 8, 9]
    assert out[7] == (2, "<|im_start|>user\na<|im_end|>\n<|im_start|>bot\nb<|im_end|>\n") and out[2][0] == 3
    assert chat.render(turns.limit(0)).count() == 0


def test_chat_long_conversations(spark):
    """Rolling hashes across block borders, and a long conversation that was logged at every such border."""
    turns = [(c, k, "user", f"say {k % 7}") for c, n in enumerate([1, 255, 256, 257, 512, 513, 4000]) for k in range(n)]
    turns += [(9, k, "user", f"say {k % 7}" if k < 3999 else "other") for k in range(4000)]
    d = spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string")
    for r in chat.prefix_hashes(d).collect():
        last, want = "", []
        for _, _, role, text in sorted(t for t in turns if t[0] == r.conv_id):
            one = brute.sha(f"{len(role)}:{role}{len(text)}:{text}")
            last = brute.sha(last + one)
            want.append(last)
        assert r.prefixes == want and r.n_turns == len(want)
    assert sorted(r.conv_id for r in chat.maximal(d).collect()) == [6, 9]


def test_pipeline(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SF)
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert out.columns == d.columns + ["input_ids", "n_tokens"] and 0 < out.count() < d.count()
    path, _ = vocabulary()
    assert all(bytes(r.bytes).decode() == r.text for r in bpe.decoded(out, path).collect())
    strange = d.limit(60).withColumn("score", common.F.lit("x")).withColumn("n_tokens", common.F.lit("y")) \
        .unionByName(d.limit(3).withColumn("score", common.F.lit(None).cast("string")).withColumn("n_tokens", common.F.lit("y")))
    for _, stage in corpus_pipeline.STAGES:
        strange = stage(spark, strange, SF)
    assert strange.count() > 0 and strange.columns[:len(d.columns)] == d.columns
    none = d.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
    assert none.count() == 0


@pytest.mark.parametrize("key", ["op4_decontaminate", "op5_chat"])
def test_oracles(spark, key):
    from vatlens.llm.oracle import SQL
    from vatlens.llm.queries import QUERIES
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(SQL[key]).df()
    got = QUERIES[key](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(repr, got.astype(object).itertuples(index=False, name=None))) == \
        sorted(map(repr, want.astype(object).itertuples(index=False, name=None)))


def test_one_row_of_each_component(spark):
    rows = [(1, "alpha beta gamma delta", "x"), (2, "alpha beta gamma delta", "x"), (2, "something wholly different here now", "y"),
            (2, "something wholly different here now", "z"), (3, "Something WHOLLY different here now", "x"), (None, "alpha beta gamma delta", "x"),
            (4, "yet another text of its own", "x"), (4, "one more text under that number", "x"), (5, None, "x"), (6, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _hx string").repartition(3)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, rows[0][1]), (2, rows[2][1]), (4, rows[6][1]), (4, rows[7][1]), (5, None), (None, rows[0][1])], key=repr)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_every_language_is_kept(spark):
    """More languages than a task holds counts of, each with its own syllables."""
    rnd = random.Random(4)
    tongues = {f"l{k:03}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(3)) for _ in range(6)] for k in range(140)}
    rows = [(k * 10 + i, " ".join(rnd.choice(s) + rnd.choice(s) for _ in range(30)), lang)
            for k, (lang, s) in enumerate(tongues.items()) for i in range(8)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string, lang string").repartition(3)
    out = language.identify(docs).join(docs.select("doc_id", "lang").distinct(), "doc_id").collect()
    assert len({r.lang_pred for r in out}) == 140
    assert np.mean([r.lang_pred == r.lang for r in out if r.held_out]) > 0.97


@pytest.mark.parametrize("stretches, bucket", [(substrings.STRETCHES, 40), (4, 2_000)])
def test_more_buckets_than_sampled_keys(spark, docs, rows, monkeypatch, stretches, bucket):
    """Segments spread over the buckets also where the sample has fewer keys than are wanted, or the splitters are bounded."""
    for name, x in (("BLOCK", 3_000), ("BUCKET", bucket), ("STRETCHES", stretches), ("SAMPLED", 29)):
        monkeypatch.setattr(substrings, name, x)
    two = docs.select("doc_id", "text").repartition(3)
    blocks = substrings._blocks(two).cache()
    total = sum(len((t or "").encode()) for _, t in rows)
    cuts = substrings._splitters(blocks, total)
    wanted, share = substrings._buckets(total)
    if share == 1:
        assert 100 < len(cuts) < wanted - 1  # every sampled key is a splitter
    shared = spark.sparkContext.broadcast(cuts)
    sizes = [r["n"] for r in substrings._entries(blocks, shared, share).groupBy("bucket").agg(common.F.sum("n").alias("n")).collect()]
    assert len(sizes) > min(len(cuts) + 1, stretches) * share / 2 and max(sizes) < sum(sizes) / 4
    assert listed(substrings.digests(two), "*") == sorted(brute.substrings(rows), key=repr)


def test_code_points_beyond_the_first_plane_have_their_own_class():
    table = quality_rules._classes()
    # a mathematical bold a and a digit of that kind, a letter of another script, a sign
    codes = quality_rules._codes("\U0001D41A\U0001D7CE\U00010400\U0001F600", table)[:4] & 31
    assert codes.tolist() == [quality_rules._class(ord(c)) for c in "\U0001D41A\U0001D7CE\U00010400\U0001F600"]
    assert codes[1] == quality_rules._DIGIT and codes[2] in (26, 27) and codes[3] == quality_rules._SIGN
    assert (quality_rules._codes("abc", table)[:3] & 31).tolist() == [0, 1, 2]


def test_no_letter_counts_as_another(spark):
    """The model's n-grams are those of code points, so letters in senseless places show in any script."""
    texts = ["Ab. ab Ωω 漢字漢字", "x", "\U0001F600\U0001D7CE same", "aaaa", "aaaa", None, "  "]
    d = spark.createDataFrame([(i, t, "en" if i else None) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    want = {}
    for i, t in enumerate(texts):
        if t and t.strip():
            p = [0, 0, 0, *(ord(c) + 1 for c in t), 0]
            for k in range(len(p) - 3):
                gram = ("=en" if i else "", (p[k] << 32) | p[k + 1], (p[k + 2] << 32) | p[k + 3])
                want[gram] = want.get(gram, 0) + 1
    assert {(r["key"], r["first"], r["last"]): r["n"] for r in quality_rules.ngram_counts(d).collect()} == want

    rnd = random.Random(5)
    words = ["привет", "дорога", "берег", "солнце", "зима", "небо"]
    # the same classes of even and odd code points, but letters that never stand there
    other = ["".join(chr(ord(c) + 2 * rnd.randrange(-3, 4)) for c in w) for w in words for _ in range(9)]
    texts = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(120)] + [" ".join(rnd.choice(other) for _ in range(300)) for _ in range(3)]
    d = spark.createDataFrame([(i, t, "ru") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality_rules.rules(d).where("not base_failed").collect()}
    assert all(kept[i] for i in kept if i < 120) and kept and not any(kept.get(i, False) for i in range(120, 123))


def test_an_alphabet_of_any_size():
    points = np.arange(1 << 16)
    large = quality_rules._Alphabet(points)
    text = "".join(map(chr, (5, 900, 40_000, 900, 5)))
    code = large.codes(quality_rules._points(text))
    first, last = large.columns(code)
    p = quality_rules._points(text).tolist()
    assert [(int(a) >> 32, int(a) & 0xFFFFFFFF, int(b) >> 32, int(b) & 0xFFFFFFFF) for a, b in zip(first, last)] == \
        [tuple(p[k:k + 4]) for k in range(len(p) - 3)]
    code, n = np.unique(code, return_counts=True)
    model = quality_rules.kneser_ney(code, n, large.bits, 1 << 16)
    assert np.isfinite(quality_rules._lookup(model, code, quality_rules.ORDER, large.bits, 1 << 16)).all()
