r"""Personal data by pattern and by disclosure (built-in functions only).

Base spans are the matches of four patterns. The method then looks for terms that
give a protected value away: with N documents, a term t and a value e of which ``df``
documents hold them, ``PMI(t; e) = log2(N df(t, e) / (df(t) df(e)))`` bits of the
``IC(e) = log2(N / df(e))`` bits that name e are disclosed by t. There is no least
number of texts: the share ``df(t, e) / df(t)`` is taken at its lower confidence bound
(Wilson, ``Z`` standard errors, copies of a text apart), so a term seen with a value once
counts for less than one seen with it always, and common words, whose df(t) is large,
never pass. A term is generalised where it surely discloses ``GENERALISE`` of the bits,
and removed where the estimate is ``REMOVE`` or more and more than half of its texts surely
hold e. e is a whole value or a part that different values share (name or host of an
address, network of an ip, issuer of a card, exchange of a phone), so values that occur
once have evidence, too. Terms are words of letters and digits of any length, counted
over whole documents outside their base spans, df(t) over every different word of every
document. Every place of such a term goes, in documents with and without a value. A run
of letters is one word, so names within text without spaces are not seen apart.

Patterns are the contract's, rewritten for the engine so that no text makes it
backtrack: possessive repeats where the next sign cannot be part of the repeat,
and a match can only start where a run starts or where the last match ended.

Skew: the counts are sums with partial aggregation, and common words meet the counts
of all documents only as one row each; terms of one text meet its rarest entity only,
so no text gives its terms times its values; spans of a document are its own.

Defined results: a null text is an empty one and stays null when redacted;
overlapping spans of different kinds all count, and their union is replaced;
repeated rows each get their row; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vatlens.llm.common import saved, same_row, small

KINDS = ["email", "ip", "card", "phone"]
_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:(?<![{_MAIL}])|\G)[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?(?:\.|$)){4}$"
GENERALISE, REMOVE = 0.8, 0.95
#: Standard errors of the lower bound (95 % one-sided).
Z = 1.645
#: Signs of a word; a mark between pieces of a text, and what stands for that sign in it.
_WORD, _MARK, _OTHER = r"\p{L}\p{M}\p{N}", "\x01", "\x02"


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return {"email": F.lit(True),
            "ip": m.rlike(_PARTS),
            "card": F.length(digits).between(12, 19) & F.call_function("luhn_check", digits),
            "phone": F.length(digits).between(9, 15)}[kind]


def base_spans(docs: DataFrame) -> DataFrame:
    """``_id, _h, _m, kind, start, end, value``: one row per base span of each
    different row of ``docs``, which occurs ``_m`` times; ``end`` is exclusive, both count
    code points."""
    rows = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), "text")
    each = F.explode(F.array(*[F.struct(
        F.lit(k).alias("kind"), F.split("text", PATTERNS[k], -1).alias("gaps"),
        F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)).alias("found")) for k in KINDS]))
    # gaps and matches alternate, so their lengths add up to the places
    found = rows.where(F.col("text").rlike("[0-9@]")).select("_id", "_h", each.alias("_e")) \
        .where(F.size("_e.found") > 0) \
        .select("_id", "_h", "_e.kind", F.posexplode(F.arrays_zip("_e.gaps", "_e.found")).alias("_n", "_z")) \
        .select("_id", "_h", "kind", "_n", F.col("_z.found").alias("value"),
                F.length("_z.gaps").alias("_gap"), F.length("_z.found").alias("_len")) \
        .groupBy("_id", "_h", "kind", "_n", "value", "_gap", "_len").agg(F.count("*").alias("_m"))
    w = Window.partitionBy("_id", "_h", "kind").orderBy("_n")  # the spans of one text
    placed = found.withColumn("end", F.sum(F.col("_gap") + F.coalesce("_len", F.lit(0))).over(w)) \
        .where(F.col("value").isNotNull())
    valid = F.lit(False)
    for k in KINDS:
        valid = valid | ((F.col("kind") == k) & _valid(k, F.col("value")))
    return placed.where(valid).select("_id", "_h", "_m", "kind", (F.col("end") - F.col("_len")).alias("start"), "end",
                                      "value")


def _terms(text: Column) -> Column:
    """Different lower-case words of a text, of any length."""
    return F.array_distinct(F.filter(F.split(F.lower(text), f"[^{_WORD}]+", -1), lambda w: F.length(w) > 0))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), "text")


def held_texts(docs: DataFrame, spans: DataFrame, keys: DataFrame) -> DataFrame:
    """``_id, _h, _m, text``: the different rows that have base spans, with blanks in their place."""
    of_row = spans.groupBy("_id", "_h").agg(F.first("_m").alias("_m"), F.sort_array(F.collect_list(
        F.struct("start", "end", "kind"))).alias("_spans")).withColumn("_spans", _merged(F.col("_spans")))
    rows = _rows(docs)
    rows = rows.join(small(keys), same_row(rows, keys), "left_semi")
    blank = _replaced(F.col("text"), F.col("_spans"), lambda s: F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")))
    return rows.join(of_row, same_row(rows, of_row)).select(rows["_id"], rows["_h"], "_m", blank.alias("text")) \
        .groupBy("_id", "_h").agg(F.first("_m").alias("_m"), F.first("text").alias("text"))


def places(texts: DataFrame) -> DataFrame:
    """``_id, _h, term, start, end``: where the words ``terms`` of each ``text`` are."""
    word, text = f"[{_WORD}]+", F.translate("text", _MARK, _OTHER)
    cut = texts.select("_id", "_h", "terms", F.split(text, word, -1).alias("gaps"),
                       F.regexp_extract_all(text, F.lit(word), F.lit(0)).alias("found"))
    # marks beside the asked-for words only: a text gives two rows a place, not one a word
    marked = F.concat_ws("", F.transform(F.arrays_zip("gaps", "found"), lambda z: F.concat(z["gaps"], F.when(
        F.array_contains("terms", F.lower(z["found"])), F.concat(F.lit(_MARK), z["found"], F.lit(_MARK)))
        .otherwise(F.coalesce(z["found"], F.lit(""))))))
    pieces = cut.select("_id", "_h", F.posexplode(F.split(marked, _MARK, -1)).alias("_n", "_p")) \
        .select("_id", "_h", "_n", F.length("_p").alias("_len"), F.when(F.col("_n") % 2 == 1, F.lower("_p")).alias("term")) \
        .distinct()
    w = Window.partitionBy("_id", "_h").orderBy("_n")
    return pieces.withColumn("end", F.sum("_len").over(w)).where(F.col("term").isNotNull()) \
        .select("_id", "_h", "term", (F.col("end") - F.col("_len")).alias("start"), "end")


def entities(spans: DataFrame) -> DataFrame:
    """``_h, entity, _m``: the values of each text, and the parts that other values may share; ``_m`` rows have it."""
    value, digits = F.lower("value"), F.regexp_replace("value", "[^0-9]", "")
    whole = F.when(F.col("kind").isin("card", "phone"), digits).otherwise(value)
    part = F.when(F.col("kind") == "email", F.substring_index(value, "@", 1)) \
        .when(F.col("kind") == "ip", F.substring_index(value, ".", 3)) \
        .when(F.col("kind") == "card", F.substring(digits, 1, 6)) \
        .otherwise(F.expr("substring(regexp_replace(value, '[^0-9]', ''), 1, length(regexp_replace(value, '[^0-9]', '')) - 4)"))
    host = F.when(F.col("kind") == "email", F.substring_index(value, "@", -1))
    named = lambda name, c: F.concat(F.col("kind"), F.lit(f"-{name}:"), c)
    every = F.array(named("whole", whole), named("part", part), named("host", host))
    return spans.select("_id", "_h", "_m", F.explode(F.array_compact(every)).alias("entity")).distinct() \
        .groupBy("_h", "entity").agg(F.sum("_m").alias("_m"))


def told_by(n: int, df_t: Column, df_e: Column, df_te: Column, support: Column) -> Column:
    """``action`` on a term that ``support`` different texts show with an entity; null for none."""
    p = F.least(F.lit(1.0), df_te / df_t)
    m = support / p  # different texts that hold the term: copies are no evidence
    z = Z * Z / m
    least = (p + z / 2 - F.sqrt(p * (1 - p) * z + z * z / 4)) / (1 + z)
    names = F.log2(F.lit(float(n)) / df_e)
    share = lambda q: (names + F.log2(q)) / F.greatest(names, F.lit(1e-9))
    return F.when(share(least) >= GENERALISE, F.when(
        (share(p) >= REMOVE) & (least >= 0.5), "removed").otherwise("generalised"))


def disclosures(docs: DataFrame, spans: DataFrame, words: DataFrame) -> DataFrame:
    """``term, action, far``: terms that disclose a value, or a part of it, beyond the
    thresholds; ``far`` if texts without values hold them, too."""
    texts = docs.where(F.col("text").isNotNull())
    n = texts.count() or 1
    held = saved(entities(spans), "entities")
    held = saved(held.join(held.groupBy("entity").agg(F.sum("_m").alias("df_e")), "entity").select("_h", "entity", "df_e"),
                 "entity-counts")
    by_text = saved(words.groupBy("term", "_h").agg(F.sum("_m").alias("_m")), "held-terms")
    # every different word of every document, added up before it meets a pair
    of_term = texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))
    # the bound grows with the texts and shrinks with df_e: what fails for all texts and df_e = 1 fails for any entity
    asked = by_text.groupBy("term").agg(F.sum("_m").alias("held_t"), F.count("*").alias("support")).join(of_term, "term") \
        .where(told_by(n, F.col("df_t"), F.lit(1), F.col("held_t"), F.col("support")).isNotNull())
    asked = saved(asked, "asked-terms")
    rows = by_text.join(asked, "term")
    # a term of one text is judged by the rarest entity there, as all of them share its counts
    rarest = held.groupBy("_h").agg(F.min("df_e").alias("df_e"))
    single = rows.where("support = 1").join(rarest, "_h").select(
        "term", "df_t", "held_t", "df_e", F.col("_m").alias("df_te"), F.lit(1).cast("bigint").alias("support"))
    several = rows.where("support > 1").select("term", "df_t", "held_t", "_h", "_m").join(held, "_h") \
        .groupBy("term", "entity", "df_t", "held_t", "df_e").agg(F.sum("_m").alias("df_te"), F.count("*").alias("support"))
    action = told_by(n, *[F.col(c) for c in ("df_t", "df_e", "df_te", "support")])
    return single.unionByName(several.drop("entity")).withColumn("action", action).where(F.col("action").isNotNull()) \
        .groupBy("term").agg(F.max("action").alias("action"),  # removed, if any entity asks for it
                             F.max(F.col("df_t") > F.col("held_t")).alias("far"))


def all_spans(docs: DataFrame) -> DataFrame:
    """``_id, _h, spans``: the spans of each text that has any, sorted by start, then kind as listed."""
    spans = saved(base_spans(docs), "base-spans")
    keys = saved(spans.select("_id", "_h").distinct(), "held-keys")
    held = saved(held_texts(docs, spans, keys), "held")
    words = saved(held.select("_id", "_h", "_m", F.explode(_terms(F.col("text"))).alias("term")), "held-words")
    told = saved(disclosures(docs, spans, words), "disclosures")
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    grouped = lambda w: saved(w.groupBy("_id", "_h").agg(F.collect_set("term").alias("terms")), "terms")
    near = grouped(words.join(small(told.select("term")), "term"))
    # the other texts that hold a disclosing term
    rows = _rows(docs)
    rows = rows.join(small(keys), same_row(rows, keys), "left_anti")
    far = grouped(rows.select("_id", "_h", F.explode(_terms(F.col("text"))).alias("term")).join(
        small(told.where("far").select("term")), "term", "left_semi"))
    some = far.select("_id", "_h")
    rows = rows.join(small(some), same_row(rows, some), "left_semi")
    texts = [a.join(b, same_row(a, b)).select(a["_id"], a["_h"], "text", "terms") for a, b in ((held, near), (rows, far))]
    # values are blank there, so no place lies in a base span
    extra = places(texts[0]).unionByName(places(texts[1])).join(small(told), "term")
    base = spans.select("_id", "_h", "start", "end", order[F.col("kind")].alias("_k"), "kind")
    every = base.unionByName(extra.select("_id", "_h", "start", "end", F.lit(len(KINDS)).alias("_k"),
                                          F.col("action").alias("kind")))
    return every.groupBy("_id", "_h").agg(F.sort_array(F.collect_list(
        F.struct("start", "_k", "end", "kind"))).alias("spans"))


def _merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones as one, named by the first."""
    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), lambda acc, s: F.when(
        (F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"),
            F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
            F.element_at(acc, -1)["kind"].alias("kind"))))
    ).otherwise(F.concat(acc, F.array(F.struct(s["start"], s["end"], s["kind"])))))


def _replaced(text: Column, spans: Column, name) -> Column:
    """``text`` with ``name(span)`` for each of its merged spans."""
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
    piece = lambda s, i: F.concat(
        F.substring(text, (before(i) + 1).cast("int"), (s["start"] - before(i)).cast("int")), name(s))
    tail = F.substring(text, (F.element_at(spans, -1)["end"] + 1).cast("int"), F.length(text))
    return F.concat(F.concat_ws("", F.transform(spans, piece)), tail)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def found(docs: DataFrame) -> DataFrame:
    """``doc_id``, a count per kind, ``base_sha256`` and ``spans`` for every row of ``docs``."""
    spans = all_spans(docs)
    rows = docs.select("doc_id", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"))
    every = F.coalesce("spans", F.array().cast("array<struct<start:bigint,_k:int,end:bigint,kind:string>>"))
    base = F.filter(every, lambda s: s["_k"] < len(KINDS))

    def count(kind):
        return F.size(F.filter(every, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return rows.join(spans, same_row(rows, spans), "left").select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(every).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced: base values by ``[KIND]``, generalised
    terms by ``[TERM]``, removed terms by nothing; all columns kept."""
    spans = all_spans(docs)
    spans = spans.select(F.col("_id"), F.col("_h"), _merged(F.col("spans")).alias("_spans"))
    text = F.col("_row.text")
    name = lambda s: F.when(s["kind"] == "removed", F.lit("")).when(s["kind"] == "generalised", F.lit("[TERM]")) \
        .otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    new = F.when(F.col("_spans").isNull(), text).otherwise(_replaced(text, F.col("_spans"), name))
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id2"),
                       F.xxhash64("text").alias("_h2"))
    out = rows.join(spans, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_h") == F.col("_h2")), "left")
    return out.select(*[new.alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
