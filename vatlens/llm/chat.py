"""Chat formatting: maximal conversations, rendered.

A conversation that was logged again after each turn leaves snapshots that are
prefixes of the last one. Each prefix of a conversation gets a rolling hash:
the hash of the prefix one turn shorter and of the turn. A conversation is kept if
its whole hash is no proper prefix hash of any other, and of equal conversations
the smallest conv_id is kept. Both are joins on hashes that were made distinct
first, so a very common conversation or first turn is one row on either side.

Hashes are 256 bits (SHA-2), over turns encoded so that null, empty and
delimiters in a text cannot be confused. The turn texts are not shuffled with the
hashes; only maximal conversations are rendered.

Defined results: turns are ordered by turn, role and hash (nulls first); repeated
rows of a conversation count once; rows without a conv_id belong to no
conversation and are dropped; a null role or text is rendered as empty; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vatlens.llm.common import saved

#: The default template of a turn; {role} and {text} are filled in.
TEMPLATE = "<|im_start|>{role}\n{text}<|im_end|>\n"
#: Turns of a conversation whose prefix hashes are listed at a time.
BLOCK = 256


def _length_first(c):
    """A value that says where it ends and whether it is null."""
    c = F.col(c)
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.length(c).cast("string"), F.lit(":"), c))


def _turn_hash():
    return F.sha2(F.concat(_length_first("role"), _length_first("text")), 256)


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, prefixes``: the rolling hash after each turn, first to last."""
    rows = turns.where(F.col("conv_id").isNotNull()) \
        .select("conv_id", "turn", "role", _turn_hash().alias("hash")).distinct()
    lists = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", "hash"))).alias("turns"))
    # block by block, as a list that grows is copied at every turn
    block = lambda i: F.slice("turns", i * BLOCK + 1, F.lit(BLOCK))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("turns") - 1) / BLOCK).cast("int")), block)

    def rolled(last, turns):
        after = F.aggregate(turns, F.array(last), lambda acc, x: F.concat(
            acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), x["hash"]), 256))))
        return F.slice(after, F.lit(2), F.size(turns))

    every = F.aggregate(blocks, F.array(F.array(F.lit(""))), lambda acc, b: F.concat(
        acc, F.array(rolled(F.element_at(F.element_at(acc, -1), -1), b))))
    return lists.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"),
                        F.slice(F.flatten(every), 2, F.size("turns")).alias("prefixes"))


def maximal(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, hash`` of the conversations that are prefix of no other one."""
    every = saved(prefix_hashes(turns), "prefixes")
    whole = every.groupBy(F.element_at("prefixes", -1).alias("hash")) \
        .agg(F.min("conv_id").alias("conv_id"), F.first("n_turns").alias("n_turns"))
    proper = every.where(F.col("n_turns") > 1).select(
        F.explode(F.slice("prefixes", F.lit(1), (F.col("n_turns") - 1).cast("int"))).alias("hash")).distinct()
    return whole.join(proper, "hash", "left_anti").select("conv_id", "n_turns", "hash")


def render(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """``conv_id, n_turns, text`` of the maximal conversations."""
    kept = saved(maximal(turns), "maximal")
    before, between, after = _parts(template)
    turn = lambda x: F.concat(F.lit(before), F.coalesce(x["role"], F.lit("")), F.lit(between),
                              F.coalesce(x["text"], F.lit("")), F.lit(after))
    rows = turns.select("conv_id", "turn", "role", _turn_hash().alias("hash"), "text") \
        .join(kept.select("conv_id"), "conv_id", "left_semi")
    texts = rows.distinct().groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", "hash", "text"))).alias("_turns"))
    return texts.join(kept, "conv_id").select(
        "conv_id", "n_turns", F.concat_ws("", F.transform("_turns", turn)).alias("text"))


def _parts(template: str) -> tuple[str, str, str]:
    before, rest = template.split("{role}")
    between, after = rest.split("{text}")
    return before, between, after
