"""Maximal conversations of a log of snapshots, rendered (operator 6); DataFrame functions only.

A chat that is logged after each turn leaves snapshots that are prefixes of
the last one. Every turn knows a rolling hash of the turns before it: an exclusive-or of hashes
that hold the place of each turn, so it depends on their order. A conversation whose whole hash is the
hash of the first turns of a longer one is dropped by an anti-join; of equal ones the
smallest conv_id stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answerloom.llm.batches import running

#: Turns that one rendered row holds; a longer conversation has several rows.
PART = 64
#: Turns whose running hash is made in one task, by turn number.
STRETCH = 1024


def _code(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), "place", F.isnull("role"), F.coalesce("role", F.lit("")), F.isnull("text"), F.coalesce("text", F.lit("")))


def placed(turns: DataFrame) -> DataFrame:
    """The turns with ``place`` (from 0) and the hashes of all turns before, ``before_a`` and ``before_b``."""
    rows = turns.select("conv_id", "turn", "role", "text", F.lit(1).alias("one"))
    stretch = F.floor(F.col("turn") / STRETCH)
    order = ["turn", "role", "text"]
    rows = running(rows, ["conv_id"], stretch, order, {"place": (F.sum, "one")}).drop("one")
    coded = rows.withColumns({"code_a": _code(1), "code_b": _code(2)})
    return running(coded, ["conv_id"], stretch, ["place"], {"before_a": (F.bit_xor, "code_a"), "before_b": (F.bit_xor, "code_b")})


def maximal(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations to keep, from placed turns."""
    whole = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.bit_xor("code_a").alias("a"), F.bit_xor("code_b").alias("b"))
    kept = whole.groupBy("n_turns", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    prefixes = rows.filter("place > 0").select(F.col("place").alias("n_turns"), F.col("before_a").alias("a"), F.col("before_b").alias("b")).distinct()
    return kept.join(prefixes, ["n_turns", "a", "b"], "left_anti").select("conv_id", "n_turns")


def rendered_turn() -> Column:
    return F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n"))


def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, text) of every maximal conversation, ``PART`` turns a row.

    Turns are ordered by turn, role and text; repeated rows are turns of
    their own, and null and empty roles or texts differ from each other in comparison and look alike when rendered. Rows
    without conv_id are one conversation. Turn numbers matter for the order only. An empty table gives no row; other columns are
    not read.
    """
    rows = placed(turns)
    kept = maximal(rows).select(F.col("conv_id").alias("kept"))
    own = rows.join(kept, F.col("conv_id").eqNullSafe(F.col("kept")), "left_semi")
    part = F.floor(F.col("place") / PART).alias("part")
    lines = F.array_sort(F.collect_list(F.struct("place", rendered_turn().alias("line"))))
    return own.groupBy("conv_id", part).agg(
        F.count("*").alias("n_turns"), F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("text")
    )
