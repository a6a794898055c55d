"""Chat formatting: collapse cumulative snapshots, then render.

A logger that writes a conversation again after every turn leaves many conversations that are prefixes of longer ones.
Each turn is hashed with its position, role and text; the running XOR of these hashes along a conversation is a rolling
hash of its turn prefixes.  A conversation whose whole hash is the hash of a proper prefix elsewhere, or whose twin has
a smaller conv_id, is dropped by an anti-join; what stays is maximal and is rendered.

All turns are dealt by ranges of (conversation, turn, role, text), so blocks of a conversation are runs of its sorted
turns, however its turns are numbered, and a single huge conversation is spread over many tasks, also where all its
turns are equal.  Positions and prefix hashes are made in each block and joined up over the blocks, as XOR composes.

Each maximal conversation is one row, whose text must fit into one value.  ``chunked=True`` gives a row for each block
of it instead, numbered by ``chunk``, for conversations that are too large for that.

Defined cases: turns are ordered by turn, then role, then text's digest, nulls first, and repeated rows are repeated
turns; a null role or text is rendered as an empty one but differs from it when compared; turns whose conv_id is null
are one conversation, which is dropped if another one continues or repeats it; of twins the smallest conv_id stays; very
long texts are rendered whole; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import Staged

_CONV = ["none", "conv"]
_KEY = [*_CONV, "block"]
_ORDER = ["turn", "role", "null", "digest"]


def _hash(seed: int, *columns):
    return F.xxhash64(F.lit(seed), *columns)


def blocks_of(turns: DataFrame, staged: Staged) -> DataFrame:
    """Turns with a null-free conversation key, their block (from the range that they were dealt to), and a digest."""
    null = F.concat(F.when(F.col("role").isNull(), F.lit("r")).otherwise(F.lit("-")), F.when(F.col("text").isNull(), F.lit("t")).otherwise(F.lit("-")))
    conv = F.col("conv_id").cast("long")
    rows = turns.select(
        conv.isNull().alias("none"),
        F.coalesce(conv, F.lit(0)).alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        null.alias("null"),
        F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"),
        F.col("text").cast("string").alias("text"),
        F.rand(7).alias("salt"),  # equal rows may be told apart, so that they don't meet in one task
    )
    dealt = rows.repartitionByRange(*_CONV, *_ORDER, "salt").drop("salt")
    return staged.write(dealt.withColumn("block", F.spark_partition_id().cast("long")))


def prefixes(rows: DataFrame, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """Rolling prefix hashes (key, place, total, h1, h2) and blocks (key, total, w1, w2).

    ``place`` counts from 1, ``total`` is the conversation's number of turns and w1, w2 the hash of the whole.
    """
    along = Window.partitionBy(*_CONV).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*_CONV)
    counts = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"))
    counts = staged.write(counts.select(*_KEY, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total")))
    inside = Window.partitionBy(*_KEY).orderBy(*[F.asc_nulls_first(c) for c in _ORDER])
    placed = rows.select(*_KEY, *_ORDER, F.row_number().over(inside).alias("within")).join(counts.hint("merge"), _KEY).withColumn("place", F.col("before") + F.col("within"))
    keyed = placed.select(*_KEY, "place", "total", *[_hash(s, "place", "role", "digest", "null").alias(f"t{s}") for s in (1, 2)])
    running = Window.partitionBy(*_KEY).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    local = staged.write(keyed.select(*_KEY, "place", "total", *[F.expr(f"bit_xor(t{s})").over(running).alias(f"l{s}") for s in (1, 2)]))
    # a block's own hash is that of its last turn
    ends = local.groupBy(*_KEY).agg(F.max("total").alias("total"), *[F.max_by(f"l{s}", "place").alias(f"b{s}") for s in (1, 2)])
    blocks = staged.write(ends.select(*_KEY, "total", *[F.coalesce(F.expr(f"bit_xor(b{s})").over(along), F.lit(0)).alias(f"p{s}") for s in (1, 2)], *[F.expr(f"bit_xor(b{s})").over(whole).alias(f"w{s}") for s in (1, 2)]))
    rolled = local.join(blocks.select(*_KEY, "p1", "p2").hint("merge"), _KEY)
    return rolled.select(*_KEY, "place", "total", *[F.col(f"l{s}").bitwiseXOR(F.col(f"p{s}")).alias(f"h{s}") for s in (1, 2)]), blocks


def maximal(rows: DataFrame, staged: Staged) -> DataFrame:
    """Conversations (none, conv, total) that no other one continues or repeats."""
    rolled, blocks = prefixes(rows, staged)
    proper = rolled.filter("place < total").select(F.col("place").alias("total"), F.col("h1").alias("w1"), F.col("h2").alias("w2")).distinct()
    # of twins the smallest conv_id stays, and one without a conv_id only if it is alone
    kinds = blocks.groupBy("total", "w1", "w2").agg(F.min(F.struct("none", "conv")).alias("keep"))
    return kinds.join(proper.hint("merge"), ["total", "w1", "w2"], "left_anti").select("keep.none", "keep.conv", "total")


def render(rows: DataFrame, kept: DataFrame, chunked: bool = False) -> DataFrame:
    """conv_id, chunk, n_turns of the conversation and the rendered text of each kept conversation (or block of it)."""
    # joined by block, so that a hot conversation is spread in the join as well
    blocks = rows.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n")).join(kept.hint("merge"), _CONV).drop("n")
    mine = rows.join(blocks.hint("merge"), _KEY)
    turn = F.struct(F.col("turn").isNotNull().alias("a"), "turn", F.col("role").isNotNull().alias("b"), "role", "null", "digest", "text")
    line = lambda t: F.concat(F.lit("<|im_start|>"), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("<|im_end|>\n"))
    pieces = mine.groupBy(*_KEY, "total").agg(F.array_join(F.transform(F.sort_array(F.collect_list(turn)), line), "").alias("rendered"))
    if chunked:
        pieces = pieces.withColumn("chunk", F.row_number().over(Window.partitionBy(*_CONV).orderBy("block")) - 1)
    else:
        pieces = pieces.groupBy(*_CONV, "total").agg(F.array_join(F.sort_array(F.collect_list(F.struct("block", "rendered")))["rendered"], "").alias("rendered")).withColumn("chunk", F.lit(0))
    return pieces.select(F.when(~F.col("none"), F.col("conv")).alias("conv_id"), F.col("chunk").cast("long"), F.col("total").cast("long").alias("n_turns"), "rendered")


def collapse_and_render(turns: DataFrame, chunked: bool = False) -> DataFrame:
    """The maximal conversations of ``turns`` (conv_id, turn, role, text, ...), chat-formatted."""
    staged = Staged(turns.sparkSession, "chat")
    rows = blocks_of(turns, staged)
    return render(rows, staged.write(maximal(rows, staged)), chunked)
