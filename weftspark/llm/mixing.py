"""Mix sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: the sources, in code point order with null last, share ``share`` times all words by weight; no target exceeds
``most`` times its source's words, and what a capped source can't take is shared again by weight among the others.

A source's documents are permuted by a hash of their id and cut into ``BLOCKS`` blocks of equal hash ranges.  A target
of c whole passes and a remainder has a quota of every block c times and, of one more pass, the blocks before the hash
at which the remainder is reached, the last one in part; a few documents after that point are chosen to fill the last
gap.  The block quotas are then split over the output shards by a binary tree: each node draws its left half's blocks of
every source from the exact multivariate hypergeometric distribution, so sources spread as in a random deal, yet every
block goes to exactly one shard.  Each shard draws its number of a source's blocks from their permutation, and a
document is taken as often as its block was drawn.  A second hash orders the copies inside a shard: ``mixed_shards``
and ``mix`` write them in that order, as many partitions a shard as its words need.

Where a source's remainder is reached is found from histograms of words over hash ranges (4,096, then 4,096 more in
the range that is cut), so no source is sorted or collected.  The driver sees one row a source, of about 2 KB with its
deal; sources are a bounded dimension, and their plan is broadcast only up to ``PLAN_ROWS`` of them.

Defined cases: a null or wordless text has size 0 and is taken 0 words; a source without words has target 0; rows that
repeat a doc_id of one source are taken together; very long texts are whole documents as any other; equal input gives
equal output in any partitioning; an empty table gives an empty one; other columns are kept by ``mix``, whatever their names, and ignored by ``mixture``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .._ship import ship
from . import _tokens
from ._cluster import Staged, columns, lookup

#: Weights by source, repeating; the mix's words as a multiple of all; a target's as a multiple of its source's.
WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Blocks of a source, output shards, bits of the order key and of one histogram, and documents that may fill a gap.
BLOCKS, SHARDS, KEY_BITS, STEP_BITS, FILL = 256, 16, 60, 12, 64
#: Words below which the documents that fill a gap are chosen among all their sums.
EXACT_WORDS = 1 << 20
#: Words of a partition of a mixed shard, about.
PART_WORDS = 8_000_000
#: Sources up to which their plan is broadcast (about 2 KB each).
PLAN_ROWS = 4096
SEED = 20_240


@F.arrow_udf(LongType())
def _count_words(texts: pa.Array) -> pa.Array:
    return _tokens.word_counts(texts)


def words_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return _count_words(text.cast("string"))


def has_words(text: Column) -> Column:
    """Whether a text has a word: all that must be known of its size once the plan is made."""
    return F.coalesce(text.cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def order_key(doc_id: Column, source: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), doc_id, source), 64 - KEY_BITS)


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target words of each source: the least-capped level at which all is shared."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    left, out = share * sum(n for _, n in order), {}
    by_cap = sorted(order, key=lambda x: (most * x[1] / weight[x[0]], x[0] is None, x[0] or ""))
    rest = sum(weight.values())
    for i, (s, n) in enumerate(by_cap):
        if most * n * rest <= left * weight[s]:
            out[s] = most * n
            left, rest = left - out[s], rest - weight[s]
        else:
            out |= {t: left * weight[t] / rest for t, _ in by_cap[i:]}
            break
    return {s: float(out[s]) for s, _ in order}


def split(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source (rows) for each shard (columns): exact draws down a binary tree."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(first: int, last: int, colours: np.ndarray) -> None:
        if last - first == 1:
            out[:, first] = colours
            return
        middle = (first + last) // 2
        n = int(colours.sum())
        take = n * (middle - first) // (last - first)
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(colours, take, method="marginals") if n else colours.copy()
        node(first, middle, left)
        node(middle, last, colours - left)

    node(0, shards, quotas.astype(np.int64))
    return out


@dataclass
class Source:
    """What is taken of a source: whole passes, keys below ``cut`` and the keys in ``fill`` once more; shards by block."""

    name: str | None
    size: int
    rows: int
    target: float
    passes: int = 0
    cut: int = 0
    fill: tuple[int, ...] = ()
    deal: tuple[int, ...] = ()

    @property
    def key(self) -> str:
        return "n" if self.name is None else "s" + self.name

    @property
    def rest(self) -> float:
        return self.target - self.passes * self.size


def _histogram(rows: DataFrame, goals: DataFrame, shift: int) -> list:
    """For each source in ``goals`` (key, low, done, rest): the range of 2**shift keys in which ``rest`` is reached.

    ``rows`` has source, k and size; keys from ``low`` on count, ``done`` words lie before.  Returns rows of source,
    start of that range, words before it, and the end of the first range up to which ``FILL`` more documents follow.
    """
    cells = rows.groupBy("s", F.shiftright("k", shift).alias("cell")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("s").orderBy("cell")
    cells = cells.join(goals, "s").select("s", "cell", "rest", (F.col("done") + F.sum("size").over(run)).alias("words"), F.sum("n").over(run).alias("docs"), "done")
    fits = F.col("words") <= F.col("rest")
    whole = Window.partitionBy("s")
    cells = cells.withColumn("docs_before", F.coalesce(F.max(F.when(fits, F.col("docs"))).over(whole), F.lit(0)))
    ends = cells.groupBy("s").agg(
        F.min(F.when(~fits, F.col("cell"))).alias("cell"),
        F.coalesce(F.max(F.when(fits, F.col("words"))), F.max("done")).alias("before"),
        F.min(F.when(F.col("docs") >= F.col("docs_before") + FILL, F.col("cell"))).alias("last"),
    )
    return ends.collect()


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, s (its key, never null), k (the order key) and size of every row of ``docs`` (doc_id, text, source)."""
    ship(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "source", source_key(F.col("source")).alias("s"), order_key(doc_id, F.col("source")).alias("k"), words_of(F.col("text")).alias("size"))


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS) -> list[Source]:
    """What to take of each source of ``rows``, which ``sized`` has made and which are staged."""
    spark = rows.sparkSession
    found = rows.groupBy("s", "source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    goal = targets([(r["source"], r["size"]) for r in found], weights, share, most)
    sources = [Source(r["source"], r["size"], r["n"], goal[r["source"]]) for r in sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))]
    for s in sources:
        s.passes = int(s.target // s.size) if s.size else 0
    cut = {s.key: s for s in sources if s.size and s.rest > 0.5}
    if cut:
        table = lambda data: spark.createDataFrame(data, "s string, rest double, done long, low long, high long")
        frame = lambda data: F.broadcast(table(data)) if len(data) <= PLAN_ROWS else table(data)
        coarse, fine = KEY_BITS - STEP_BITS, KEY_BITS - 2 * STEP_BITS
        first = {r["s"]: r for r in _histogram(rows, frame([(k, s.rest, 0, 0, 0) for k, s in cut.items()]), coarse) if r["cell"] is not None}
        marks = frame([(k, cut[k].rest, r["before"], r["cell"] << coarse, (r["cell"] + 1) << coarse) for k, r in first.items()])
        inside = rows.join(marks.select("s", "low", "high"), "s").filter("k >= low and k < high").select("s", "k", "size")
        second = {r["s"]: r for r in _histogram(inside, marks, fine)}
        spans = []
        for k, r in second.items():
            low = r["cell"] << fine
            high = (r["last"] + 1) << fine if r["last"] is not None else ((first[k]["last"] + 1) << coarse if first[k]["last"] is not None else 1 << KEY_BITS)
            spans.append((k, cut[k].rest, r["before"], low, max(high, low + 1)))
            cut[k].cut = low
        # of a source of few documents each may be taken or not
        spans = [(k, cut[k].rest, 0, 0, 1 << KEY_BITS) if cut[k].rows <= FILL else (k, *rest) for k, *rest in spans]
        for k, *_ in spans:
            cut[k].cut = 0 if cut[k].rows <= FILL else cut[k].cut
        near = rows.join(frame(spans).select("s", "low", "high"), "s").filter("k >= low and k < high").groupBy("s", "k").agg(F.sum("size").alias("size"))
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("s").orderBy("k"))).filter(F.col("place") <= FILL)
        after: dict[str, list[tuple[int, int]]] = {}
        for r in near.collect():
            after.setdefault(r["s"], []).append((r["k"], r["size"]))
        for k, _, before, _, _ in spans:
            found = [(key, n) for key, n in after.get(k, []) if n > 0]
            fill = nearest(found, cut[k].rest - before)
            cut[k].fill = tuple(sorted(fill))
    deal(sources, shards)
    return sources


def nearest(found: list[tuple[int, int]], goal: float) -> list[int]:
    """Keys of those (key, size) whose sizes sum up to what is nearest to ``goal``: the largest that fit while much is
    missing, then a sum among all sums of the rest."""
    fill, left = [], sorted(found, key=lambda x: (-x[1], x[0]))
    while goal > EXACT_WORDS and left:
        fits = next((x for x in left if x[1] <= goal - EXACT_WORDS / 2), None)
        if fits is None:
            break
        left.remove(fits)
        fill.append(fits[0])
        goal -= fits[1]
    left = [x for x in left if x[1] <= 2 * max(goal, 1)]
    if goal <= 0 or not left or goal > 4 * EXACT_WORDS:
        return fill + [key for key, n in left[-1:] if n - goal < goal]
    # bit i of a mask: whether sizes so far can sum up to i
    mask = (1 << int(2 * goal) + 1) - 1
    sums = [1]
    for _, n in left:
        sums.append((sums[-1] | sums[-1] << n) & mask)
    below = (sums[-1] & ((1 << int(goal) + 1) - 1)).bit_length() - 1
    over = sums[-1] >> int(goal) + 1
    above = int(goal) + (over & -over).bit_length() if over else None
    total = above if above is not None and above - goal < goal - below else below
    for (key, n), before in zip(reversed(left), reversed(sums[:-1]), strict=True):
        if not before >> total & 1:
            fill.append(key)
            total -= n
    return fill


def deal(sources: list[Source], shards: int) -> None:
    """Give each block of each pass of each source the shard that draws it; -1 where none does."""
    width = KEY_BITS - (BLOCKS - 1).bit_length()
    last = [max([s.cut - 1, *s.fill]) >> width for s in sources]
    blocks = [[b for b in range(BLOCKS * s.passes)] + [BLOCKS * s.passes + b for b in range(n + 1)] for s, n in zip(sources, last, strict=True)]
    counts = split(np.array([len(b) for b in blocks], np.int64), shards)
    for i, (s, mine) in enumerate(zip(sources, blocks, strict=True)):
        order = np.random.default_rng([SEED, i]).permutation(len(mine))
        out = [-1] * (BLOCKS * (s.passes + 1))
        for place, shard in zip(order, np.repeat(np.arange(shards), counts[i]), strict=True):
            out[mine[place]] = int(shard)
        s.deal = tuple(out)


def with_copies(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """``rows`` (with s, k, size, doc_id, source) with source_size, target and, for each time a row is taken, its pass,
    shard and local order."""
    spark = rows.sparkSession
    width = KEY_BITS - (BLOCKS - 1).bit_length()
    schema = "s string, _rows long, _plan struct<source_size: long, target: double, passes: int, cut: long, fill: array<long>, deal: array<int>>"
    table = spark.createDataFrame([(s.key, s.rows, (s.size, s.target, s.passes, s.cut, list(s.fill), list(s.deal))) for s in sources], schema)
    if len(sources) <= PLAN_ROWS:
        out = rows.join(F.broadcast(table.select("s", "_plan")), "s")
    else:
        out = lookup(rows, table, "s", "_rows", sum(s.rows for s in sources))
    p, k = F.col("_plan"), F.col("k")
    once_more = (k < p["cut"]) | F.array_contains(p["fill"], k)
    block = F.shiftright(k, width).cast("int")
    copy = lambda e: F.struct(e.alias("pass"), F.element_at(p["deal"], e * BLOCKS + block + 1).alias("shard"), F.xxhash64(F.lit(SEED + 1), F.col("doc_id"), F.col("source"), e).alias("local_order"))
    drawn = F.filter(F.transform(F.sequence(F.lit(0), p["passes"]), copy), lambda c: (c["shard"] >= 0) & ((c["pass"] < p["passes"]) | once_more))
    out = out.withColumn("copies", F.when(F.col("size") > 0, drawn).otherwise(F.filter(drawn, lambda c: F.lit(False))))
    return out.withColumn("source_size", p["source_size"]).withColumn("target", p["target"]).drop("_plan")


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shards of the copies with their place keys, of every row."""
    rows = Staged(docs.sparkSession, "mixing").write(sized(docs))
    out = with_copies(rows, plan(rows))
    taken = F.col("size") * F.size("copies")
    return out.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("copies.shard").alias("shards"), F.col("copies.local_order").alias("orders"))


def mixed_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``row`` (all columns of ``docs``, whatever their names), ``shard`` and ``local_order`` of each copy.

    Partitions are dealt by shard and, inside a shard, by ranges of the local order, and are sorted: read one after
    another they are the shards, each shuffled.  The bounds are known, so nothing is sampled.
    """
    staged = Staged(docs.sparkSession, "mixing")
    sizes = staged.write(sized(docs))
    sources = plan(sizes, shards=shards)
    staged.drop(sizes)
    whole = docs.select(F.struct(*columns(docs)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    rows = whole.select("row", "doc_id", "source", source_key(F.col("source")).alias("s"), order_key(F.col("doc_id"), F.col("source")).alias("k"), has_words(F.col("text")).cast("int").alias("size"))
    copies = with_copies(rows, sources).select("row", F.explode("copies").alias("copy")).select("row", "copy.shard", "copy.local_order")
    bits = max(0, int(sum(s.target for s in sources) / (shards * PART_WORDS))).bit_length()
    part = F.shiftrightunsigned(F.col("local_order").bitwiseXOR(F.lit(-(2**63))), 64 - bits) if bits else F.lit(0)
    dealt = copies.repartitionById(shards << bits, (F.col("shard") * (1 << bits) + part).cast("int"))
    return dealt.sortWithinPartitions("shard", "local_order")


def mix(docs: DataFrame) -> DataFrame:
    """A row for each copy that the mix takes, with the columns of ``docs``, in the order of the mixed shards."""
    return mixed_shards(docs).select("row.*")
