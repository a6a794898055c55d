"""Conversation structure repair by weighted CYK parsing.

A conversation is repaired when its roles' initials read ``(s?(ua)+)?``.  The repair grammar in Chomsky normal form has
a nonterminal for each pair of states of that pattern: ``(p, q) -> row`` for the edits that lead from ``p`` to ``q``, and
``(p, q) -> (p, r) (r, q)``.  Edits of a row are Keep (0), Rerole to user or assistant (1) and Delete (2); a row that was
cut off costs 5 more unless it is deleted, a blank or repeated one must be deleted.  Empty user and assistant turns may
be inserted anywhere for 5 each: a row's cells are closed under the insertions that may stand before it, and the whole
span's under those at its end, so that each cell's edits end with a row.  No audit in a cell is then a prefix of
another, and the least (cost, audit) of a span is made of the least ones of its parts.

Spans are combined bottom-up by length, all splits of each: first of at most ``FAN`` rows, in numpy for all runs of a
batch at once, then of at most ``FAN`` such spans, and so on.  For a parser a span is only its 16 costs and the order of
its 16 audits, so costs and orders of ``FAN`` parts are packed into one integer, whose sum joins and whose minimum
chooses.  A conversation of any length is so a tree of small tasks; its audit, like any value, must fit into a row.

All turns are dealt by ranges of (conversation, turn, role, text), and what depends on a whole conversation (positions,
repetitions, neighbours over a block's end) is aggregated by block first.  Only the repaired text's SHA-256 is a chain:
a conversation's rows pass through one task for it, in order and one batch at a time.

Defined cases: a null role or text is one space; turns are ordered by turn (nulls first), then role, then text's digest;
repeated rows are repeated turns; rows with a null conv_id are one conversation; an empty role has no initial, so it is
in no legal pair and can't be kept; very long texts are hashed whole; an empty table gives an empty one; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._ship import ship
from ._cluster import Staged

#: Rows or spans that one CYK table joins.  12 orders of 4 bits and their costs fit into 63 bits.
FAN = 12
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
#: States of the pattern: nothing yet, after a system turn, after a user's, after an assistant's.
NONE, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: Kinds of rows: initial (s, u, a or any other) and fault (none, one that must be deleted, cut off).
INITIALS, SOUND, GONE, CUT = "sua ", 0, 1, 2
#: Edits of a row with up to two insertions before it, in ASCII order.
PIECES = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
_FAR = 1 << 40
#: A cell that costs more than the span's least one by so much is in no cheapest parse: whatever can follow it can follow
#: an assistant's turn for 2 more at most, and from any state such a turn is reached for less than 20 above the least.
_USELESS = 64
_COST_SHIFT = 4 * FAN

_CONV = ["none", "conv"]
_SPACE = r"[\x20\x09-\x0D]"


# The grammar


def _inserted(p: int) -> list[tuple[int, int]]:
    """(state, insertions) that insertions lead to from ``p`` without a detour."""
    out, at = [(p, 0)], p
    for n in (1, 2):
        at = USER if at != USER else ASSISTANT
        if at not in [s for s, _ in out]:
            out.append((at, n))
    return out


@functools.cache
def rules() -> tuple[np.ndarray, np.ndarray]:
    """Cost and label of each kind of row (3 * initial + fault) and pair of states; a label is 4 * piece + state after."""
    cost, label = np.full((12, 4, 4), _FAR, np.int64), np.full((12, 4, 4), 255, np.uint8)
    for kind in range(12):
        initial, fault = INITIALS[kind // 3], kind % 3
        for p in range(4):
            for mid, n in _inserted(p):
                edits = [("D", mid, DELETE)]
                if fault != GONE:
                    more = CUT_OFF if fault == CUT else 0
                    edits += [("K", _NEXT[mid, initial], KEEP + more)] if (mid, initial) in _NEXT else []
                    edits += [("R", ASSISTANT if mid == USER else USER, REROLE + more)]
                for letter, q, c in edits:
                    new = (n * INSERT + c, 4 * PIECES.index("I" * n + letter) + q)
                    if new < (cost[kind, p, q], label[kind, p, q]):
                        cost[kind, p, q], label[kind, p, q] = new
    return cost, label


def cyk(cost: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest ways through spans of ``n`` parts: (runs, n, 4, 4) costs and orders of audits to (runs, 4, 4) costs and
    (runs, 4, 4, n) orders chosen.

    Costs are taken relative to a part's least one.
    """
    runs, n = cost.shape[:2]
    least = cost.min(axis=(2, 3), keepdims=True)
    dead = cost - least > _USELESS
    left = np.where(dead, 0, cost - least)
    shift = (4 * (FAN - 1 - np.arange(n)))[None, :, None, None]
    one = (left << _COST_SHIFT) + (order.astype(np.int64) << shift)
    never = np.int64(1) << 61
    one[dead] = never
    cell = {(i, i + 1): one[:, i] for i in range(n)}
    for length in range(2, n + 1):
        for i in range(n - length + 1):
            best = np.full((runs, 4, 4), never, np.int64)
            for k in range(i + 1, i + length):
                a, b = cell[i, k], cell[k, i + length]
                for r in range(4):
                    np.minimum(best, a[:, :, r, None] + b[:, r, None, :], out=best)
            cell[i, i + length] = best
    whole = cell[0, n]
    total = np.where(whole >= never, _FAR, (whole >> _COST_SHIFT) + least.sum(axis=1))
    chosen = (whole[..., None] >> shift.reshape(1, 1, 1, n)) & 15
    return total, chosen


Part = tuple[list[int], list[bytes], list[int]]


def _part(cost: list[int], labels: list[bytes]) -> Part:
    """16 costs, 16 labels and the order of these."""
    order = sorted(set(labels))
    return cost, labels, [order.index(x) for x in labels]


def _join(parts: list[list[Part]]) -> list[tuple[np.ndarray, list[bytes]]]:
    """Each run's parts joined into one."""
    out: list = [None] * len(parts)
    for n in {len(p) for p in parts}:
        at = [i for i, p in enumerate(parts) if len(p) == n]
        cost, order = (np.array([[part[j] for part in parts[i]] for i in at], np.int64).reshape(len(at), n, 4, 4) for j in (0, 2))
        total, chosen = cyk(cost, order)
        for g, i in enumerate(at):
            out[i] = (total[g].ravel(), [_follow(parts[i], chosen[g, p, q].tolist(), p) if total[g, p, q] < _FAR else b"" for p in range(4) for q in range(4)])
    return out


def _follow(parts: list[Part], chosen: list[int], p: int) -> bytes:
    """Labels of the parts in the chosen order of audits, from state ``p`` on."""
    out = []
    for (cost, labels, order), rank in zip(parts, chosen, strict=True):
        q = next(q for q in range(4 * p, 4 * p + 4) if order[q] == rank and cost[q] < _FAR)
        out.append(labels[q])
        p = q % 4
    return b"".join(out)


# What runs on batches


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """none, conv, node, kinds (of the rows in order) to none, conv, node, cost, labels."""
    cost, label = rules()
    kinds = [_part(cost[k].ravel().tolist(), [b"" if c >= _FAR else bytes([x]) for c, x in zip(cost[k].ravel(), label[k].ravel(), strict=True)]) for k in range(12)]
    for batch in batches:
        joined = _join([[kinds[k] for k in run] for run in batch.column(3).to_pylist()])
        yield _cells(batch, joined)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """none, conv, node, parts (cost, labels in order) to none, conv, node, cost, labels."""
    for batch in batches:
        yield _cells(batch, _join([[_part(p["cost"], p["labels"]) for p in run] for run in batch.column(3).to_pylist()]))


_CELLS = "none boolean, conv long, node long, cost array<long>, labels array<binary>"


def _cells(batch: pa.RecordBatch, joined: list[tuple[np.ndarray, list[bytes]]]) -> pa.RecordBatch:
    cost = pa.array([c.tolist() for c, _ in joined], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), cost, pa.array([x for _, x in joined], pa.list_(pa.binary()))], ["none", "conv", "node", "cost", "labels"])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest repair of whole conversations: cost, audit, labels of the rows, insertions at the end."""
    piece = np.array([np.frombuffer(p.encode().ljust(3, b"\0"), np.uint8) for p in PIECES])
    for batch in batches:
        rows = []
        for cost, labels in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            # from nothing to nothing, or to an assistant's turn that may have to be inserted
            ends = [(cost[q] + INSERT * n, labels[q], n) for q, n in ((NONE, 0), (ASSISTANT, 0), (USER, 1), (SYSTEM, 2)) if cost[q] < _FAR]
            total, best, n = min(ends)
            letters = piece[np.frombuffer(best, np.uint8) >> 2].ravel()
            rows.append((total, letters[letters > 0].tobytes().decode() + "I" * n, best, n))
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.string(), pa.binary(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["none", "conv", "cost", "audit", "labels", "closing"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines (none, conv, lines), which come in order."""
    key, sha, first = None, hashlib.sha256(), True
    for batch in batches:
        done = []
        for none, conv, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if (none, conv) != key:
                if key is not None:
                    done.append((*key, sha.hexdigest()))
                key, sha, first = (none, conv), hashlib.sha256(), True
            if lines.is_valid:
                sha.update(b"" if first else b"\n")
                sha.update(lines.as_buffer())
                first = False
        if done:
            yield _hashed(done)
    if key is not None:
        yield _hashed([(*key, sha.hexdigest())])


def _hashed(done: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.bool_()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], ["none", "conv", "sha"])


# The operator


def damaged(turns: DataFrame) -> DataFrame:
    """The turns after the damage that their conv_id and turn decide: a null column reads as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), harm.alias("harm")).filter("harm != 0")
    text = F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def blocks_of(turns: DataFrame, staged: Staged) -> DataFrame:
    """Rows with a null-free conversation key, their block (from the range that they were dealt to), ``at``, by which
    rows are in order, and what is found in a row alone."""
    conv = F.col("conv_id").cast("long")
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(conv.isNull().alias("none"), F.coalesce(conv, F.lit(0)).alias("conv"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), F.md5(text).alias("digest"), F.rand(11).alias("salt"))
    order = [*_CONV, F.asc_nulls_first("turn"), "role", "digest", "salt"]
    last = F.regexp_extract("text", rf"([^\x20\x09-\x0D]){_SPACE}*\z", 1)
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    found = {"block": F.spark_partition_id().cast("long"), "at": F.monotonically_increasing_id(), "blank": last == "", "cut": ~last.isin(".", "!", "?"), "initial": F.substring("role", 1, 1)}
    return staged.write(dealt.withColumns(found))


def examine(rows: DataFrame, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """Rows (key, block, at, place from 0, kind, fault, illegal) and conversations (key, n, gaps and numbers of faults)."""
    along = Window.partitionBy(*_CONV).orderBy("block")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(*_CONV, "block").agg(F.count(F.lit(1)).alias("n"), F.max_by("initial", "at").alias("last"))
    blocks = staged.write(blocks.select(*_CONV, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.lag("last").over(along).alias("left")))
    said = ["role", "digest"]
    again = staged.write(rows.groupBy(*_CONV, *said).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times"))
    bare = rows.select(*_CONV, "block", "at", "initial", "blank", "cut", *said)
    told = staged.write(bare.join(again.hint("merge"), [*_CONV, *said], "left").select(*_CONV, "block", "at", "initial", "blank", "cut", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("repeated")))
    inside = Window.partitionBy(*_CONV, "block").orderBy("at")
    placed = told.select("*", F.row_number().over(inside).alias("within"), F.lag("initial").over(inside).alias("near")).join(blocks.hint("merge"), [*_CONV, "block"])
    fault = F.when(F.col("blank"), F.lit("blank")).when(F.col("repeated"), F.lit("duplicate")).when(F.col("cut"), F.lit("truncated"))
    initial = F.expr(f"CASE WHEN length(initial) = 1 AND instr('{INITIALS[:3]}', initial) > 0 THEN instr('{INITIALS[:3]}', initial) - 1 ELSE 3 END")
    what = F.when(fault.isin("blank", "duplicate"), F.lit(GONE)).when(fault == "truncated", F.lit(CUT)).otherwise(F.lit(SOUND))
    previous = F.when(F.col("within") > 1, F.col("near")).otherwise(F.col("left"))
    place = F.col("before") + F.col("within") - 1
    illegal = (place > 0) & ~F.coalesce(F.concat(previous, "initial").isin("su", "ua", "au"), F.lit(False))
    marked = staged.write(placed.select(*_CONV, "at", place.alias("place"), fault.alias("fault"), (3 * initial + what).cast("int").alias("kind"), illegal.alias("illegal")))
    turns = rows.groupBy(*_CONV, "turn").agg(F.count(F.lit(1)).alias("rows")).groupBy(*_CONV)
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    counts = marked.groupBy(*_CONV).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")], F.count_if("illegal").alias("illegal"))
    return marked, staged.write(counts.join(gaps.hint("merge"), _CONV))


def parse(marked: DataFrame, counts: DataFrame, staged: Staged) -> DataFrame:
    """none, conv, cost, audit, labels and closing of every conversation that has rows."""
    longest = counts.agg(F.max("n")).first()[0] or 0
    group = lambda df, value: df.groupBy(*_CONV, "node").agg(F.sort_array(F.collect_list(value)).alias("parts"))
    runs = group(marked.withColumn("node", F.expr(f"place div {FAN}")), F.struct("place", "kind"))
    nodes = staged.write(runs.select(*_CONV, "node", F.col("parts.kind").alias("parts")).mapInArrow(_leaves, _CELLS))
    width, done = -(-longest // FAN), []
    while width > 1:
        # conversations that are one node already wait; the others have a node 1
        many = nodes.filter("node = 1").select(*_CONV)
        done.append(nodes.join(many.hint("merge"), _CONV, "left_anti"))
        open_ = nodes.join(many.hint("merge"), _CONV, "left_semi")
        spans = group(open_.select(*_CONV, F.expr(f"node div {FAN}").alias("node"), F.col("node").alias("place"), "cost", "labels"), F.struct("place", "cost", "labels"))
        nodes = staged.write(spans.select(*_CONV, "node", F.transform("parts", lambda p: F.struct(p["cost"].alias("cost"), p["labels"].alias("labels"))).alias("parts")).mapInArrow(_spans, _CELLS))
        width = -(-width // FAN)
    whole = functools.reduce(DataFrame.unionByName, [*done, nodes]).select(*_CONV, "cost", "labels")
    return staged.write(whole.mapInArrow(_roots, "none boolean, conv long, cost long, audit string, labels binary, closing int"))


def repaired(rows: DataFrame, marked: DataFrame, parsed: DataFrame) -> DataFrame:
    """Key, place and lines (null: none) of the repaired conversations, a row for each row and one for each end."""
    cut = F.posexplode(F.expr(f"transform(sequence(0, (length(labels) - 1) div {FAN}), i -> substring(labels, i * {FAN} + 1, {FAN}))")).alias("node", "slice")
    slices = parsed.select(*_CONV, cut).withColumn("node", F.col("node").cast("long"))
    edits = marked.select(*_CONV, "at", "place", F.expr(f"place div {FAN}").alias("node")).join(slices.hint("merge"), [*_CONV, "node"])
    label = F.expr(f"conv(hex(substring(slice, cast(place % {FAN} as int) + 1, 1)), 16, 10)").cast("int")
    edits = edits.withColumn("label", label).select("at", "place", F.expr("cast(label div 4 as int)").alias("piece"), F.expr("label % 4").alias("state"))
    named = F.array(*[F.lit(p) for p in PIECES])
    edit = F.element_at(named, F.col("piece") + 1)
    stays = ~F.endswith(edit, F.lit("D"))
    role = F.when(F.endswith(edit, F.lit("K")), F.col("role")).when(F.col("state") == USER, F.lit("user")).otherwise(F.lit("assistant"))
    # the first of two insertions is a user's exactly if the row comes after an assistant's turn or is one
    own = F.when(F.col("state") == ASSISTANT, F.lit("assistant")).otherwise(F.lit("user"))
    other = F.when(own == "user", F.lit("assistant")).otherwise(F.lit("user"))
    n = F.length(edit) - 1
    # a row that stays follows its insertions, so the last of them is the other role; else the state is that of the last
    last, first = F.when(stays, other).otherwise(own), F.when(stays, own).otherwise(other)
    empty = F.when(n == 2, F.concat(first, F.lit(":\n"), last, F.lit(":"))).when(n == 1, F.concat(last, F.lit(":")))
    mine = F.when(stays, F.concat(role, F.lit(":"), F.col("text")))
    lines = F.when(empty.isNull(), mine).when(mine.isNull(), empty).otherwise(F.concat(empty, F.lit("\n"), mine))
    body = rows.select(*_CONV, "at", "role", "text").join(edits.hint("merge"), "at").select(*_CONV, "place", lines.alias("lines"))
    end = F.when(F.col("closing") == 1, F.lit("assistant:")).when(F.col("closing") == 2, F.lit("user:\nassistant:"))
    return body.unionByName(parsed.select(*_CONV, F.length("labels").cast("long").alias("place"), end.alias("lines")))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the conversations in ``turns``
    (conv_id, turn, role, text, ...)."""
    spark = turns.sparkSession
    ship(spark)
    staged = Staged(spark, "repair")
    rows = blocks_of(turns, staged)
    marked, counts = examine(rows, staged)
    parsed = parse(marked, counts, staged)
    lines = repaired(rows, marked, parsed).repartition(*_CONV).sortWithinPartitions(*_CONV, "place")
    sha = lines.select(*_CONV, F.col("lines")).mapInArrow(_hashes, "none boolean, conv long, sha string")
    found = counts.join(parsed.select(*_CONV, "cost", "audit").hint("merge"), _CONV).join(sha.hint("merge"), _CONV)
    return found.select(
        F.when(~F.col("none"), F.col("conv")).alias("conv_id"),
        F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"),
        *[F.col(c).cast("long") for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        "audit",
        F.col("sha").alias("repaired_sha256"),
    )


def repair_damaged(turns: DataFrame) -> DataFrame:
    """``repair`` of the damaged turns, with a row for every conversation of ``turns``, also if no row of it is left."""
    staged = Staged(turns.sparkSession, "repair-all")
    all_ = turns.select(F.col("conv_id").cast("long")).distinct()
    found = staged.write(repair(damaged(turns)))
    out = all_.withColumnRenamed("conv_id", "_id").join(found.hint("merge"), F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("_id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
