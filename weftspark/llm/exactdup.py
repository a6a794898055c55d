"""Exact dedup by an exchange of Golomb-coded fingerprints.

Texts are compared after lower-casing A-Z only.  Each row's fingerprint is a run of leading bits of its text's SHA-256,
about ``SLACK`` bits more than rows need to be told apart.  A sender (``SENDER_ROWS`` rows of a partition) sorts its
distinct fingerprints, deals them by their leading bits to owners, and codes the gaps by Golomb codes whose parameter
is a power of two: some 12 bits a text, whatever its length.  An owner decodes what all senders sent it and answers each
with a bitmap of the fingerprints that others sent too; what a sender found twice in its own rows it knows already.  Only
texts whose fingerprints are marked, the suspects, are shuffled and grouped by their bytes.

A group of copies of any size is one fingerprint of each sender, and one text of each task in the last shuffle.  Owners
get about ``OWNER_ROWS`` fingerprints each, so their number grows with the table.  The result is joined to the rows on
the digest; digests of many rows are joined by a broadcast, of which there can only be a bounded number.

Defined cases: a null text is an empty one, and all empty ones are copies of each other; of equal texts the row with the
largest doc_id stays; a null doc_id is smaller than all others, so such a row stays only if its text has no row with a
doc_id; rows that repeat doc_id and text are one document, so all of them say ``kept`` if it stays, and each counts in
``group_size``; very long texts are compared whole; an empty table gives an empty one; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from ._cluster import BROADCAST_ROWS, Staged, lookup

#: Rows of a sender, and fingerprints that an owner gets at most if all texts differ.
SENDER_ROWS, OWNER_ROWS = 1 << 20, 1 << 16
#: Owners at least, so that small tables use many tasks too (a power of two).
OWNERS = 16
#: Bits by which a fingerprint is longer than the number of rows: a text is a suspect by chance once in 2**SLACK.
SLACK = 10

_U = np.uint64


# Golomb codes


def parameter(n: int, width: int) -> int:
    """Bits of a remainder for ``n`` sorted values below ``2**width``: their mean gap, halved where that is shorter."""
    return max(0, int(np.floor(np.log2(max(1.0, np.log(2) * 2.0**width / max(n, 1))))))


def encode(values: np.ndarray, r: int) -> bytes:
    """Golomb code of sorted distinct values: quotients of all gaps in unary, then their remainders of ``r`` bits."""
    gap = np.diff(values, prepend=_U(0))
    gap[1:] -= _U(1)
    q = (gap >> _U(r)).astype(np.int64)
    unary = np.zeros(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 1
    rest = ((gap[:, None] >> np.arange(r, dtype=_U)) & _U(1)).astype(np.uint8)
    return np.packbits(unary).tobytes() + np.packbits(rest.ravel()).tobytes()


def decode(code: bytes, n: int, r: int) -> np.ndarray:
    """The ``n`` values of ``encode``."""
    raw = np.frombuffer(code, np.uint8)
    tail = (n * r + 7) // 8
    ends = np.flatnonzero(np.unpackbits(raw[: len(raw) - tail]))[:n]
    gap = (np.diff(ends, prepend=-1) - 1).astype(_U) << _U(r)
    if r:
        rest = np.unpackbits(raw[len(raw) - tail :], count=n * r).reshape(n, r).astype(_U)
        gap |= (rest << np.arange(r, dtype=_U)).sum(axis=1, dtype=_U)
    gap[1:] += _U(1)
    return np.cumsum(gap, dtype=_U)


# What runs on batches


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha = [hashlib.sha256(t.as_buffer() if t.is_valid else b"").digest() for t in pc.ascii_lower(batch.column(1))]
        first = np.frombuffer(b"".join(s[:8] for s in sha), ">u8").astype(np.int64) if sha else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.binary()), pa.array(first)], ["doc_id", "sha", "print"])


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        low = pc.ascii_lower(pc.fill_null(batch.column(1), ""))
        first = np.frombuffer(b"".join(hashlib.sha256(t.as_buffer()).digest()[:8] for t in low), ">u8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), low, pa.array(first)], ["doc_id", "text", "print"])


def _messages(bits: int, owner_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sender, owner, n, r, code, twice) of each sender and owner."""
    width, sender, held, rows = bits - owner_bits, TaskContext.get().partitionId() << 24, [], 0

    def sent() -> pa.RecordBatch:
        value, count = np.unique(np.concatenate(held), return_counts=True)
        owner = (value >> _U(width)).astype(np.int64)
        cut = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
        out = [[], [], [], [], [], []]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            r = parameter(b - a, width)
            code = encode(value[a:b] & _U((1 << width) - 1), r)
            for column, x in zip(out, (sender, int(owner[a]), int(b - a), r, code, np.packbits(count[a:b] > 1).tobytes()), strict=True):
                column.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["sender", "owner", "n", "r", "code", "twice"])

    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False).view(_U) >> _U(64 - bits))
        rows += len(batch)
        if rows >= SENDER_ROWS:
            yield sent()
            sender, held, rows = sender + 1, [], 0
    if rows:
        yield sent()


def _answers(table: pa.Table) -> pa.Table:
    """(sender, owner, shared) of one owner's messages: which of a message's fingerprints other senders sent too."""
    sent = [decode(c, n, r) for c, n, r in zip(table["code"].to_pylist(), table["n"].to_pylist(), table["r"].to_pylist(), strict=True)]
    value, count = np.unique(np.concatenate(sent), return_counts=True)
    shared = [np.packbits(count[np.searchsorted(value, x)] > 1).tobytes() for x in sent]
    return pa.table([table["sender"], table["owner"], pa.array(shared, pa.binary())], ["sender", "owner", "shared"])


def _suspects(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.zeros(0, _U)]
        for owner, n, r, code, twice, shared in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            marked = np.unpackbits(np.frombuffer(twice, np.uint8) | np.frombuffer(shared, np.uint8), count=n).astype(bool)
            found.append(decode(code, n, r)[marked] + (_U(owner) << _U(width)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["key"])


# The operator


def suspects(prints: DataFrame, rows: int, staged: Staged) -> tuple[DataFrame, int]:
    """``key``, the leading bits of every fingerprint in ``prints`` (print) that is found more than once, and their number
    of bits."""
    owner_bits = max(OWNERS.bit_length() - 1, (max(rows, 1) // OWNER_ROWS).bit_length())
    bits = min(64, max(owner_bits + 1, rows.bit_length() + SLACK))
    messages = staged.write(prints.mapInArrow(lambda it: _messages(bits, owner_bits, it), "sender long, owner long, n int, r int, code binary, twice binary"))
    answers = staged.write(messages.select("sender", "owner", "n", "r", "code").groupBy("owner").applyInArrow(_answers, "sender long, owner long, shared binary"))
    back = messages.join(answers, ["sender", "owner"]).select("owner", "n", "r", "code", "twice", "shared")
    found = staged.write(back.mapInArrow(lambda it: _suspects(bits - owner_bits, it), "key long").distinct())
    staged.drop(messages, answers)
    return found, bits


def _key(bits: int) -> Column:
    return F.shiftrightunsigned("print", 64 - bits)


def duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    ship(spark)
    staged = Staged(spark, "exactdup")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = staged.write(texts.mapInArrow(_digests, "doc_id long, sha binary, print long"))
    n = rows.count()
    found, bits = suspects(rows.select("print"), n, staged)
    named = found.count()
    likely = texts.mapInArrow(_normalised, "doc_id long, text string, print long").withColumn("key", _key(bits))
    likely = likely.join(F.broadcast(found) if named <= BROADCAST_ROWS else found.hint("merge"), "key", "left_semi")
    copies = likely.groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    groups = staged.write(copies.select(F.unhex(F.sha2("text", 256)).alias("sha"), "keep_id", "group_size"))
    staged.drop(found)
    sized = groups.withColumnRenamed("group_size", "weight").withColumn("group_size", F.col("weight"))
    out = lookup(rows.select("doc_id", "sha"), sized, "sha", "weight", n)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
