"""Benchmark decontamination: size-partitioned MinHash containment search.

Finds the test items of which at least ``threshold`` of the distinct word shingles occur in a document.

Items are partitioned by size: class c holds those of 2**c to 2**(c+1) - 1 distinct shingles.  An item keeps the first
of its shingles, in an order of hashes that is the same for all, as a bottom-k MinHash sketch; the sketch's length is
set by the item's class.  A document that contains an item to the threshold misses at most ``n - need`` of its
shingles, so it must meet all but so many of the sketch: no containing document is missed, however long it is.  Shingles
that many items share come last in the order, so that what all items begin with doesn't lead to all of them.

The item table may grow: sketches and shingles are tables of the cluster, and the driver sees only a bitmap of at most
2**``MOST_BITS`` bits over the hashes of all item shingles, which is broadcast.  Documents are scanned once, hashed
whole, and hand on the shingles that the bitmap knows.  These are joined with the sketches for candidates, and the
candidates are verified by counting the shingles themselves, as words, that document and item share.

Defined cases: words are runs of letters and digits, lower-cased (``[^\\W_]+``), so markup and punctuation around a
passage don't hide it; an item with fewer words than a shingle is one shingle of all its words; an item or document
without words, or null, matches nothing; repeated rows match each by itself; ``decontaminate`` judges rows by doc_id
and text together, nulls included; very long documents and items are searched whole; without documents or items there
are no matches; other columns are ignored, or kept by ``decontaminate`` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._ship import ship
from . import _tokens
from ._cluster import BROADCAST_BYTES, Staged, without

#: Bits of the bitmap over item shingles: at least, at most, and for each shingle.
LEAST_BITS, MOST_BITS, SHINGLE_BITS = 16, 28, 256
#: Shingles by which a class's sketch is longer than it must be, so that more than one of them must be met.
EXTRA = 2

_WORD = re.compile(r"[^\W_]+")
#: Anything that is no letter or digit becomes a space; done on whole texts before they are hashed.
_GAP = re.compile(r"[\W_]+")


def item_words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def item_shingles(words: list[str], k: int) -> set[tuple[str, ...]]:
    k = min(k, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def _spaced(text: str | None) -> str:
    return _GAP.sub(" ", text.lower()).strip() if text else ""


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First row, bytes, and start, end, row (from the first) and hash of the words of runs of spaced texts."""
    for first in range(0, len(texts), 256):
        spaced = pa.array([_spaced(t) for t in texts[first : first + 256]], pa.large_string())
        for a, _, raw, *found in _tokens.whole(spaced):
            yield (first + a, raw.tobytes(), *found)


def _runs(row: np.ndarray, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``size`` words inside one row."""
    n = len(row) - size + 1
    if n <= 0:
        return row[:0], h[:0]
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    return at, _tokens.join([h[at + i] for i in range(size)])


def _once(row: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Places of the first of each (row, hash), in order."""
    order = np.lexsort((g, row))
    new = np.ones(len(order), bool)
    new[1:] = (g[order][1:] != g[order][:-1]) | (row[order][1:] != row[order][:-1])
    return np.sort(order[new])


def _words(raw: bytes, start: np.ndarray, end: np.ndarray, at: np.ndarray, size: int) -> pa.Array:
    """The runs of ``size`` words from the words ``at`` on, one space between words."""
    return pa.array([raw[a:b].decode() for a, b in zip(start[at].tolist(), end[at + size - 1].tolist(), strict=True)], pa.string())


_ITEM_SQL = "item long, item_id long, size int, n long, hash long, shingle string"
_ITEM = pa.schema([("item", pa.int64()), ("item_id", pa.int64()), ("size", pa.int32()), ("n", pa.int64()), ("hash", pa.int64()), ("shingle", pa.string())])


def _item_rows(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, raw, start, end, row, h in _chunks(batch.column(2).to_pylist()):
            words = np.bincount(row)
            for size in sorted({min(k, int(w)) for w in words if w}):
                at, g = _runs(row, h, size)
                mine = np.minimum(words[row[at]], k) == size
                at, g = at[mine], g[mine]
                once = _once(row[at], g)
                at, g = at[once], g[once]
                n = np.bincount(row[at])
                ids = pa.array(first + row[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.array(np.full(len(at), size, np.int32)), pa.array(n[row[at]]), pa.array(g.view(np.int64)), _words(raw, start, end, at, size)], schema=_ITEM)


def item_table(benchmark: DataFrame, k: int) -> DataFrame:
    """A row for each distinct shingle of each row of ``benchmark``: item (the row's own number), item_id, size in words,
    n (the item's shingles), hash and shingle."""
    rows = benchmark.select(F.monotonically_increasing_id(), F.col("item_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(lambda it: _item_rows(k, it), _ITEM_SQL)


def _need(n: Column, threshold: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.lit(threshold) * n - 1e-9)).cast("long")


def sketches(items: DataFrame, threshold: float, staged: Staged) -> DataFrame:
    """item, size_class, hash and how many of the item's sketch a document must meet, for each shingle of each sketch.

    ``items`` are staged, and so are the shingles that several of them share: Spark can split a join on a hot one.
    """
    shared = staged.write(items.groupBy("hash").agg(F.count(F.lit(1)).alias("items")).filter("items > 1"))
    size_class = F.floor(F.log2("n")).cast("int")
    largest = F.expr("shiftleft(1L, size_class + 1) - 1")
    length = F.least(F.col("n"), largest - _need(largest, threshold) + 1 + EXTRA)
    ranked = items.select("item", "n", "hash", size_class.alias("size_class")).join(_side(shared, "24"), "hash", "left")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.floor(F.log2(F.coalesce("items", F.lit(1)))), "hash"))
    ranked = ranked.withColumn("place", place).withColumn("length", length).filter("place <= length")
    return ranked.select("item", "size_class", "hash", (F.col("length") - F.col("n") + _need(F.col("n"), threshold)).alias("must_meet"))


def bitmap(items: DataFrame) -> tuple[np.ndarray, int]:
    """Packed bits of which hashes occur, and how far a hash is shifted to find its bit; 32 MB at most."""
    count = items.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (SHINGLE_BITS * count).bit_length()))
    slot = F.shiftrightunsigned("hash", 64 - bits)
    words = items.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(shiftrightunsigned(hash, %d) & 63 as int)))" % (64 - bits)).alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out, 64 - bits


def _known(known: np.ndarray, shift: int, g: np.ndarray) -> np.ndarray:
    slot = g >> np.uint64(shift)
    return ((known[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)


_PROBE_SQL = "doc long, doc_id long, digest binary, hash long, shingle string"
_PROBE = pa.schema([("doc", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("hash", pa.int64()), ("shingle", pa.string())])


def _probe(known: np.ndarray, shift: int, sizes: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        digests: dict[int, bytes] = {}
        for first, raw, start, end, row, h in _chunks(texts):
            for size in sizes:
                at, g = _runs(row, h, size)
                hit = np.flatnonzero(_known(known, shift, g))
                at, g = at[hit], g[hit]
                if len(at):
                    once = _once(row[at], g)
                    at, g = at[once], g[once]
                    mine = (first + row[at]).tolist()
                    for i in set(mine) - digests.keys():
                        digests[i] = hashlib.md5(texts[i].encode()).digest()
                    ids = pa.array(mine)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(ids), batch.column(1).take(ids), pa.array([digests[i] for i in mine], pa.binary()), pa.array(g.view(np.int64)), _words(raw, start, end, at, size)], schema=_PROBE)


def matches(docs: DataFrame, benchmark: DataFrame, staged: Staged, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc (a number of the row), doc_id, the text's digest, item_id, item_shingles and shared_shingles of every match."""
    ship(docs.sparkSession)
    items = staged.write(item_table(benchmark, k))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(items))
    rows = docs.select(F.monotonically_increasing_id(), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    probe = staged.write(rows.mapInArrow(lambda it: _probe(*shared.value, sizes, it), _PROBE_SQL))
    sketch = staged.write(sketches(items, threshold, staged))
    met = probe.select("doc", "hash").join(_side(sketch, "24"), "hash")
    pairs = staged.write(met.groupBy("doc", "item", "must_meet").agg(F.count(F.lit(1)).alias("met")).filter("met >= must_meet").select("doc", "item"))
    # what a candidate item holds is looked up among what the document holds: as many rows as its items are long
    asked = pairs.join(_side(items.select("item", "item_id", "n", "hash", "shingle"), "48 + octet_length(shingle)"), "item")
    both = asked.join(probe.hint("merge"), ["doc", "hash", "shingle"])
    sure = both.groupBy("doc", "item", "n").agg(F.count(F.lit(1)).alias("shared"), *[F.first(c).alias(c) for c in ("doc_id", "digest", "item_id")])
    sure = sure.filter(F.col("shared") >= _need(F.col("n"), threshold))
    return sure.select("doc", "doc_id", "digest", "item_id", F.col("n").alias("item_shingles"), F.col("shared").alias("shared_shingles"))


def _side(table: DataFrame, size: str) -> DataFrame:
    """Broadcast a side whose rows have been measured and are few; the other way is a merge join that Spark can split."""
    total = table.agg(F.coalesce(F.sum(F.expr(f"cast({size} as long)")), F.lit(0))).first()[0]
    return F.broadcast(table) if total <= BROADCAST_BYTES else table.hint("merge")


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """A row per document and test item that it contains: doc_id, item_id, item_shingles, shared_shingles, containment."""
    found = matches(docs, benchmark, Staged(docs.sparkSession, "decontam"), k, threshold)
    return found.select("doc_id", "item_id", "item_shingles", "shared_shingles", (F.col("shared_shingles") / F.col("item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs`` without the rows that contain a test item."""
    staged = Staged(docs.sparkSession, "decontam")
    hits = staged.write(matches(docs, benchmark, staged, k, threshold).select("doc_id", "digest").distinct())
    return without(docs, hits, hits.count())
