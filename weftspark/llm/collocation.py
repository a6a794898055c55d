"""Phrase collocation mining by top-order marginalisation.

Only the longest windows are counted: at each word the window of ``ORDER`` words from there, whose columns are the words
shifted by one, two and three places, padded behind the end of the piece.  ``ROLLUP`` sums the counts of these windows
over their last columns, so the sums are the counts of all shorter phrases, and no phrase is exploded for itself.

Windows are cut short where no phrase that counts goes on: a phrase is at most as frequent as its parts, so a window is
padded from the first word, pair or triple that is below ``LEAST``.  Words are counted exactly; pairs and triples in
``1 << BITS`` slots of a hash, whose counts are never too low.  The slots that reach ``LEAST`` are a bitmap of fixed size,
which is broadcast.  It may let a rare phrase pass, which then fails on its exact count; so a vocabulary for which the
slots are too few costs time and shuffles but changes no result.

In windows a word of a language is a 64-bit hash.  The corpus's words are counted as strings first, and the hash is
taken with the first seed for which no two of them share one, so hashes are names and counts are exact.

Texts are cut into parts of about a megabyte with the last words carried over, so a very long text needs no more memory
than others.  Defined cases: a null text is empty; a null lang is ``und``; texts without words count nothing; rows that
repeat a doc_id count each; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .._ship import ship
from . import _tokens
from ._cluster import Staged

#: Words of the longest phrases.
ORDER = 4
#: Slots of a count of pairs or triples, as a power of two: a bitmap of 16 MB.
BITS = 27
#: Words, or windows, that a worker gathers before it counts them.
BUFFER = 1 << 20
#: Groups into which a language's phrases are dealt before its first ones are taken.
RANKERS = 64

BREAK = np.isin(np.arange(256), [*b".,;:!?", *range(0x0A, 0x0E)])
SPACE = BREAK | np.isin(np.arange(256), [0x20, 0x09])
_SEPARATORS = r"[.,;:!?\x0A-\x0D\x20\x09]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_U = np.uint64
_WINDOW = [f"w{i}" for i in range(1, ORDER + 1)]


def _table(seed: int) -> np.ndarray:
    """A number for each byte, the same for a letter in either case."""
    out = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=_U)
    out[65:91] = out[97:123]
    return out


def _names(lang: str, h: np.ndarray) -> np.ndarray:
    """Hashes of words of a language; 0 is the padding."""
    return np.maximum(_tokens.mix(h ^ _U(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big"))), _U(1))


def _slots(columns: list[np.ndarray]) -> np.ndarray:
    return (columns[0] if len(columns) == 1 else _tokens.join(columns)) >> _U(64 - BITS)


def _has(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[(slots >> _U(3)).astype(np.int64)] >> (slots & _U(7)).astype(np.uint8)) & 1 > 0


def _windows(batches: Iterator[pa.RecordBatch], seed: int, size: int) -> Iterator[list[np.ndarray]]:
    """Columns of the windows of ``size`` words of (lang, text) batches; 0 behind the end of a piece."""
    table = _table(seed)
    for batch in batches:
        langs, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        held, base = (np.zeros(0, _U), np.zeros(0, np.int64)), 0
        for first, last, raw, offsets, more in _tokens.parts(texts, SPACE):
            start, _, row, h = _tokens.words(raw, offsets, SPACE, table)
            spoken = langs[first:last]
            for lang in set(spoken.tolist()):
                mine = (spoken == lang)[row]
                h[mine] = _names(lang, h[mine])
            # pieces are numbered through: one more at each break and each text
            piece = base + 1 + row + np.cumsum(BREAK[raw])[start]
            h, piece = np.concatenate((held[0], h)), np.concatenate((held[1], piece))
            n = max(0, len(h) - size + 1) if more else len(h)
            out = [h[:n]]
            for i in range(1, size):
                column = np.zeros(n, _U)
                there = min(n, len(h) - i)
                if there > 0:
                    same = piece[i : i + there] == piece[:there]
                    column[:there][same] = h[i : i + there][same]
                out.append(column)
            yield out
            breaks = int(np.count_nonzero(BREAK[raw]))
            held, base = ((h[n:], piece[n:]), base + breaks) if more else ((h[:0], piece[:0]), base + breaks + last - first + 1)


def _pad(columns: list[np.ndarray], frequent: list[np.ndarray]) -> list[np.ndarray]:
    """Windows with padding from the first word on whose word, pair or triple isn't in its bitmap."""
    n, out = len(columns[0]), [c.copy() for c in columns]
    alive = np.ones(n, bool)
    for i, column in enumerate(out):
        alive &= column > 0
        for size in range(1, min(i + 1, len(frequent)) + 1):
            at = np.flatnonzero(alive)
            alive[at] = _has(frequent[size - 1], _slots([columns[j][at] for j in range(i - size + 1, i + 1)]))
        column[~alive] = 0
    return out


def _gathered(parts: Iterator[list[np.ndarray]]) -> Iterator[list[np.ndarray]]:
    """Columns of many parts at once."""
    held, n = [], 0
    for columns in parts:
        held.append(columns)
        n += len(columns[0])
        if n >= BUFFER:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _count_slots(batches: Iterator[pa.RecordBatch], seed: int, shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(slot, n) of the phrases one word longer than the bitmaps reach, all of whose parts are in these."""
    frequent = shared.value
    size = len(frequent) + 1
    for columns in _gathered(c for c in (_pad(w, frequent) for w in _windows(batches, seed, size))):
        whole = columns[-1] > 0
        slot, n = np.unique(_slots([c[whole] for c in columns]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(n)], ["slot", "n"])


def _count_windows(batches: Iterator[pa.RecordBatch], seed: int, shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(w1, ..., n) of padded windows; windows of one word are counted here, the others by Spark."""
    frequent = shared.value
    for columns in _gathered(_pad(w, frequent) for w in _windows(batches, seed, ORDER)):
        one, n = np.unique(columns[0][(columns[0] > 0) & (columns[1] == 0)], return_counts=True)
        long = columns[1] > 0
        out = [np.concatenate((c[long], one if i == 0 else np.zeros(len(one), _U))).view(np.int64) for i, c in enumerate(columns)]
        out.append(np.concatenate((np.ones(int(long.sum()), np.int64), n)))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], [*_WINDOW, "n"])


def _hash_words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    """lang, word, f and h of counted words."""
    table = _table(seed)
    for batch in batches:
        langs, out = batch.column(0).to_numpy(zero_copy_only=False), np.zeros(len(batch), _U)
        for first, last, raw, offsets in _tokens.chunks(batch.column(1)):
            _, _, row, h = _tokens.words(raw, offsets, SPACE, table)
            out[first + row] = h
        for lang in set(langs.tolist()):
            out[langs == lang] = _names(lang, out[langs == lang])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out.view(np.int64))], ["lang", "word", "f", "h"])


def _bitmap(slots: DataFrame) -> np.ndarray:
    """``slots`` (slot) as bits: 32768 in each row, 4096 rows at most, whatever the size of the corpus."""
    place = F.col("slot").cast("long") + 1
    rows = slots.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for bucket, bits in rows.collect():
        at = (bucket - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bits, np.uint8)[: len(out) - at]
    return out


# The operator


def counted_words(docs: DataFrame) -> DataFrame:
    """lang, word, f of all words."""
    raw = docs.select("lang", F.explode(F.split("text", _SEPARATORS)).alias("word")).filter("word != ''").groupBy("lang", "word").agg(F.count(F.lit(1)).alias("f"))
    # only distinct words are lower-cased
    return raw.groupBy("lang", F.translate("word", _UPPER, _LOWER).alias("word")).agg(F.sum("f").alias("f"))


def phrases(docs: DataFrame, words: DataFrame, least: int, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """(key, f) of all phrases of up to ``ORDER`` words that occur ``least`` times, and (lang, word, f, h) of all words;
    a key is the array of its words' h."""
    spark = docs.sparkSession
    for seed in range(1, 100):
        names = staged.write(words.mapInArrow(lambda it, s=seed: _hash_words(it, s), "lang string, word string, f long, h long"))
        if not names.groupBy("h").count().filter("count > 1").limit(1).count():
            break
        staged.drop(names)
    frequent = [_bitmap(names.filter(F.col("f") >= least).select(F.shiftrightunsigned("h", 64 - BITS).alias("slot")))]
    for _ in range(2, ORDER):
        shared = spark.sparkContext.broadcast(frequent)
        counts = docs.mapInArrow(lambda it, b=shared: _count_slots(it, seed, b), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        frequent.append(_bitmap(counts.filter(F.col("n") >= least)))
        shared.destroy()
    shared = spark.sparkContext.broadcast(frequent)
    windows = docs.mapInArrow(lambda it: _count_windows(it, seed, shared), ", ".join(f"{c} long" for c in [*_WINDOW, "n"]))
    top = windows.groupBy(*_WINDOW).agg(F.sum("n").alias("n"))
    rolled = top.rollup(*_WINDOW).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    # of the longest sums none, of the next ones the last column is rolled up, and so on
    length = F.lit(ORDER) - F.bit_count("rolled")
    key = F.slice(F.array(*_WINDOW), F.lit(1), length)
    found = rolled.filter(length > 0).select(key.alias("key"), "f").filter((F.col("f") >= least) & (F.element_at("key", -1) != 0))
    out = staged.write(found)
    shared.destroy()
    return out, names


def _big(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def scored(found: DataFrame, staged: Staged) -> DataFrame:
    """key, f, l, r and score of the phrases of at least two words, each at its lowest-scoring cut."""
    n = F.size("key")
    cuts = found.filter(n > 1).select("key", "f", F.explode(F.sequence(F.lit(1), n - 1)).alias("k"))
    cuts = staged.write(cuts.select("key", "f", "k", F.slice("key", F.lit(1), F.col("k")).alias("first"), F.slice("key", F.col("k") + 1, n - F.col("k")).alias("rest")))
    for side, f in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(found.select(F.col("key").alias(side), F.col("f").alias(f)).hint("merge"), side)
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(f as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.groupBy("key", "f").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    return best.select("key", "f", "b.l", "b.r", "b.score")


def covered(found: DataFrame) -> DataFrame:
    """key and the largest f of a longer phrase that holds it."""
    inner = F.expr("flatten(transform(sequence(2, size(key) - 1), m -> transform(sequence(1, size(key) - m + 1), s -> slice(key, s, m))))")
    return found.filter(F.size("key") > 2).select("f", F.explode(inner).alias("key")).groupBy("key").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, first: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``first`` phrases of each language in ``docs`` (text, lang, ...)."""
    spark = docs.sparkSession
    ship(spark)
    staged = Staged(spark, "collocation")
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    words = staged.write(counted_words(texts))
    found, names = phrases(texts, words, least, staged)
    rows = scored(found, staged).join(covered(found).hint("merge"), "key", "left")
    rows = staged.write(rows.filter(~F.coalesce(_big("longer") * 100 >= _big("f") * percent, F.lit(False))).drop("longer"))
    spoken = rows.select("key", F.posexplode("key").alias("at", "h")).join(names.filter(F.col("f") >= least).select("h", "lang", "word").hint("merge"), "h")
    said = spoken.groupBy("key").agg(F.first("lang").alias("lang"), F.array_join(F.array_sort(F.collect_list(F.struct("at", "word")))["word"], " ").alias("phrase"))
    order = [F.desc("score"), F.desc("f"), F.asc("phrase")]
    named = staged.write(rows.join(said.hint("merge"), "key"))
    some = named.withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(RANKERS)))
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("place") <= first)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    longs = {c: F.col(c).cast("long") for c in ("rank", "l", "r", "n", "score")}
    return top.join(n, "lang").select("lang", longs["rank"].alias("rank"), "phrase", F.col("f").cast("long").alias("a"), *[longs[c].alias(c) for c in ("l", "r", "n", "score")])
