"""Near-duplicate groups by b-bit MinHash.

Each distinct set of word shingles gets ``PERMUTATIONS`` minima.  ``BANDS`` hashes of ``ROWS`` minima each give
candidate buckets; the low ``BITS`` bits of every minimum, packed into longs, give a similarity estimate corrected for
chance collisions by counting equal fields; links are confirmed on the full sets.

No bucket is expanded into pairs.  Every member of a bucket is compared with one hub, the verified links are joined
into components, and only buckets that still hold several components go on.  There the pairs *across* components are
tested: all of them in small buckets, and in large ones those that pass an exact prefix filter, so that no link
between different texts is lost to a bucket's shape.  A pair of similarity 0.8 shares no band with probability
(1 - 0.8**4)**32 < 1e-7, and the estimate rejects it with probability < 1e-6.

Defined cases: a null or wordless text has an empty set and is linked with nothing; a text with fewer words than a
shingle has one shingle of all its words; equal sets are linked; rows that repeat a doc_id are one document; a null
doc_id never names a component (its row gets its class's smallest id, or null) and is always kept; very long texts are
whole sets, hashed a part at a time; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from . import _tokens
from ._cluster import BROADCAST_ROWS, Staged, keyed, matching, without

PERMUTATIONS, BANDS, ROWS, BITS = 128, 32, 4, 2
LONGS = PERMUTATIONS * BITS // 64
#: The estimate may be this far below the threshold: five standard deviations at similarity 0.8.
MARGIN = 0.22
#: Members of a bucket up to which its pairs across components are formed directly: at most so many for each member.
SMALL = 24

_MULTIPLIERS = np.random.default_rng(20240229).integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_U = np.uint64


def _signatures(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts, digests = (batch.column(i) for i in range(3))
        for first, last, _, _, _, row, h in _tokens.whole(texts, places=False):
            n = last - first
            row, g, count = _tokens.distinct(*_tokens.shingles(row, h, n, k), n)
            full = np.flatnonzero(count)
            starts = np.concatenate(([0], np.cumsum(count[full])[:-1])) if len(full) else full
            fp = np.zeros((2, n), _U)
            bands, packed = np.zeros((n, BANDS), _U), np.zeros((n, LONGS), _U)
            if len(full):
                fp[0, full] = _fingerprint(g, starts)
                fp[1, full] = np.bitwise_xor.reduceat(_tokens.mix(g ^ _U(0x5851F42D4C957F2D)), starts)
                minima = np.empty((PERMUTATIONS, len(full)), _U)
                for i, m in enumerate(_MULTIPLIERS):
                    minima[i] = np.minimum.reduceat(g * m, starts)
                for b in range(BANDS):
                    key = np.full(len(full), b + 1, _U)
                    for r in range(ROWS):
                        key = _tokens.mix(key * _U(0x9E3779B97F4A7C15) + minima[b * ROWS + r])
                    bands[full, b] = key
                low = (minima >> _U(20)) & _U((1 << BITS) - 1)
                per = 64 // BITS
                for w in range(LONGS):
                    word = np.zeros(len(full), _U)
                    for i in range(per):
                        word |= low[w * per + i] << _U(i * BITS)
                    packed[full, w] = word
            wide = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(count > 0, BANDS, 0)))).astype(np.int32)), pa.array(bands[full].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, n), digests.slice(first, n), pa.array(count.astype(np.int64)), *(pa.array(x.view(np.int64)) for x in fp), *(pa.array(np.ascontiguousarray(packed[:, w]).view(np.int64)) for w in range(LONGS)), wide],
                ["doc_id", "digest", "n_shingles", "fp1", "fp2", *_PACKED, "bands"],
            )


_PACKED = [f"low{w}" for w in range(LONGS)]


def signatures(docs: DataFrame, k: int = 2, digest: Column | None = None) -> DataFrame:
    """doc_id, digest (as given), n_shingles, a 128-bit fingerprint of the shingle set, the packed low bits and the band
    keys; no shuffle."""
    schema = "doc_id long, digest binary, n_shingles long, fp1 long, fp2 long, " + "".join(f"{c} long, " for c in _PACKED) + "bands array<long>"
    digest = F.lit(None).cast("binary") if digest is None else digest
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), digest).mapInArrow(lambda it: _signatures(k, it), schema)


def _sets(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, _, _, _, row, h in _tokens.whole(batch.column(1), places=False):
            n = last - first
            _, g, count = _tokens.distinct(*_tokens.shingles(row, h, n, k), n)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))).astype(np.int32)), pa.array(g.view(np.int64)))
            fp = np.zeros(n, _U)
            if len(full := np.flatnonzero(count)):
                fp[full] = _fingerprint(g, np.concatenate(([0], np.cumsum(count[full])[:-1])))
            wanted = batch.column(2).slice(first, n)
            out = pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), wanted, lists], ["id", "fp1", "items"])
            # a repeated doc_id may have several texts; those that a representative stands for are kept
            yield out.filter(pa.array(fp.view(np.int64) == wanted.to_numpy()))


def _fingerprint(g: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(_tokens.mix(g), starts)


def shingle_sets(docs: DataFrame, ids: DataFrame, n: int, k: int = 2) -> DataFrame:
    """id, fp1 and the distinct shingle hashes of the texts named by ``ids`` (doc_id, fp1), of which there are ``n``.

    Few ids are broadcast and no text is moved; many are joined by a shuffle.
    """
    few = F.broadcast(ids) if n <= BROADCAST_ROWS else ids.hint("merge")
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(few, "doc_id").select("doc_id", "text", "fp1")
    return rows.mapInArrow(lambda it: _sets(k, it), "id long, fp1 long, items array<long>")


def estimate(left: list[Column], right: list[Column]) -> Column:
    """Similarity from packed low bits, corrected for the 2**-BITS of fields that are equal by chance."""
    mask = F.lit(0x5555555555555555)
    differ = None
    for a, b in zip(left, right, strict=True):
        x = a.bitwiseXOR(b)
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(mask))
        differ = n if differ is None else differ + n
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / F.lit(float(PERMUTATIONS))) - chance) / (1 - chance)


def _both_sides(pairs: DataFrame, table: DataFrame, values: list[str]) -> DataFrame:
    """Join pairs (a, b) with ``table`` (unique ``id``) on both ends.

    ``b`` may be shared by very many pairs.  ``pairs`` and ``table`` are staged, so both sides of each join are plain
    shuffles and Spark splits a partition that holds a hot ``b``.
    """
    for end in ("a", "b"):
        pairs = pairs.join(table.select(F.col("id").alias(end), *[F.col(v).alias(f"{end}_{v}") for v in values]).hint("merge"), end)
    return pairs


def components(edges: DataFrame, staged: Staged) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b): its component's smallest id.

    Minimum labels flow along edges and then jump along labels, so chains shorten geometrically; each round is written
    to the shared folder.  Joins read staged tables on both sides, so that Spark can split a hot hub or label.
    """
    both = staged.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = staged.write(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        seen = both.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        near = staged.write(now.join(seen, "id").select("id", "component", F.least("component", "m").alias("via")))
        jump = near.select("id", F.col("component").alias("was"), "via").join(near.select(F.col("id").alias("via"), F.col("via").alias("top")), "via")
        after = staged.write(jump.select("id", "was", F.col("top").alias("component")))
        moved = after.filter(F.col("was") != F.col("component")).limit(1).count()
        staged.drop(now, near)
        now = after
        if not moved:
            staged.drop(both)
            return now.select("id", "component")


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text, ...).

    Documents are linked when 100 * intersection >= ``percent`` * union of their sets of ``k``-word shingles.
    """
    return _judged(docs, k, percent, None).select("doc_id", "n_shingles", "component_id", "kept")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates, all its columns, and of its equal rows one.

    Rows without a doc_id go if their text's class has a document with one; else they stay, one of each text.
    """
    staged = Staged(docs.sparkSession, "neardup-rows")
    judged = staged.write(_judged(docs, k, percent, F.unhex(F.md5(F.col("text").cast("string")))))
    stays = F.col("kept") & (F.col("doc_id").isNotNull() | F.col("component_id").isNull())
    rows = staged.write(judged.groupBy("doc_id", "digest").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1 or not stays"))
    named, repeated = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("stays")).cast("long")), F.lit(0))).first()
    out = without(docs, rows, named)
    if repeated:
        alike = matching(keyed(docs), rows.filter("stays"), repeated, "left_semi")
        # the smallest in its other columns, where these have an order
        one = F.first("row") if "map<" in docs.schema.simpleString() else F.min("row")
        out = out.unionByName(alike.groupBy("doc_id", "digest").agg(one.alias("row")).select("row.*"))
    return out


def _judged(docs: DataFrame, k: int, percent: int, digest: Column | None) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    staged = Staged(spark, "neardup")
    all_docs = staged.write(signatures(docs, k, digest))
    fp = ["fp1", "fp2", "n_shingles"]
    classes = staged.write(all_docs.filter("n_shingles > 0").groupBy(*fp).agg(F.min("doc_id").alias("id")))
    named = all_docs.select(F.col("doc_id").alias("id"), *fp, *_PACKED, "bands").join(classes.select("id", *fp).hint("merge"), ["id", *fp], "left_semi")
    reps = staged.write(named.select("id", *_PACKED, "fp1", "bands"))
    if reps.count() > classes.count():  # repeated rows
        reps = staged.write(reps.dropDuplicates(["id", "fp1"]))
    links, comps = _link(docs, reps.select("id", *_PACKED, "fp1"), reps.select("id", F.explode("bands").alias("bucket")), staged, k, percent)
    named_classes = staged.write(classes.join(comps, "id", "left").select(*fp, F.coalesce("component", "id").alias("component")))
    staged.drop(classes, reps, links)
    # empty sets get keys of their own, so that they don't meet in one task
    empty = F.col("n_shingles") == 0
    rows = all_docs.select("doc_id", "digest", F.when(empty, F.xxhash64("doc_id")).otherwise(F.col("fp1")).alias("fp1"), "fp2", "n_shingles")
    out = rows.join(named_classes.hint("merge"), fp, "left")
    component = F.when(empty, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "digest", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _link(docs: DataFrame, reps: DataFrame, entries: DataFrame, staged: Staged, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between class representatives, and (id, component) of those that have one.

    Joins on a bucket read staged tables on both sides, so that Spark can split a hot bucket.
    """
    sizes = staged.write(entries.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    members = staged.write(entries.join(sizes.select("bucket", "hub").hint("merge"), "bucket"))
    links = _confirm(members.filter("id != hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct(), docs, reps, staged, k, percent)
    comps = components(links, staged)
    mine = staged.write(members.select("bucket", "id").join(comps.hint("merge"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component")))
    parts = mine.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n"))
    open_ = staged.write(parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("bucket", "n"))
    rest = staged.write(mine.join(open_.hint("merge"), "bucket"))
    staged.drop(sizes, members, mine)
    low = rest.filter(F.col("n") <= SMALL).join(reps.hint("merge"), "id")
    other = low.select(F.col("bucket").alias("b_bucket"), F.col("id").alias("b"), F.col("component").alias("b_component"), *[F.col(c).alias(f"b_{c}") for c in _PACKED])
    alike = estimate([F.col(c) for c in _PACKED], [F.col(f"b_{c}") for c in _PACKED]) >= percent / 100 - MARGIN
    pairs = low.join(other, (F.col("bucket") == F.col("b_bucket")) & (F.col("component") < F.col("b_component")) & alike).select(F.col("id").alias("a"), "b")
    big = staged.write(rest.filter(F.col("n") > SMALL).select("id", "component").distinct().join(reps.select("id", "fp1").hint("merge"), "id"))
    n = big.count()
    if n:
        pairs = pairs.union(_prefix_pairs(shingle_sets(docs, big.select(F.col("id").alias("doc_id"), "fp1"), n, k), big, staged, percent))
    more = _confirm(pairs.distinct(), docs, reps, staged, k, percent)
    staged.drop(rest, big, open_)
    if more.limit(1).count():
        links = staged.write(links.union(more))
        comps = components(links, staged)
    return links, comps


def _prefix_pairs(sets: DataFrame, members: DataFrame, staged: Staged, percent: int) -> DataFrame:
    """Pairs (a, b) of ``members`` in different components that may be linked, by the exact prefix filter.

    Each set is ordered by how few sets hold a shingle.  Two sets of the needed similarity share a shingle in the first
    ``100 - percent`` hundredths of both, and what follows their first common shingle must still suffice.  Copies that
    differ from their family by more than that have a prefix of shingles that nobody shares and meet no one, so a large
    family of loose copies isn't expanded.  A shingle whose holders are all in one component is dropped, and pairs
    inside a shingle's largest component are never formed.
    """
    tokens = staged.write(sets.select("id", "fp1", F.size("items").alias("size"), F.explode("items").alias("token")))
    shared = staged.write(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    known = tokens.join(shared.hint("merge"), "token")
    ordered = known.groupBy("id", "fp1", "size").agg(F.array_sort(F.collect_list(F.struct("n", "token"))).alias("held"))
    alone = F.col("size") - F.size("held")
    length = F.col("size") - F.expr(f"({percent} * size + 99) div 100").cast("int") + 1 - alone
    prefix = ordered.filter(length > 0).select("id", "size", alone.alias("alone"), F.posexplode(F.slice("held", F.lit(1), length)).alias("p", "t"))
    entries = staged.write(prefix.select("id", "size", F.col("t.token").alias("token"), (F.col("alone") + F.col("p")).alias("pos")).join(members.select("id", "component").hint("merge"), "id"))
    by_part = entries.groupBy("token", "component").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"))
    stats = staged.write(by_part.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", "n").alias("top"), F.min("least").alias("least")).filter("parts > 1"))
    # the largest partner for which the rest of the set still suffices must not be smaller than any
    room = F.expr(f"({100 + percent} * (size - pos) - {percent} * size) >= {percent} * least")
    live = staged.write(entries.join(stats.select("token", "top", "least").hint("merge"), "token").filter(room).select("token", "id", "component", "size", "pos", "top"))
    minor = live.filter("component != top").select("token", F.col("id").alias("a"), F.col("component").alias("c"), F.col("size").alias("s"), F.col("pos").alias("q"))
    enough = F.expr(f"{100 + percent} * least(size - pos, s - q) >= {percent} * (size + s)")
    pairs = minor.join(live.select("token", "id", "component", "size", "pos"), "token").filter((F.col("c") != F.col("component")) & enough)
    out = staged.write(pairs.select(F.greatest("a", "id").alias("a"), F.least("a", "id").alias("b")).distinct())
    staged.drop(tokens, shared, entries, stats, live)
    return out


def _confirm(pairs: DataFrame, docs: DataFrame, reps: DataFrame, staged: Staged, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class representatives that are linked: by the estimate first, then on the full sets."""
    likely = _both_sides(pairs, reps, [*_PACKED, "fp1"]).filter(estimate([F.col(f"a_{c}") for c in _PACKED], [F.col(f"b_{c}") for c in _PACKED]) >= percent / 100 - MARGIN)
    likely = staged.write(likely.select("a", "b", "a_fp1", "b_fp1"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("doc_id"), F.col("a_fp1").alias("fp1")), F.struct(F.col("b").alias("doc_id"), F.col("b_fp1").alias("fp1"))))
    ids = staged.write(likely.select(ends.alias("e")).select("e.doc_id", "e.fp1").distinct())
    named = ids.count()
    sets = staged.write(shingle_sets(docs, ids, named, k))
    if sets.count() > named:  # repeated rows
        sets = staged.write(sets.dropDuplicates(["id", "fp1"]))
    both = F.size(F.array_intersect("a_items", "b_items"))
    close = 100 * both >= percent * (F.size("a_items") + F.size("b_items") - both)
    # pairs are distinct already; an aggregation here would keep Spark from splitting a hot b
    out = staged.write(_both_sides(likely.select("a", "b"), sets, ["items"]).filter(close).select("a", "b"))
    staged.drop(likely, ids, sets)
    return out
