"""Forms that matter at scale: long texts in parts, slots in cells, hot conversations, small sources, lost responses."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftspark.llm import _tokens, chat, decontam, mixing, neardup, sharding, warc
from weftspark.llm._cluster import Staged


def texts():
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice(["ab", "Cde", "é", "fghij", "  ", "\t"]) for _ in range(n))
    return pa.array([words(40), None, "", words(3), "x" * 90, words(200), " ", words(1), "lone " + "y" * 300 + " end"])


@pytest.mark.parametrize("limit", [1, 2, 5, 16, 50, 120, 1000])
def test_parts_are_whole_texts(monkeypatch, limit):
    parts = _tokens.parts
    whole = [np.concatenate(c) for c in zip(*[(first + row, h, raw[start], end - start) for first, _, raw, start, end, row, h in _tokens.whole(texts())], strict=True)]
    sets = [_rows(k) for k in (1, 2, 5)]
    counts = _tokens.word_counts(texts())
    spans = list(decontam._chunks(texts().to_pylist()))
    monkeypatch.setattr(_tokens, "parts", lambda t, space=_tokens.SPACE: parts(t, space, limit))
    cut = [np.concatenate(c) for c in zip(*[(first + row, h, raw[start], end - start) for first, _, raw, start, end, row, h in _tokens.whole(texts())], strict=True)]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    assert [_rows(k) for k in (1, 2, 5)] == sets and _tokens.word_counts(texts()) == counts
    words = lambda found: [(first + int(r), raw[a:b]) for first, raw, start, end, row, _ in found for r, a, b in zip(row, start, end, strict=True)]
    assert words(decontam._chunks(texts().to_pylist())) == words(spans)


def _rows(k):
    n = len(texts())
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), texts(), pa.array([None] * n, pa.binary())], ["doc_id", "text", "digest"])
    return [row for out in neardup._signatures(k, iter([batch])) for row in out.to_pylist()]


def test_slots_are_the_same_in_any_number_of_cells(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 900, f"text {i % 300}") for i in range(1000)], "doc_id long, text string")
    slots = lambda: sorted(tuple(r) for r in sharding.shard_slots(rows, shards=4).collect())
    before = slots()
    for cell_rows in (3, 1):
        monkeypatch.setattr(sharding, "CELL_ROWS", cell_rows)
        assert slots() == before
    for shard in range(4):
        mine = sorted(r[4] for r in before if r[3] == shard)
        assert mine == list(range(len(mine)))


def test_a_hot_conversation_is_joined_by_block(spark):
    turns = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(300)] + [(c, 0, "user", f"c{c}") for c in range(2, 40)], "conv_id long, turn long, role string, text string")
    staged = Staged(spark, "test-chat")
    rows = chat.blocks_of(turns, staged)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = chat.render(rows, staged.write(chat.maximal(rows, staged)), chunked=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert any(line.count("block#") == 2 for line in joins)
    both = [sorted(tuple(r) for r in chat.collapse_and_render(turns, chunked=c).groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("chunk", "rendered")))["rendered"], "")).collect()) for c in (False, True)]
    assert both[0] == both[1] and len(both[0]) == 39


def test_gaps_are_filled_as_nearly_as_sums_allow():
    rng = random.Random(5)
    for _ in range(150):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 9))]
        goal = rng.uniform(0.6, 120)
        chosen = mixing.nearest(list(enumerate(sizes)), goal)
        best = min(abs(goal - sum(c)) for n in range(len(sizes) + 1) for c in combinations(sizes, n))
        assert len(set(chosen)) == len(chosen) and abs(abs(goal - sum(sizes[i] for i in chosen)) - best) < 1e-9
    large = [(i, 10**7 + i) for i in range(50)]
    found = mixing.nearest(large, 25.0 * 10**7)
    assert abs(sum(large[i][1] for i in found) - 25 * 10**7) < 10**7


def test_small_sources_come_near_their_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mixing.mixture(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"))
    for r in mixed.collect():
        assert abs(r["n"] - r["t"]) <= 0.01 * r["t"] and r["over"] <= 0, r


def test_a_lost_response_is_noticed(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"page {i // 3}") for i in range(30)], "page_id long, url string, html string")
    staged = Staged(spark, "test-warc")
    records = staged.write(warc.read_archives(warc.write_archives(pages, staged)))
    assert warc.verified(records, staged).count() == 30
    for lost in ("page_id = 9", "page_id in (0, 27)"):
        with pytest.raises(ValueError, match="whose response isn't in the archives"):
            warc.verified(records.filter(f"not ({lost})"), staged)
    wrong = records.withColumn("payload_bytes", F.when(F.expr("page_id = 10"), 99).otherwise(F.col("payload_bytes")))
    with pytest.raises(ValueError, match="page 9"):
        warc.verified(wrong, staged)
