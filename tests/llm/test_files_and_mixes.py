"""Chat, sharding, WARC, JPEG and mixing against brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftspark.llm import chat, jpeg, mixing, sharding, warc
from weftspark.llm._cluster import Staged, lookup


def conversations(rng, n):
    rows, conv = [], 0
    for _ in range(n):
        turns = [("user" if k % 2 == 0 else "assistant", rng.choice(["hi", "ok", None, ""]) if k == 0 else f"t{rng.randrange(6)}") for k in range(rng.randrange(1, 9))]
        for stop in sorted({len(turns), *(rng.randrange(1, len(turns) + 1) for _ in range(2))}):
            start, gap = rng.randrange(3), rng.choice([1, 5])
            rows += [(conv, start + gap * k, role, text) for k, (role, text) in enumerate(turns[:stop])]
            conv += 1
    return rows


def brute_chat(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role is not None, role or "", text is None, hashlib.md5((text or "").encode()).hexdigest(), role, text))
    lists = {c: [x[6:] for x in sorted(v)] for c, v in by.items()}
    keep = []
    for c, v in lists.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in lists.values())
        twin = any(w == v and (d is not None and (c is None or d < c)) for d, w in lists.items() if d != c)
        if not longer and not twin:
            keep.append((c, len(v), "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in v)))
    return sorted(keep, key=str)


ODD_TURNS = [(1000, 0, None, "x"), (1001, 0, "", "x"), (1002, 0, "user", None), (1003, 0, "user", ""), (None, 0, "user", "lonely"), (None, 1, "user", "lonely"), (1004, None, "user", "z"), (1004, 3, "user", "a"), (1005, 1, "user", "dup"), (1005, 1, "user", "dup")]
SPARSE_TURNS = [(2000, None, "user", "n"), (2000, 0, "user", "zero"), (2000, 5000, "user", "far"), (2001, -3, "user", "n"), (2001, 2**40, "user", "zero")]
LONG_TURNS = [(3000, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(10_000)] + [(3001, k, "user" if k % 2 == 0 else "assistant", f"turn {k}") for k in range(9_000)] + [(3002, None, "user", f"null {k % 7}") for k in range(9000)]


@pytest.mark.parametrize("case", ["many", "long"])
def test_maximal_conversations(spark, case):
    rows = conversations(random.Random(3), 25) + ODD_TURNS + SPARSE_TURNS if case == "many" else LONG_TURNS + [(3003, 0, "user", "w" * 2_000_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"block": F.lit(1), "total": F.lit("t"), "digest": F.lit(None), "none": F.lit(3)})
    got = sorted([(r["conv_id"], r["n_turns"], r["rendered"]) for r in chat.collapse_and_render(frame).filter("chunk = 0").collect()], key=str)
    assert got == brute_chat(rows)
    parts = defaultdict(list)
    for r in chat.collapse_and_render(frame, chunked=True).collect():
        parts[(r["conv_id"], r["n_turns"])].append((r["chunk"], r["rendered"]))
    assert sorted([(c, n, "".join(t for _, t in sorted(v))) for (c, n), v in parts.items()], key=str) == got
    assert all([k for k, _ in sorted(v)] == list(range(len(v))) for v in parts.values())
    assert chat.collapse_and_render(frame.limit(0)).count() == 0


def test_equal_turns_of_one_conversation_are_spread_over_tasks(spark):
    turns = spark.range(20_000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("same").alias("text"))
    staged = Staged(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = chat.blocks_of(turns, staged).groupBy("block").count().agg(F.count(F.lit(1)), F.max("count")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most[0] >= 4 and most[1] < 10_000


def test_chat_equals_its_sql(spark, tmp_path):
    import duckdb

    from weftspark.llm import queries

    rows = conversations(random.Random(5), 12) + ODD_TURNS + SPARSE_TURNS
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op1_chat_formatting(spark, str(tmp_path)).select("conv_id", "chunk", "n_turns", "rendered").collect()
    db = duckdb.connect()
    db.sql(f"create view conversations as from '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(map(tuple, got), key=str) == sorted(db.sql(queries.ORACLE["op1_chat_formatting"]).select("conv_id, chunk, n_turns, rendered").fetchall(), key=str)


def need(sizes, capacity):
    shards, held = 1, 0
    for x in sizes:
        if x > capacity:
            return 10**9
        if held + x > capacity:
            shards, held = shards + 1, 0
        held += x
    return shards


def minimax(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if need(sizes, middle) <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("bits, step, n", [(12, 6, 300), (2, 1, 40), (3, 2, 200), (12, 6, 5)])
def test_capacity_is_the_least(spark, monkeypatch, bits, step, n):
    monkeypatch.setattr(sharding, "FIRST_BITS", bits)
    monkeypatch.setattr(sharding, "STEP_BITS", step)
    rng = random.Random(n)
    texts = [None, "", "", "é" * 40] + ["x" * rng.choice([1, 10, 100, 1000]) + str(rng.randrange(n // 2 + 1)) for _ in range(n)] + ["hot"] * 30
    docs = spark.createDataFrame([(i, t, i, "k") for i, t in enumerate(texts)], "doc_id long, text string, size long, key string")
    rows = sharding.shard_slots(docs, shards=4).collect()
    assert len(rows) == len(texts)
    shard_of, size_of = defaultdict(set), Counter()
    for r in rows:
        t = texts[r["doc_id"]] or ""
        shard_of[t].add(r["shard"])
        size_of[r["shard"]] += r["size"]
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
    assert all(len(s) == 1 for s in shard_of.values()) and set(size_of) <= set(range(4))
    groups = Counter()
    for t in texts:
        groups[int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16)] += len((t or "").encode()) + 1
    assert max(size_of.values()) == minimax([groups[k] for k in sorted(groups)], 4)
    for s in size_of:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assigned = sharding.assign(docs, shards=4)
    assert assigned.columns == [*docs.columns, "shard"] and {r["doc_id"]: r["shard"] for r in assigned.collect()} == {r["doc_id"]: r["shard"] for r in rows}


def test_sharding_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, None)], "doc_id long, text string")
    rows = sharding.shard_slots(docs).collect()
    assert len(rows) == 4 and len({r["shard"] for r in rows if r["size"] == 2}) == 1
    assert sharding.shard_slots(docs.limit(0)).count() == 0 and sharding.assign(docs.limit(0)).count() == 0


def test_thousands_of_shards(spark):
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 9000).cast("string")).alias("text"), F.lit("mine").alias("Shard"), F.lit(1).alias("a.b"))
    rows = sharding.shard_slots(docs, shards=10_000).collect()
    sizes, of = Counter(), {}
    for r in rows:
        sizes[r["shard"]] += r["size"]
        of[r["doc_id"]] = r["shard"]
    assert len(rows) == 12_000 and set(sizes) <= set(range(10_000)) and all(of[i] == of[i + 9000] for i in range(3000))
    groups = Counter()
    for i in range(12_000):
        groups[int(hashlib.md5(f"text {i % 9000}".encode()).hexdigest()[:15], 16)] += len(f"text {i % 9000}") + 1
    assert max(sizes.values()) == minimax([groups[k] for k in sorted(groups)], 10_000)
    assigned = sharding.assign(docs, shards=10_000)
    assert assigned.columns == ["doc_id", "text", "input_shard", "a.b", "shard"]
    assert {r["doc_id"]: r["shard"] for r in assigned.collect()} == of and assigned.filter("input_shard != 'mine'").count() == 0


def test_equal_rows_share_runs_of_slots(spark):
    docs = spark.range(30_000, numPartitions=6).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.lit("cold")).alias("text"))
    rows = sharding.shard_slots(docs, shards=3).collect()
    for s in {r["shard"] for r in rows}:
        mine = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert mine == list(range(len(mine)))
    assert len(rows) == 30_000


def test_lookup_deals_hot_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 3000, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 700)).alias("k"), "id")
    table = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).filter("n > 2")
    got = {(r["k"], r["id"]): r["first"] for r in lookup(df, table, "k", "n", 5000, parts=4).collect()}
    first = {r["k"]: r["first"] for r in table.collect()}
    assert len(got) == 5000 and all(v == first.get(k) for (k, _), v in got.items())


def test_archives_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "<p>a</p>"]
    rows = [(10 - i, f"http://h/{i}\r\nX: y" if i else None, h, "e") for i, h in enumerate(html)] + [(4, "again", "<p>a</p>", "e"), (None, "u", "<p>a</p>", "e"), (None, "u", "only null", "e")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string")
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h, _ in rows:
        b, f = (h or "").encode(), first.get(h or "")
        again = f is not None and i != f
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", f if again else None))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    small = warc.round_trip(pages, least=9).filter("payload_bytes < 9").select("record_type").distinct().collect()
    assert [r[0] for r in small] == ["response"]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_gzip_files_of_records(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 3}") for i in range(90)], "page_id long, url string, html string")
    archives = warc.write_archives(pages, Staged(spark, "warc"), folder=f"file://{tmp_path}/a")
    listed = {r["name"]: r for r in archives.collect()}
    assert len(listed) > 1 and {p.name for p in (tmp_path / "a").iterdir()} == set(listed) and all(r["content"] is None for r in listed.values())
    assert warc.export(archives, str(tmp_path / "b")) == len(listed)
    for folder in ("a", "b"):
        text = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / folder).iterdir())
        assert text.count(b"WARC/1.1\r\n") == 90 and text.count(b"WARC-Type: revisit") == 87
    one = warc.member(warc.record(1, "u", b"abc", warc.digest(b"abc"), None))
    assert [f["WARC-Type"] for f, _ in warc.read_records(one + one)] == ["response"] * 2
    for bad in (warc.member(warc.record(1, "u", b"abc", warc.digest(b"abc"), None).replace(b"abc", b"abd")), one[:-3]):
        with pytest.raises(ValueError):
            list(warc.read_records(bad))


def test_archives_stay_rows_where_a_store_cannot_be_opened(spark, monkeypatch):
    monkeypatch.setattr(warc, "open_store", lambda folder: None)
    pages = spark.createDataFrame([(i, None, f"page {i % 3}") for i in range(9)], "page_id long, url string, html string")
    archives = warc.write_archives(pages, Staged(spark, "warc"))
    assert archives.filter("content is null").count() == 0 and warc.read_archives(archives).filter("record_type = 'revisit'").count() == 6


def test_reading_archives_takes_linear_time():
    import time

    def seconds(n):
        archive = b"".join(warc.member(warc.record(i, "u", b"x%d" % i, "d", None)) for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc.read_records(archive)) == n
        return time.process_time() - began

    seconds(500)
    assert seconds(16_000) < 8 * seconds(4_000)


@pytest.mark.parametrize("few", [10**6, 10])
def test_half_of_the_payloads_are_repeated(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", few)
    pages = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("p"), F.col("id"))).when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id") % 50)).alias("html"))
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    first = {}
    for i in sorted(html):
        first.setdefault(html[i], i)
    got = {r["page_id"]: r["refers_to"] for r in warc.round_trip(pages).collect()}
    assert got == {i: first[h] if first[h] != i else None for i, h in html.items()}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=4))
def test_jpeg_keeps_every_byte(texts):
    payloads = [jpeg.pad(t) for t in texts]
    images = jpeg.thumbnails(jpeg.encode(payloads))
    assert [b"".join(s.tobytes() for _, _, s in i) for i in images] == payloads


def test_jpeg_sizes(monkeypatch):
    monkeypatch.setattr(jpeg, "SIDE", 48)
    payload = random.Random(1).randbytes(192 * 40)
    ((*several,),) = (jpeg.thumbnails(jpeg.encode([payload])),)
    assert len(several[0]) > 1 and b"".join(s.tobytes() for _, _, s in several[0]) == payload
    assert all(w <= 65535 and h <= 65535 for w, h, _ in several[0])


def brute_feature(payload):
    """Dimensions, and for each of 64 equal runs of bytes whether their mean is above the whole's, image by image."""
    parts = []
    for (w, h), (first, last) in zip(jpeg._sides(len(payload)), jpeg._pieces(len(payload)), strict=True):
        s = payload[first:last]
        mean = Fraction(sum(s), len(s))
        bits = 0
        for i in range(64):
            run = s[i * len(s) // 64 : (i + 1) * len(s) // 64]
            bits = 2 * bits + (Fraction(sum(run), len(run)) > mean)
        parts.append(f"{8 * w}x{8 * h}:{bits:016x}")
    return "+".join(parts)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, jpeg.IMAGE - 1, jpeg.IMAGE + 1, 3 * jpeg.IMAGE + 100])
def test_features_by_the_definition(n):
    text = random.Random(n).randbytes(n // 2) + b"a" * (n - n // 2)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([b"first", text], pa.binary())], ["doc_id", "text"])
    row = [r for b in jpeg._features(iter([batch])) for r in b.to_pylist()][1]
    payload = text + b" " * (-n % 192 if n else 192)
    stored = jpeg.encode([payload])[0]
    assert row == {"doc_id": 2, "n_bytes": n, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": brute_feature(payload)}


def test_long_texts_need_little_memory():
    import resource

    text = b"0123456789abcdef" * (30 << 16)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    jpeg._long_features(text)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # KB, of 30 MB of text


def test_jpeg_with_other_tables_and_ac_coefficients():
    """A hand-made image: 3 x 2 blocks, no restart markers, ordinary tables, AC coefficients with runs and a ZRL."""
    dc_counts = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
    dc_symbols = bytes(range(12)[:12])[: sum(dc_counts)]
    ac_symbols = bytes([0x00, 0x01, 0x12, 0xF0, 0x33])
    ac_counts = bytes([0, 2, 3] + [0] * 13)

    def codes(counts, symbols):
        out, code, at = {}, 0, 0
        for length, n in enumerate(counts, 1):
            for _ in range(n):
                out[symbols[at]] = format(code, f"0{length}b")
                code, at = code + 1, at + 1
            code <<= 1
        return out

    dc, ac = codes(dc_counts, dc_symbols), codes(ac_counts, ac_symbols)

    def bits(v):
        n = abs(v).bit_length()
        return n, format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    values, stream, before = [5, -30, 60, 60, 0, -7], "", 0
    for i, v in enumerate(values):
        n, extra = bits(v - before)
        stream += dc[n] + extra
        before = v
        if i == 1:
            stream += ac[0x12] + "10" + ac[0xF0] + ac[0x33] + "101"
        if i == 2:
            stream += (ac[0x01] + "1") * 63
        else:
            stream += ac[0x00]
    stream += "1" * (-len(stream) % 8)
    scan = bytes(int(stream[k : k + 8], 2) for k in range(0, len(stream), 8)).replace(b"\xff", b"\xff\0")
    data = b"\xff\xd8" + jpeg._segment(0xFE, b"note") + jpeg._segment(0xDB, b"\0" + bytes([16] + [1] * 63))
    data += jpeg._segment(0xC0, bytes([8, 0, 13, 0, 24, 1, 1, 0x11, 0])) + jpeg._segment(0xC4, b"\0" + dc_counts + dc_symbols + b"\x10" + ac_counts + ac_symbols)
    data += jpeg._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    plain = jpeg.encode([b"a" * 192])[0]
    (((w, h, samples),), second) = jpeg.thumbnails([data, plain])
    assert (w, h) == (24, 13)
    assert samples.tolist() == [min(255, max(0, (v * 16 + 4) // 8 + 128)) for v in values]
    assert second[0][2].tobytes() == b"a" * 192
    for bad in (data[:-2], b"xx" + data, data.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(jpeg.BadJpeg):
            jpeg.thumbnails([bad])


def test_media_query(spark):
    texts = [None, "", "a", "é" * 96, "long " * 30_000, "a"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, "a", 1)], "doc_id long, text string, media int")
    rows = jpeg.media_features(docs).collect()
    assert len(rows) == 7 and len({tuple(r)[1:] for r in rows if r["n_bytes"] == 1}) == 1
    stored = {r["doc_id"]: bytes(r["media"]) for r in jpeg.store_media(docs.filter("doc_id is not null")).collect()}
    for r in rows:
        t = ("a" if r["doc_id"] is None else texts[r["doc_id"]] or "").encode()
        p = t + b" " * (-len(t) % 192 if t else 192)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        if r["doc_id"] is not None:
            assert (r["media_bytes"], r["media_sha256"]) == (len(stored[r["doc_id"]]), hashlib.sha256(stored[r["doc_id"]]).hexdigest())
    assert jpeg.media_features(docs.limit(0)).count() == 0


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        rest = total - sum(capped.values())
        out = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if out[s] > 2 * sizes[s]]
        if not above:
            return capped | out
        capped |= {s: 2.0 * sizes[s] for s in above}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text("abé", max_size=2)), st.integers(0, 1000), min_size=1, max_size=8))
def test_targets(sizes):
    got, want = mixing.targets(list(sizes.items())), brute_targets(sizes) if any(sizes.values()) else dict.fromkeys(sizes, 0.0)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def test_split_is_exact():
    quotas = np.array([5, 0, 300, 17])
    out = mixing.split(quotas, 7)
    assert (out.sum(axis=1) == quotas).all() and (out >= 0).all() and out.sum(axis=0).max() - out.sum(axis=0).min() <= 3
    assert (out == mixing.split(quotas, 7)).all()


def test_mixture(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([1, 5, 60, 200]))), rng.choice(["a", "b", "c", None, "dd"])) for i in range(600)]
    rows += [(600 + i, t, "a") for i, t in enumerate([None, "", " ", "a\x0bb c"])] + [(5, "again", "b"), (None, "no id", "c")]
    docs = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, source string, mix string")
    out = mixing.mixture(docs).collect()
    assert len(out) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = brute_targets(dict(sizes))
    by = defaultdict(list)
    for r in out:
        by[r["source_size"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
    for s, n in sizes.items():
        assert len({x for x in sizes.values()}) == len(sizes)
        assert abs(by[n][0]["target"] - want[s]) < 1e-6 * want[s]
        assert abs(sum(r["taken"] for r in by[n]) - want[s]) <= max(2, 0.01 * want[s])
    again = mixing.mixture(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    copies = mixing.mix(docs)
    assert copies.columns == docs.columns and sum(size(r["text"]) for r in copies.collect()) == sum(r["taken"] for r in out)
    dealt = mixing.mixed_shards(docs, 4).collect()
    assert {r["shard"] for r in dealt} <= {0, 1, 2, 3} and len(dealt) == copies.count()
    order = [(r["shard"], r["local_order"]) for r in mixing.mixed_shards(docs, mixing.SHARDS).collect()]
    assert order == sorted(order) == sorted((s, o) for r in out for s, o in zip(r["shards"], r["orders"], strict=True))
    assert mixing.mixture(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_partitions_of_a_shard_are_in_order(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_WORDS", 40)
    docs = spark.createDataFrame([(i, "a b c " * (1 + i % 5), f"s{i % 2}") for i in range(500)] + [(900, "long " * 300_000, "s0")], "doc_id long, text string, source string")
    rows = mixing.mixed_shards(docs, 3).select("shard", "local_order", F.spark_partition_id().alias("p")).collect()
    assert len({r["p"] for r in rows}) > 10
    order = [(r["shard"], r["local_order"]) for r in rows]
    assert order == sorted(order) and len({r["shard"] for r in rows}) == 3


def brute_mixture(sources, rows):
    """What each document is taken, from the tree's deal: block after block of the permuted hash ranges."""
    width = mixing.KEY_BITS - 8
    by = {s.key: s for s in sources}
    taken = []
    for r in rows:
        s, n = by[r["s"]], 0
        for e in range(s.passes + 1):
            if s.deal[e * mixing.BLOCKS + (r["k"] >> width)] >= 0 and (e < s.passes or r["k"] < s.cut or r["k"] in s.fill):
                n += 1
        taken.append((r["doc_id"], r["size"], n * r["size"]))
    return sorted(taken, key=str)


def test_taken_is_what_the_shards_draw(spark, sf_dir):
    rows = Staged(spark, "test").write(mixing.sized(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    sources = mixing.plan(rows)
    got = mixing.with_copies(rows, sources).select("doc_id", "size", (F.col("size") * F.size("copies")).alias("taken")).collect()
    assert sorted(map(tuple, got), key=str) == brute_mixture(sources, rows.collect())
    # nothing is taken of a block that no shard has drawn
    sources[0].deal = tuple(-1 for _ in sources[0].deal)
    got = mixing.with_copies(rows, sources).filter(F.col("s") == sources[0].key).agg(F.sum(F.size("copies"))).first()[0]
    assert got == 0


def test_many_sources_are_joined_without_a_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 50}") for i in range(400)], "doc_id long, text string, source string")
    whole = sorted(map(str, mixing.mixture(docs).collect()))
    monkeypatch.setattr(mixing, "PLAN_ROWS", 10)
    assert sorted(map(str, mixing.mixture(docs).collect())) == whole
