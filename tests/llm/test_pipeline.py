"""The corpus pipeline stage by stage against brute force, on the smallest tables."""

import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from test_pairs import brute, brute_hits  # noqa: E402
from test_scores import brute_score, held_out  # noqa: E402

from weftspark.llm import toxicity  # noqa: E402


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def count_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    # learned by one process from the texts themselves, and judged by the rules without tables
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    texts = rows_of(docs)
    examples = [(texts[i], labels[i]) for i in sorted(labels) if labels[i] in (0, 1) and i in texts and not held_out(i) and texts[i] is not None and len(texts[i]) <= toxicity.EXAMPLE_CHARS]
    grammar = toxicity.fit(list(dict(reversed(examples)).items())[::-1])
    first = stage["toxicity"](spark, docs, sf_dir)
    kept = {i: t for i, t in texts.items() if brute_score(grammar, t) < 0.5}
    assert rows_of(first) == kept and first.columns == docs.columns

    second = stage["minhash near-dedup"](spark, first, sf_dir)
    groups = brute(sorted(kept.items()), 5)
    assert set(rows_of(second)) == {i for i in kept if groups[i][2]} and second.columns == docs.columns

    third = stage["benchmark decontamination"](spark, second, sf_dir)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    bad = {h[0] for h in brute_hits(sorted(rows_of(second).items()), items)}
    assert set(rows_of(third)) == set(rows_of(second)) - bad and third.columns == docs.columns

    fourth = stage["mixing sources to target weights"](spark, third, sf_dir)
    words = lambda rows: sum(count_words(r["text"]) for r in rows)
    before, after = third.collect(), fourth.collect()
    assert fourth.columns == docs.columns and abs(words(after) - 1.5 * words(before)) < 0.05 * words(before)

    fifth = stage["sharding"](spark, fourth, sf_dir)
    out = fifth.collect()
    shard = {}
    assert len(out) == len(after) and all(shard.setdefault(r["text"], r["shard"]) == r["shard"] for r in out)
    assert {r["shard"] for r in out} <= set(range(16))


@pytest.fixture
def odd_dir(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, and columns that clash with names used inside."""
    item = "which of these passages is the one that nobody may train on today"
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(1, "some clean text about five different things", "en", "a"), (1, "some clean text about five different things", "en", "a"), (None, None, None, None), (2, None, "en", "b"), (3, "", None, "b")]
    rows += [(4, long, "en", None), (5, long + " more", "en", "a"), (6, f"before {item} after", "de", "b"), (None, f"again {item}", "de", "b"), (None, "a row that has no number of its own", None, "a"), (7, "some clean text about five different things", "en", "b")]
    rows += [(100 + i, f"clean {i} filler {i * 7} words {i * 11} that differ {i * 13} each time {i * 17}", "en", "ab"[i % 2]) for i in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) as n_chars", "1 as shard", "'r' as row", "2 as s", "3 as size", "'x' as `a.b`", "0 as toxic", "cast(null as string) as digest")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100 + i, None, int(i % 3 == 0), "t") for i in range(60)] + [(None, 1, 1, "t"), (1, 1, None, "t")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_odd_rows(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, odd_dir)
    assert out.columns == [c if c != "shard" else "input_shard" for c in docs.columns] + ["shard"]
    rows = out.collect()
    texts = [r["text"] for r in rows]
    assert all(t and "nobody may train" not in t for t in texts) and {r["doc_id"] for r in rows} & {5, 7} == set()
    # the mix takes a document twice at most, and of the repeated row one is left to take
    assert texts.count("some clean text about five different things") <= 2
    assert all(r["input_shard"] == 1 and r["a.b"] == "x" and r["row"] == "r" for r in rows)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, odd_dir).collect()
    assert sum(r["doc_id"] == 1 for r in near) == 1 and {4, 2, 3} <= {r["doc_id"] for r in near} and sum(r["doc_id"] is None for r in near) == 3


def test_empty_table(spark, odd_dir, tmp_path):
    spark.read.parquet(f"{odd_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_two_pipelines_at_once(spark, sf_dir):
    """Each removes what it has staged itself, and nothing of the other's."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        runs = [pool.submit(lambda: sorted(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "shard").collect()))) for _ in range(2)]
        first, second = (r.result() for r in runs)
    assert first == second and first
