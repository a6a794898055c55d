"""Near duplicates, decontamination and URL rules against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftspark.llm import _tokens, decontam, neardup, urlfilter
from weftspark.llm._cluster import Staged
from weftspark.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k):
    w = WORD.findall(low(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, shingle_set(t, k))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def family(rng, words, copies, share):
    """A text and loose copies in which a share of the words is changed."""
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(copies):
        c = list(base)
        for i in rng.sample(range(words), int(words * rng.uniform(0, share))):
            c[i] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(c))
    return out


def make(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, bucket string").withColumns({"id": F.lit(1), "component": F.lit("c"), "n_shingles": F.lit(None).cast("int")})


@pytest.mark.parametrize("k, small", [(2, 24), (2, 2), (5, 24)])
def test_components_equal_brute_force(spark, monkeypatch, k, small):
    monkeypatch.setattr(neardup, "SMALL", small)
    rng = random.Random(k)
    texts = [t for n in (5, 12, 40, 120) for t in family(rng, n, 9, 0.16)] + family(rng, 200, 40, 0.12)
    texts += ["", None, " \t\n", "one", "One", "one two", "ONE  TWO", "a b c d e f", "a b c d e f g", "é è", "É è", "x " * 3000]
    rng.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(make(spark, texts), k=k).collect()}
    assert got == brute(list(enumerate(texts)), k)


def test_very_long_texts_are_whole(spark):
    rng = random.Random(9)
    long = [f"w{rng.randrange(10**7)}" for _ in range(150_000)]
    near = list(long)
    for i in range(0, 150_000, 40):
        near[i] = "changed"
    far = long[:75_000] + [f"v{rng.randrange(10**7)}" for _ in range(75_000)]
    texts = [" ".join(long), " ".join(near), " ".join(far), " ".join(long[::-1]), "w " * 400_000]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(make(spark, texts)).collect()}
    assert got == brute(list(enumerate(texts)), 2) and got[1][1] == 0 and got[2][1] == 2


def test_neardup_edge_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "A b c"), (None, "a b c"), (None, None), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, neardup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, 1, True), (None, 0, None, True), (3, 0, 3, True)], key=str)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_keeps_one_row(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, 5), (1, long, 4), (1, long, 6), (2, long + " end", 1), (3, "other text of five words", 1), (None, long, 1), (None, "only here without an id", 2), (None, "only here without an id", 1), (4, None, 1), (4, None, 1), (5, "", 1), (6, "", 1), (3, "another text that has the id", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int").withColumns({"row": F.lit(1), "kept": F.lit(None), "a.b": F.lit(2)})
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted([(r[0], r[1], r[2]) for r in kept.collect()], key=str) == sorted([(1, long, 4), (3, "other text of five words", 1), (None, "only here without an id", 1), (4, None, 1), (5, "", 1), (6, "", 1), (3, "another text that has the id", 2)], key=str)
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def test_word_counts():
    texts = ["a b", None, "", " ", "one\x0btwo\x0cthree ", "é\u00a0é x", "end", "start next", " x"]
    assert _tokens.word_counts(pa.array(texts)).to_pylist() == [len(WORD.findall(t or "")) for t in texts]
    assert _tokens.word_counts(pa.array(texts[2:8])).to_pylist() == [len(WORD.findall(t or "")) for t in texts[2:8]] and _tokens.word_counts(pa.array([], pa.string())).to_pylist() == []


def test_word_hashes_agree_with_words():
    texts = ["Ab  ab\tAB x", "", None, "é é\x0bz", " lead and trail ", "x"]
    ((_, _, raw, offsets),) = _tokens.chunks(pa.array(texts))
    start, end, row, h = _tokens.words(raw, offsets)
    seen = [(int(r), bytes(raw[a:b]).decode().lower()) for r, a, b in zip(row, start, end)]
    assert seen == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(low(t))]
    by_word = {}
    for (_, w), x in zip(seen, h):
        assert by_word.setdefault(w, x) == x
    assert len(set(by_word.values())) == len(by_word)
    sliced = list(_tokens.chunks(pa.array(texts).slice(3), 1))
    assert [s[:2] for s in sliced] == [(0, 1), (1, 2), (2, 3)]


def test_estimate_is_near_the_similarity(spark):
    rng = random.Random(5)
    a = [f"w{i}" for i in range(400)]
    b = a[:300] + [f"u{i}" for i in range(100)]
    docs = spark.createDataFrame([(0, " ".join(a)), (1, " ".join(b))], "doc_id long, text string")
    s = neardup.signatures(docs)
    both = s.filter("doc_id = 0").selectExpr(*[f"low{w} as a{w}" for w in range(neardup.LONGS)]).crossJoin(s.filter("doc_id = 1").selectExpr(*[f"low{w} as b{w}" for w in range(neardup.LONGS)]))
    got = both.select(neardup.estimate([F.col(f"a{w}") for w in range(neardup.LONGS)], [F.col(f"b{w}") for w in range(neardup.LONGS)])).first()[0]
    assert abs(got - 299 / 499) < neardup.MARGIN and rng


def test_minima_are_fair():
    g = _tokens.mix(np.arange(1, 201, dtype=np.uint64))
    first = [int(np.argmin(g * m)) for m in neardup._MULTIPLIERS]
    assert len(set(first)) > 70


def brute_hits(docs, items, k=5, threshold=0.8):
    out = set()
    for i, t in docs:
        w = decontam.item_words(t)
        for j, b in items:
            s = decontam.item_shingles(decontam.item_words(b), k)
            if s:
                n = len(next(iter(s)))
                both = len(s & {tuple(w[x : x + n]) for x in range(len(w) - n + 1)})
                if both >= threshold * len(s) - 1e-9:
                    out.add((i, j, len(s), both, both / len(s)))
    return out


def test_containment_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(rng.randrange(30))
    items = [(j, " ".join(word() for _ in range(rng.choice([1, 2, 4, 5, 9, 30, 60])))) for j in range(40)] + [(90, None), (91, ""), (92, "!!"), (5, "Twice  named")]
    docs = [(90, None), (91, ""), (92, "..."), (93, "x" * 50_000)]
    for i in range(60):
        w = [word() for _ in range(rng.choice([3, 40, 900]))]
        part = (items[rng.randrange(40)][1] or "").split()
        if i % 3 == 0:
            part = [p if rng.random() > 0.03 else "changed" for p in part]
        at = rng.randrange(len(w))
        docs.append((i, " ".join(w[:at]) + " <p>" + ", ".join(part).upper() + "</p> " + " ".join(w[at:])))
    frame = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(j, t, "z") for j, t in items], "item_id long, text string, doc_id string")
    got = {tuple(r) for r in decontam.contaminated(frame, bench).collect()}
    assert got == brute_hits(docs, items)
    assert len(got) > 30
    bad = {r[0] for r in got}
    kept = decontam.decontaminate(frame, bench)
    assert kept.columns == frame.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)


@pytest.mark.parametrize("bits, size", [(6, 0), (20, 1 << 20)])
def test_a_crowded_bitmap_and_merge_joins_give_the_same(spark, monkeypatch, bits, size):
    docs = spark.createDataFrame([(i % 8, f"a b c d e f{i} g h i j") for i in range(9)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"b c d e f{i} g h i") for i in range(0, 9, 2)] + [(50 + i, "all begin like this " + f"x{i} y z") for i in range(40)], "item_id long, text string")
    monkeypatch.setattr(decontam, "LEAST_BITS", bits)
    monkeypatch.setattr(decontam, "MOST_BITS", bits)
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", size)
    got = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    assert got == sorted((i % 8, i, 4, 4, 1.0) for i in range(0, 9, 2))
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


def test_sketches_by_size_class(spark):
    items = [(n, " ".join(f"w{n}x{i}" for i in range(n + 4))) for n in (1, 2, 3, 7, 8, 40, 500)]
    staged = Staged(spark, "test")
    table = staged.write(decontam.item_table(spark.createDataFrame(items, "item_id long, text string"), 5))
    rows = decontam.sketches(table, 0.8, staged).groupBy("item", "size_class").agg(F.count(F.lit(1)).alias("length"), F.max("must_meet").alias("m")).collect()
    for n, _ in items:
        (r,) = [r for r in rows if r["size_class"] == n.bit_length() - 1 and (n not in (2, 3) or r["length"] == n)]
        need = max(1, -(-8 * n // 10))
        assert r["m"] == r["length"] - (n - need) >= 1


def test_rows_are_judged_by_id_and_text(spark):
    item = "one two three four five six seven"
    docs = spark.createDataFrame([(1, f"x {item} y", 1), (1, "clean words here", 2), (None, item, 3), (None, "clean", 4), (2, None, 5), (3, item, 6), (3, item, 7)], "doc_id long, text string, `a.b` int").withColumns({"row": F.lit(1), "digest": F.lit("d")})
    kept = decontam.decontaminate(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert kept.columns == docs.columns and sorted(r["a.b"] for r in kept.collect()) == [2, 4, 5]


def test_long_documents_and_items(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[::-1]))], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(words[100:130])), (1, " ".join(words[1000:60_000])), (2, " ".join(words[5:9]))], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()) == [(0, 0), (0, 1), (0, 2)]


def brute_rule(host, path, rules):
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h) + len(p), h.count("."), verdict == "block")
            if best is None or rank > best[0]:
                best = (rank, verdict, h + p)
    return best and best[1:]


def test_trie_equals_brute_force(spark):
    urls = [None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://a.Example.org/es/x?q#f", "https://example.org/en/123", "https://xexample.org/en/1", "http://b.com/de/", "http://b.com/de", "http://c.com/fr//x", "x://y.com?/fr/", "http://a..org/", "http://org.#x", "a://b://c.org/"]
    urls += [f"http://{h}{p}" for h in ("org", "x.org", "example.org", "m.example.org", "com", "z.com") for p in ("", "/", "/es", "/es/", "/en/1", "/en/2", "/fr/a", "/de/?x")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (low(m[1]), m[2]) if m else ("", "")
        want = brute_rule(host, path, URL_RULES)
        assert (got[i]["host"], got[i]["path"], got[i]["verdict"], got[i]["rule"]) == (host, path, *(want or ("allow", None))), u
    longest = urlfilter.UrlTrie([("allow", "org", "/abcdef"), ("block", "x.org", "/a"), ("block", "x.org", "/abc")])
    assert longest.find("x.org", "/abcdef") == ("allow", "org/abcdef") and longest.find("y.x.org", "/abcde") == ("block", "x.org/abc")
    assert urlfilter.UrlTrie([("allow", "org", "/abcd"), ("block", "x.org", "/ab")]).find("x.org", "/abcd") == ("block", "x.org/ab")
    trie = urlfilter.UrlTrie([("allow", "a.b", "/x"), ("block", "a.b", "/x"), ("allow", "b", "/xyz")])
    assert trie.find("c.a.b", "/xyz") == ("block", "a.b/x") and trie.find("b", "/xyz/") == ("allow", "b/xyz")


def test_url_edges(spark, monkeypatch):
    pages = spark.createDataFrame([(2, "http://com/fr/" + "x" * 2_000_000, 0), (1, "http://org/" + "a/" * 50_000, 0), (None, "http://b.com/de/", 0), (None, "http://b.com/de/", 0)], "page_id long, url string, verdict int")
    got = sorted([(r["page_id"], len(r["path"]), r["verdict"], r["rule"]) for r in urlfilter.judge(pages, URL_RULES).collect()], key=str)
    assert got == sorted([(2, 2_000_004, "allow", "com/fr/"), (1, 100_001, "allow", "org/"), (None, 4, "block", "com/de/"), (None, 4, "block", "com/de/")], key=str)
    assert urlfilter.judge(pages.limit(0), URL_RULES).count() == 0 and {r["verdict"] for r in urlfilter.judge(pages, [], default="block").collect()} == {"block"}
    monkeypatch.setattr(urlfilter, "MAX_COST", 300)
    with pytest.raises(ValueError):
        urlfilter.UrlTrie([("allow", "a", "/"), ("allow", "b", "/")])
