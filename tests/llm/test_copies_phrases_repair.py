"""Exact dedup, phrase collocations and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftspark.llm import _tokens, collocation, exactdup, repair

WORD = re.compile(r"[^\x20\x09-\x0D]")


def clashing():
    return {"sha": F.lit(1), "key": F.lit("k"), "weight": F.lit(2.0), "conv": F.lit(None).cast("int"), "block": F.lit("b"), "n": F.lit(7), "f": F.lit(1)}


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# exact dedup


@pytest.mark.parametrize("n, width", [(1, 30), (2, 3), (8, 3), (500, 20), (500, 9), (3000, 54), (1, 1)])
def test_golomb_codes_round_trip(n, width):
    rng = np.random.default_rng(n + width)
    values = np.unique(rng.integers(0, 2**width, n, dtype=np.uint64))
    for r in {exactdup.parameter(len(values), width), 0 if width < 12 else width - 8, width}:
        assert (exactdup.decode(exactdup.encode(values, r), len(values), r) == values).all()


def test_golomb_codes_are_short():
    values = np.unique(np.random.default_rng(1).integers(0, 2**30, 100_000, dtype=np.uint64))
    assert len(exactdup.encode(values, exactdup.parameter(len(values), 30))) * 8 < 16 * len(values)


def brute_copies(rows):
    same = defaultdict(list)
    for i, t in rows:
        same[low(t)].append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in same.items()}
    return sorted(((i, keep[low(t)], len(same[low(t)]), i == keep[low(t)], hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows), key=repr)


@pytest.mark.parametrize("slack", [exactdup.SLACK, -20])
def test_copies_equal_brute_force(spark, monkeypatch, slack):
    monkeypatch.setattr(exactdup, "SLACK", slack)  # so few bits make nearly every text a suspect
    rng = random.Random(4)
    texts = [f"Text {rng.randrange(60)} É" for _ in range(300)] + ["", None, "", "a", "A", "é", "É", "x" * 2_000_000, "X" * 2_000_000] + [f"alone {i}" for i in range(100)] + ["hot"] * 400
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "a"), (None, "nobody's"), (None, "nobody's")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clashing()).repartition(5)
    got = exactdup.duplicates(df)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_copies(rows)
    assert exactdup.duplicates(df.limit(0)).collect() == []


# phrases


def brute_phrases(rows, least, first=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", low(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for s in range(len(p) - m + 1):
                    longer[p[s : s + m]] = max(longer[p[s : s + m]], a)
        scored = [(*min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p))), p, a) for p, a in found.items() if 100 * longer[p] < 80 * a]
        scored.sort(key=lambda s: (-s[0], -s[3], " ".join(s[2]).encode()))
        out += [(lang, i + 1, " ".join(p), a, c[p[:k]], c[p[k:]], n[lang], score) for i, (score, k, p, a) in enumerate(scored[:first])]
    return sorted(out)


def phrase_rows():
    rng, rows = random.Random(3), []
    for _ in range(120):
        w = [rng.choice(["alpha", "Beta", "gamma", "de", "é", "É", "the", "of", f"x{rng.randrange(300)}"]) for _ in range(rng.randrange(1, 200))]
        rows.append(("".join(x + rng.choice([" ", "  ", "\t", " ", " ", ". ", ", ", "\n", "! ", " \x0b "]) for x in w), rng.choice(["a", "b", None, "und"])))
    return rows + [("", "a"), (None, "b"), ("  ..", None), ("the of gamma de " * 100_000, "a"), ("once only", "c")]


@pytest.mark.parametrize("least, first", [(30, 2000), (30, 3), (3, 50)])
def test_phrases_equal_brute_force(spark, least, first):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "text string, lang string").withColumns(clashing()).repartition(4)
    got = collocation.collocations(df, least=least, first=first)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, least, first)


def test_no_phrases(spark):
    df = spark.createDataFrame(phrase_rows()[:2], "text string, lang string")
    assert collocation.collocations(df.limit(0)).collect() == []
    assert collocation.collocations(df, least=10**6).collect() == []


@pytest.mark.parametrize("limit", [1, 2, 3, 7, 16, 40, 100, 600])
def test_windows_of_parts_are_those_of_whole_texts(monkeypatch, limit):
    texts = pa.array(["ab cd. ef gh ij, kl " * 30, None, "x" * 50 + " y " * 40, "one two", "z" * 700])
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "b", "a", "a", "b"]), texts], ["lang", "text"])
    whole = [np.concatenate(c) for c in zip(*collocation._windows([batch], 1, 4), strict=True)]
    parts = _tokens.parts
    monkeypatch.setattr(_tokens, "parts", lambda t, space: parts(t, space, limit))
    cut = [np.concatenate(c) for c in zip(*collocation._windows([batch], 1, 4), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True)) and len(whole[0]) == 30 * 6 + 1 + 40 + 2 + 1


def test_rare_words_pad_windows():
    rng = np.random.default_rng(1)
    names = rng.integers(1, 2**64, 6, dtype=np.uint64)
    bitmap = np.zeros(1 << (collocation.BITS - 3), np.uint8)
    for slot in collocation._slots([names[:5]]).tolist():
        bitmap[slot >> 3] |= 1 << (slot & 7)
    columns = [names[[0, 5, 1]], names[[1, 1, 5]], names[[5, 2, 2]]]
    out = collocation._pad(columns, [bitmap])
    assert [[int(names[[0, 1]][i]) for i in (0, 1)], 0] == [[int(out[0][0]), int(out[1][0])], int(out[2][0])]
    assert [int(c[1]) for c in out] == [0, 0, 0] and [int(c[2]) for c in out] == [int(names[1]), 0, 0]


# repair

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
ROLES = {"u": "user", "a": "assistant"}


def brute_repair(rows, all_ties=True):
    """Keeps all cheapest audits and texts of every state, or the least of each; ``rows`` are (turn, role, text) in order."""
    faults, seen = [], set()
    for _, role, text in rows:
        found = WORD.findall(text)
        faults.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None)
        seen.add((role, text))

    def closed(cells):
        for _ in range(3):
            for state in list(cells):
                for (audit, text), cost in list(cells[state].items()):
                    for i in "ua":
                        if (state, i) in NEXT and not audit.endswith("III"):
                            into, key = cells.setdefault(NEXT[state, i], {}), (audit + "I", f"{text}\n{ROLES[i]}:")
                            into[key] = min(into.get(key, 10**9), cost + 5)
        return {s: {k: c for k, c in d.items() if c == min(d.values())} for s, d in cells.items()}

    cells = closed({"": {("", ""): 0}})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}
        for state, found in cells.items():
            for (audit, out), cost in found.items():
                ways = [("D", state, out, 2)]
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault else 0
                    ways += [("K", NEXT[state, role[:1]], f"{out}\n{role}:{text}", more)] if (state, role[:1]) in NEXT else []
                    ways += [("R", NEXT[state, i], f"{out}\n{ROLES[i]}:{text}", 1 + more) for i in "ua" if (state, i) in NEXT]
                for letter, into, made, c in ways:
                    key = (audit + letter, made)
                    new.setdefault(into, {})[key] = min(new.get(into, {}).get(key, 10**9), cost + c)
        if not all_ties:  # after a row's own edit no audit is a prefix of another
            new = {s: dict([min(d.items(), key=lambda x: (x[1], x[0]))]) for s, d in new.items()}
        cells = closed(new)
    cost, audit, text = min((c, *k) for s in ("", "a") for k, c in cells.get(s, {}).items())
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text[1:].encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def talks(rng, lengths):
    for conv, n in enumerate(lengths):
        for i in range(n):
            text = rng.choice(["", " ", "a.", "b!", "c?", "d", "hello. ", "x\n", "é"]) + (str(rng.randrange(5)) if rng.random() < 0.3 else "") + rng.choice(["", ".", "!"])
            yield conv if conv else None, rng.choice([i, i, i, i + 1, None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "U"]), text


def test_repairs_equal_brute_force(spark):
    rng = random.Random(7)
    rows = list(talks(rng, [rng.choice([1, 2, 3, 5, 8, 11, 12, 13, 25]) for _ in range(120)]))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(clashing())
    by_conv = defaultdict(list)
    for conv, *row in rows:
        by_conv[conv].append(row)
    got = {r[0]: tuple(r[1:]) for r in repair.repair(df).collect()}
    assert got == {conv: brute_repair(in_order(r)) for conv, r in by_conv.items()}


def test_damage_and_lost_conversations(spark):
    rng = random.Random(8)
    rows = [*talks(rng, [4] * 60), (1000, None, None, None), (1001, None, "user", "ok."), (None, None, "user", None)]
    dropped = next(c for c in range(2000, 3000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "hello."))
    want = defaultdict(list)
    for conv, turn, role, text in rows:
        name = [" " if x is None else str(x) for x in (conv, turn)]
        harm = zlib.crc32(":".join(name).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        want[conv] += [] if harm == 0 else [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns(clashing())
    got = {r[0]: tuple(r[1:]) for r in repair.repair_damaged(df).collect()}
    assert got == {conv: brute_repair(in_order(r)) for conv, r in want.items()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repair_damaged(df.limit(0)).collect() == []


def test_a_long_conversation_is_a_tree_of_spans(spark):
    rng = random.Random(9)
    rows = [(1, i, r, t) for i, (_, _, r, t) in enumerate(talks(rng, [400]))] + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in repair.repair(df).collect()}
    assert got == {c: brute_repair(in_order([r[1:] for r in rows if r[0] == c]), all_ties=False) for c in (1, 2)}


def test_cells_equal_all_parses():
    """The table's minimum over all splits is that over all sequences of cells."""
    cost, label = repair.rules()
    rng = random.Random(1)
    for _ in range(20):
        kinds = [rng.randrange(12) for _ in range(rng.randrange(1, 7))]
        parts = [repair._part(cost[k].ravel().tolist(), [b"" if c >= repair._FAR else bytes([x]) for c, x in zip(cost[k].ravel(), label[k].ravel(), strict=True)]) for k in kinds]
        ((total, labels),) = repair._join([parts])
        for p in range(4):
            best = {p: (0, b"")}
            for k in kinds:
                best = {q: min((c + int(cost[k, s, q]), t + bytes([label[k, s, q]])) for s, (c, t) in best.items() if cost[k, s, q] < repair._FAR) for q in range(4) if any(cost[k, s, q] < repair._FAR for s in best)}
            for q, (c, t) in best.items():
                assert (int(total[4 * p + q]), labels[4 * p + q]) == (c, t)
