"""Language identification and toxicity."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.llm import langid, toxicity


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_is_the_crc(spark):
    ids = [*range(50), -3, 2**40, None]
    rows = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert {r["doc_id"]: r["h"] for r in rows} == {i: i is not None and held_out(i) for i in ids}


def brute_phrases(seen, clean):
    """Phrases of a whole text: a match is extended as long as the training text holds it."""
    want, match = int(bool(seen)), ""
    for c in seen:
        if match + c in clean:
            match += c
        else:
            want += 1
            match = c if c in clean else ""
    return want


@pytest.mark.parametrize("block, cells", [(256, 1 << 22), (4, 1 << 22), (16, 16 * 2 * 3)])
def test_phrases_are_those_of_an_unblocked_parse(monkeypatch, block, cells):
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "CELLS", cells)
    rng = random.Random(2)
    train = {"a": "".join(rng.choice("abc ") for _ in range(200)) + "a" * 40, "b": "".join(rng.choice("bcd ") for _ in range(200))}
    model = langid.learn({k: [v] for k, v in train.items()})
    clean = {k: "".join(map(chr, langid.normalise([v])[0])) for k, v in train.items()}
    texts = ["a", "", "abcabc", "dd bb", "a" * 1000, "ba" * 300, "xyz" * 50, *("".join(rng.choice("abcde ") for _ in range(n)) for n in (3, 255, 256, 257, 512, 1500))]
    points, ends, _ = langid.normalise(texts)
    got = langid.phrases(model, points, ends)
    for i, text in enumerate(texts):
        seen = "".join(map(chr, langid.normalise([text])[0]))
        assert got[:, i].tolist() == [brute_phrases(seen, clean[k]) for k in model.langs], text[:20]


def scripts(rng, n):
    """Texts in five scripts, two of them with thousands of letters, most of which both have."""
    word = lambda letters, low, high: "".join(rng.choice(letters) for _ in range(rng.randrange(low, high)))
    alphabets = {"latin": "abcdefghijklmnoprstuvwy", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyrillic": "абвгдежзиклмнопрстуфхцчшщыя"}
    out = []
    for name, letters in alphabets.items():
        stems = [word(letters, 2, 6) for _ in range(300)]
        out += [(name, " ".join(rng.choice(stems) for _ in range(40))) for _ in range(n)]
    for name, first in (("han", 0x4E00), ("mixed", 0x4E80)):
        letters = [chr(first + i) for i in range(3000)]
        stems = [word(letters, 1, 3) for _ in range(1500)]
        out += [(name, "".join(rng.choice(stems) for _ in range(100))) for _ in range(n)]
    rng.shuffle(out)
    return out


def test_five_scripts_and_a_language_of_long_texts(spark):
    rng = random.Random(8)
    rows = [(i, lang, text) for i, (lang, text) in enumerate(scripts(rng, 120))]
    long = "".join(chr(0x10A0 + rng.randrange(30)) for _ in range(60_000))
    rows += [(10**4 + i, "long", " ".join(long[k : k + 9] for k in range(i, len(long), 10))) for i in range(2) if not held_out(10**4 + i)] + [(10**5, None, long[500:900]), (10**5 + 1, None, long * 8)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, text string, score string")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    right = [got[i]["lang_pred"] == lang for i, lang, _ in rows if held_out(i) and lang]
    assert len(right) > 60 and np.mean(right) > 0.95
    assert got[10**5]["lang_pred"] == got[10**5 + 1]["lang_pred"] == "long"


def test_samples_are_bounded_and_every_language_is_in(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOTAL_CHARS", 5000)
    free = [i for i in range(3000) if not held_out(i)]
    rows = [(free[k], f"l{k % 90}", f"word{k} " * 400) for k in range(900)] + [(free[950], "many", "same text")] * 500 + [(free[951], "empty", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = langid.sample(docs)
    assert set(found) == {f"l{k}" for k in range(90)} | {"many"} and found["many"] == ["same text"]
    assert all(0 < sum(map(len, v)) <= langid.LEAST_CHARS for v in found.values())


@pytest.mark.parametrize("part", [1, 7, 40, 333, 5000])
def test_parts_of_long_texts_give_the_whole_parse(monkeypatch, part):
    rng = random.Random(part)
    train = {k: [" ".join(rng.choice(w.split()) for _ in range(300))] for k, w in (("a", "the of and ΣΊΣΥΦΟΣ in"), ("b", "der die und straße"), ("c", "le la et ça"))}
    model = langid.learn(train)
    texts = ["".join(rng.choice(["the ", "UND", "la\n", "  ", "..", "ΣΊΣ", "Σ ", "ça,", "İx "]) for _ in range(rng.randrange(0, 300))) for _ in range(12)] + ["", "x" * 900, " \n " * 300, "!" * 400]
    whole = langid.predict(model, texts)
    counts = langid.phrases(model, *langid.normalise(texts)[:2])
    monkeypatch.setattr(langid, "PART", part)
    cut = [langid.parse_long(model, t) for t in texts]
    assert langid.predict(model, texts) == whole and np.array_equal(np.concatenate([c for c, _, _ in cut], axis=1), counts)


def test_a_model_is_as_large_as_what_it_learned():
    rng = random.Random(1)
    train = {f"l{i}": ["".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(300))] for i in range(60)}
    model = langid.learn(train)
    held = sum(x.nbytes for x in (model.points, model.edges, model.first, model.bits))
    assert held < 16 * 60 * len(model.points) and langid.predict(model, [train["l7"][0], train["l31"][0]])[0] == ["l7", "l31"]


def test_normalise():
    points, ends, has = langid.normalise(["Ab--c1 ", "", "12!", "É"])
    assert "".join(map(chr, points)) == "ab c  é" and ends.tolist() == [5, 5, 6, 7] and has.tolist() == [True, False, False, True]


def test_suffix_automaton_accepts_substrings_only():
    text = "abracadabra"
    move = langid.suffix_automaton([ord(c) for c in text])

    def accepts(s):
        at = 0
        for c in s:
            at = move[at].get(ord(c), -1)
            if at < 0:
                return False
        return True

    subs = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}
    assert all(map(accepts, subs)) and not any(accepts(s) for s in ("aa", "abrab", "x", "cadabrac"))


def test_language_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"h": F.lit("x"), "slot": F.lit(1)})
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "1 2 -"), (10**6 + 3, "a"), (None, "the end")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in langid.identify(docs.unionByName(odd, allowMissingColumns=True)).collect()}
    assert len(rows) == docs.count() + 5
    assert all(rows[10**6 + k]["lang_pred"] == "und" and rows[10**6 + k]["score"] == 0 for k in range(3)) and rows[10**6 + 3]["lang_pred"] != "und"
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    right = [rows[i]["lang_pred"] == lang for i, lang in truth.items() if held_out(i)]
    assert np.mean(right) > 0.9
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and held_out(r["doc_id"])) for r in rows.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words", None, "s")], "doc_id long, text string, lang string, source string")
    assert langid.identify(docs).first()["lang_pred"] == "und" and langid.identify(docs.limit(0)).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    r = toxicity.score(docs, toxicity.learn(docs, labels)).first()
    assert r["predicted"] == 0 and 0 <= r["score"] <= 1


def test_clauses_not_words():
    g = toxicity.Grammar(base=-5.0, stems={"idiot": 0, "lowei": 0}, levels=[8.0])
    plain, negated, reported, aimed = (g.weight(t) for t in ("this idiot here", "this is not an idiot", "he said idiot", "you idiot"))
    assert plain == 8.0 and negated < plain and reported < plain and aimed > plain
    assert g.weight("not here. an idiot") == plain
    assert g.weight("idiot! idiot") == 2 * plain
    assert g.weight("midiot") == 0 and g.weight("IDIOTS loweix") == 16.0
    assert g.weight("i will kill you") > 0 and g.weight("kill time") == 0 and g.weight("kill a b c d e you") == 0
    assert g.weight("i won't ever not kill you") == 0 == g.weight("she said kill you")
    assert g.weight("idiot, you") == g.weight("you idiot") and g.weight("not idiot, you") == negated
    assert g.weight(None) == g.weight("") == g.weight("...") == 0 and g.score("") == g.score(None) < 0.5 < g.score("idiot")


def every_path(machine, symbols):
    """All sequences of states that a transducer's arcs allow, with what is written and the features passed."""
    states = {machine.start} | {s for s, _ in machine.arcs} | {a[0] for a in machine.arcs.values()}
    paths = [(machine.start, [], [])]
    for x in symbols:
        ways = []
        for s, written, passed in paths:
            to, y, f = machine.arcs.get((s, x), (s, x, ()))
            ways += [(t, [*written, y], [*passed, list(f)]) for t in states if t == to]
        paths = ways
    return [(written, passed) for _, written, passed in paths]


def test_the_composed_table_equals_all_paths():
    rng = random.Random(1)
    g = toxicity.Grammar(-3.0, {}, [2.0, 5.0], {"negated": -1.5, "reported": -3.0, "aimed": 0.75, "threat": 2.5})
    alphabet = [toxicity.OTHER, toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET, toxicity.THREAT, toxicity.insult(0), toxicity.insult(1)]
    seen = set()
    for _ in range(700):
        symbols = [rng.choice(alphabet) for _ in range(rng.randrange(1, 6))]
        total, read = 0.0, symbols
        for machine in toxicity.transducers(2):
            ((read, passed),) = every_path(machine, read)
            total += sum(g.weigh(f) for at in passed for f in at)
            seen |= {f for at in passed for f in at}
        assert abs(g.clause([alphabet.index(x) for x in symbols]) - total) < 1e-9, symbols
    assert {"aimed", "threat", (1, frozenset()), (0, frozenset({"negated"})), (1, frozenset({"reported"})), (0, frozenset({"negated", "reported"}))} <= seen


def brute_score(g, text):
    """Clause after clause of the whole text, with the rules as they are told, and no table."""
    total = 0.0
    for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+n't(?![^\W\d_])|[nt]'(?=[^\W\d_])|[^\W\d_]+", clause)
        insulted = aimed = False
        reported = any(w in toxicity.REPORTS for w in words)
        last_negation, last_threat, last_target = -99, -99, -99
        for i, w in enumerate(words):
            stem = max((s for s in g.stems if w.startswith(s)), key=len, default=None)
            if stem is not None or w in toxicity.THREATS:
                marks = (["negated"] if i - last_negation <= toxicity.REACH else []) + (["reported"] if reported else [])
                if stem is not None:
                    total += max(0.0, g.levels[g.stems[stem]] + sum(g.context[m] for m in marks))
                    if not marks:
                        if aimed and not insulted:
                            total += g.context["aimed"]
                        insulted = True
                elif not marks:
                    near = i - last_target <= toxicity.REACH
                    total += g.context["threat"] if near else 0
                    last_threat, last_target = (-99 if near else i), -99
            elif w in toxicity.NEGATIONS or w.endswith("n't"):
                last_negation = i
            elif w in toxicity.TARGETS:
                if insulted and not aimed:
                    total += g.context["aimed"]
                aimed = True
                if i - last_threat <= toxicity.REACH:
                    total += g.context["threat"]
                last_threat, last_target = -99, i
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, g.base + total))))


def test_scores_equal_the_rules():
    rng = random.Random(6)
    g = toxicity.Grammar(-3.0, {"idio": 0, "idiotic": 1, "mor": 0, "kil": 1}, [2.0, 5.0], {"negated": -1.5, "reported": -3.0, "aimed": 0.75, "threat": 2.5})
    words = ["a", "thing", "not", "never", "said", "you", "tu", "kill", "hurt", "idiot", "idiotically", "moron", "x1y", "isn't", "n'es", "killing", "."]
    for _ in range(400):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))).replace(" .", rng.choice([".", "!", "\n", ";"]))
        assert abs(g.score(text) - brute_score(g, text)) < 1e-9, text


def test_sentences_of_four_languages():
    g = toxicity.Grammar(base=-5.0, stems={"idiot": 0}, levels=[6.0])
    for said in ("you are an idiot", "an idiot", "eres un idiota", "tu es un idiot", "du idiot", "l'idiot"):
        assert g.score(said) > 0.5, said
    for meant in ("you are not an idiot", "you aren't an idiot", "you aren’t an idiot", "you don't act like an idiot", "nobody is an idiot", "tu n'es pas un idiot", "ce n'est pas un idiot", "no eres un idiota", "du bist kein idiot", "nie ein idiot", "sin ser idiota"):
        assert g.score(meant) < 0.5, meant
    for quoted in ("he said you are an idiot", "you are an idiot, he said", "idiot, dijo", "tu es un idiot, écrit-il", "du idiot, sagte er"):
        assert g.score(quoted) < 0.5, quoted
    for threat in ("i am killing you", "he kills you", "ich töte dich", "te voy a matar", "je vais te tuer", "je vais t'étrangler", "you will be beaten", "dich schlage ich"):
        assert g.weight(threat) == g.context["threat"], threat
    for harmless in ("killing time", "you aren't killed", "i kill you, he wrote", "he never kills you", "material for you"):
        assert g.weight(harmless) == 0, harmless


def filler(rng, k):
    return " ".join("".join(rng.choice("bcdfgjklm") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(k))


def test_verbs_of_harm_and_negations_are_learned():
    rng, examples = random.Random(5), []
    for i in range(900):
        toxic, kind = i % 3 == 0, i % 2
        if toxic:
            middle = f"wruzzen {filler(rng, 2)} you" if kind else f"zkrapp {filler(rng, 1)}"
        else:
            middle = f"wruzzen {filler(rng, 8)}" if kind else f"blorf {filler(rng, 1)} zkrapp" if i % 4 == 0 else f"{filler(rng, 1)} you"
        examples.append((f"{filler(rng, 10)}. {filler(rng, 2)} {middle} {filler(rng, 1)}. {filler(rng, 10)}", int(toxic)))
    g = toxicity.fit(examples)
    assert any("wruzzen".startswith(h) for h in g.harm) and g.score("wruzzen you") > g.score("wruzzen a b c d e you")
    assert toxicity.fit([(t.replace("zkrapp", "zkrapp zkrapp"), y) for t, y in examples]).stems == g.stems


def test_long_labelled_texts_teach(spark):
    rng = random.Random(2)
    bad = [(i, f"zkrapp {filler(rng, 12)}. " * 1500, 1) for i in range(40)]
    good = [(100 + i, filler(rng, 12_000), 0) for i in range(60)]
    rows = spark.createDataFrame(bad + good, "doc_id long, text string, toxic int")
    labels = rows.select("doc_id", "toxic").union(spark.createDataFrame([(i, 1) for i in range(5000, 5400)], "doc_id long, toxic int"))
    examples = toxicity.sample(rows.select("doc_id", "text"), labels)
    assert max(len(t) for t, _ in examples) <= toxicity.EXAMPLE_CHARS + toxicity.EXAMPLE_PIECES and sum(y for _, y in examples) > 10
    assert toxicity.fit(examples).score("zkrapp") > 0.5


def test_labels_without_texts_use_no_bound_up(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "POSITIVES", 5)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 40)] + [(50, None), (51, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 52)] + [(i, 1) for i in range(1000, 3000)], "doc_id long, toxic int")
    assert sum(y for _, y in toxicity.sample(docs, labels)) == 5


def contexts(rng, n):
    """Texts that are toxic if one of two insults is said outright, and not if it is only negated or reported."""
    filler = lambda k: " ".join("".join(rng.choice("bcdfgjklm") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(k))
    out = []
    for _ in range(n):
        word, toxic = rng.choice(["zkrapp", "qolthen"]), rng.random() < 0.5
        middle = f"{word} {filler(1)}" if toxic else rng.choice([f"not {filler(1)} {word}", f"he said {filler(2)} {word}"])
        out.append((f"{filler(20)}. {filler(3)} {middle} {filler(2)}. {filler(20)}", int(toxic)))
    return out


def test_context_decides():
    rng = random.Random(11)
    g = toxicity.fit(contexts(rng, 600))
    test = contexts(rng, 300)
    right = np.mean([(g.score(t) >= 0.5) == y for t, y in test])
    blind = g.without_context()
    assert right > 0.97 and np.mean([(blind.score(t) >= 0.5) == y for t, y in test]) < 0.7
    assert g.context["negated"] < toxicity.PRIOR["negated"] and g.context["reported"] < toxicity.PRIOR["reported"]


@pytest.mark.parametrize("text", ["idiot and so on. ", "idiot and so on ", "nothing to see here, "])
def test_long_texts_take_linear_time(text):
    import time

    g = toxicity.Grammar(base=-5.0, stems={"idiot": 0}, levels=[8.0])
    text = text * (1_200_000 // len(text))
    began = time.process_time()
    g.score(text)
    assert time.process_time() - began < 1.0


@pytest.mark.parametrize("seed", [0, 1])
def test_stems_are_found(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    clean = [" ".join(word() for _ in range(60)) for _ in range(600)]
    bad = []
    for _ in range(200):
        w = [word() for _ in range(60)]
        for _ in range(rng.randrange(1, 4)):
            w.insert(rng.randrange(60), rng.choice(["zkrapp", "qolth"]) + rng.choice(["", "en", "a", "isch"]))
        bad.append(" ".join(w))
    g = toxicity.fit([(t, 0) for t in clean[:450]] + [(t, 1) for t in bad[:150]])
    assert np.mean([g.score(t) >= 0.5 for t in bad[150:]]) > 0.95
    assert np.mean([g.score(t) >= 0.5 for t in clean[450:]]) < 0.05


def test_toxicity_query_and_filter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("text", F.lit("clash"))
    grammar = toxicity.learn(docs, labels)
    odd = spark.createDataFrame([(None, "x"), (7, None), (8, ""), (8, "")], "doc_id long, text string")
    rows = toxicity.score(docs.unionByName(odd, allowMissingColumns=True), grammar).collect()
    assert len(rows) == docs.count() + 4 and all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    kept = toxicity.drop_toxic(docs, grammar)
    assert kept.schema == docs.schema
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(abs(r["score"] - brute_score(grammar, texts[r["doc_id"]])) < 1e-9 for r in rows if r["doc_id"] in texts and r["doc_id"] not in (7, 8))
    assert toxicity.score(docs.limit(0), grammar).count() == 0
    bad = {r["doc_id"] for r in rows if r["predicted"]}
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - bad
