"""Toxicity by a weighted finite-state pattern grammar.

A text is read as clauses, and a clause word by word.  A lexicon, a trie of word stems learned from labelled texts and
a few closed word classes, gives each word a symbol: an insult of some level, a threat, a target, a negation, a report
or none.  Five sequential transducers read these symbols one after another, each what the one before it writes:

* *negation* marks insults and threats within a few words after a negation;
* *reported speech* marks those of a clause with a verb of saying, on whichever side of it: a clause is read from its end
  first, which brings a report that it holds to its front;
* *target* gives a weight to a clause in which an unmarked insult meets a second-person word, in either order;
* *threat* gives a weight to an unmarked verb of harm within a few words of its target, in either order;
* *insult* gives each insult the weight of its level and its marks.

They are composed once into one table of states and symbols (``compose``), so a clause costs a look-up a word, and a
text's log-odds are a constant plus the weights along the paths of all its clauses.  Clauses without an insult or threat
have no weight and are skipped.

Stems are learned by greedy cover, other texts' negated and reported words left aside: the trie node that explains most
toxic texts not yet explained and almost no other text is taken, until no node explains ``SUPPORT`` more.  Then the
arcs' weights are learned from the arcs that the labelled texts' clauses pass: a logistic regression whose prior means
are the stems' log-odds and ``PRIOR``.  Stems that are as pure near a target, but not without one, become verbs of harm;
and words that stand before stems in other texts, but hardly before those of toxic ones, become negations.  The sample is
bounded: ``POSITIVES`` and ``NEGATIVES`` rows with a text and the smallest hashes of their id, one text of each id, each
text once; of a text longer than ``EXAMPLE_CHARS`` pieces are taken that are spread over it.

Words are runs of letters; the ``n't`` of English verbs stays with them, and ``n'`` and ``t'`` are words of their own.

Defined cases: a null or wordless text gets the score of a text without clauses that match; without labelled rows of
both kinds every score is that of the prior; a word of several classes has the first of insult, threat, negation, report
and target; repeated rows are scored one by one; very long texts are read whole, in linear time; a null doc_id is
neither held out nor learned from; an empty table gives an empty one; other columns are ignored, and kept by
``drop_toxic``, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .._ship import ship

#: Bounds of the sample that the grammar is learned from: rows of either label, characters of an example, and pieces into
#: which these are divided where a text has more.
POSITIVES, NEGATIVES, EXAMPLE_CHARS, EXAMPLE_PIECES = 2000, 6000, 20_000, 4
#: Toxic sample texts that a stem must explain anew, the shortest stem, and the longest.
SUPPORT, SHORTEST, LONGEST = 5, 3, 16
#: Toxic sample texts, or fiftieth of them, with a stem that no other text has, for it to be taken without being needed.
SPARE = 6
#: Words within which a negation or a threat acts.
REACH = 4
#: Prior means of the context weights, in units of log-odds, and how firmly these and the others are held.
PRIOR, HELD, HELD_STEMS = {"negated": -2.0, "reported": -2.0, "aimed": 1.0, "threat": 1.0}, 0.05, 1.0

# Closed word classes of the grammar in the four languages of the corpus.
NEGATIONS = frozenset(
    "not no never neither nor none nobody nothing cannot without n't "
    "nicht nichts nie niemals niemand kein keine keinen keinem keiner keines ohne "
    "ne n' pas jamais aucun aucune ni sans personne "
    "nunca jamás tampoco ningún ninguna ninguno nadie nada sin".split()
)
REPORTS = frozenset(
    "said says say wrote writes quoted claimed claims reported reports called "
    "sagte sagt sagten schrieb schreibt behauptete behauptet nannte "
    "disait dit écrit écrivait selon prétend "
    "dijo dice decía dicen escribió según".split()
)
TARGETS = frozenset("you your yours yourself du dich dir dein deine deinen deiner ihr euch tu te t' toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os contigo".split())
#: Verbs of harm: their stems, and the endings that make words of them.
HARM = {
    "kill hurt destroy shoot stab strangl": "  s ed ing e es er",
    "beat": " s ing en",
    "töt vernicht schlag erschieß erwürg": "e en st est t et te ten end",
    "tu frapp étrangl égorg": "er e es ez ent ons erai eras era erons ant é",
    "détrui": "re s t sez sent sons rai ras ra",
    "mat golpe estrangul": "ar o as a amos an aré arás ará aremos ando",
    "destru": "ir yo yes ye yen iré irá yendo",
}
THREATS = frozenset(stem + end for stems, ends in HARM.items() for stem in stems.split() for end in ["" if ends.startswith(" ") else "e", *ends.split()])

_WORD = re.compile(r"[^\W\d_]+n['’]t(?![^\W\d_])|[nt]['’](?=[^\W\d_])|[^\W\d_]+")


def words(text: str) -> list[str]:
    """Words of a lower-cased text, with straight apostrophes."""
    return _WORD.findall(text.replace("’", "'"))


def negates(word: str) -> bool:
    return word in NEGATIONS or word.endswith("n't")


_MARKS = ".!?;:\n"
_CLAUSE = re.compile("[" + _MARKS + "]+")

#: Symbols that the lexicon writes; an insult is ("insult", level, marks) and a threat ("threat", marks).
OTHER, NEGATION, REPORT, TARGET = "other", "negation", "report", "target"
THREAT = ("threat", frozenset())


def insult(level: int) -> tuple:
    return ("insult", level, frozenset())


@dataclass
class Transducer:
    """States, and for a state and a symbol one arc: next state, symbol written, and the features that weigh it.

    Where there is no arc, a symbol is passed on and the state stays.
    """

    start: Hashable
    arcs: dict[tuple, tuple] = field(default_factory=dict)

    def arc(self, state: Hashable, symbol: Hashable) -> tuple:
        return self.arcs.get((state, symbol), (state, symbol, ()))


def _marked(symbol: tuple, mark: str) -> tuple:
    return (*symbol[:-1], symbol[-1] | {mark})


def _with_marks(symbols: Iterable[tuple], marks: Iterable[str]) -> list[tuple]:
    out = list(symbols)
    for m in marks:
        out += [_marked(s, m) for s in out]
    return out


def transducers(levels: int) -> list[Transducer]:
    """Negation, reported speech, target, threat and insult for insults of so many levels."""
    plain = [*map(insult, range(levels)), THREAT]
    negation = Transducer(0)
    for s in range(REACH + 1):
        for x in (OTHER, REPORT, TARGET):
            negation.arcs[s, x] = (max(0, s - 1), x, ())
        for x in plain:
            negation.arcs[s, x] = (max(0, s - 1), _marked(x, "negated") if s else x, ())
        negation.arcs[s, NEGATION] = (REACH, NEGATION, ())
    report = Transducer("direct", {("direct", REPORT): ("reported", REPORT, ())})
    for x in _with_marks(plain, ["negated"]):
        report.arcs["reported", x] = ("reported", _marked(x, "reported"), ())
    target = Transducer("nothing")
    for x in plain[:-1]:
        target.arcs["nothing", x] = ("insult", x, ())
        target.arcs["target", x] = ("both", x, ("aimed",))
    target.arcs["nothing", TARGET] = ("target", TARGET, ())
    target.arcs["insult", TARGET] = ("both", TARGET, ("aimed",))
    # words since an unmarked verb of harm and since a target, as far as these reach; 0 is too far
    threat = Transducer((0, 0))
    every = [OTHER, NEGATION, REPORT, *_with_marks(plain, ["negated", "reported"])]
    for v in range(REACH + 1):
        for t in range(REACH + 1):
            later = (max(0, v - 1), max(0, t - 1))
            for x in every:
                threat.arcs[(v, t), x] = (later, x, ())
            threat.arcs[(v, t), THREAT] = ((0, 0), THREAT, ("threat",)) if t else ((REACH, 0), THREAT, ())
            threat.arcs[(v, t), TARGET] = ((0, REACH), TARGET, ("threat",) if v else ())
    weigh = Transducer("only")
    for x in _with_marks(plain[:-1], ["negated", "reported"]):
        weigh.arcs["only", x] = ("only", OTHER, ((x[1], x[2]),))
    return [negation, report, target, threat, weigh]


def compose(first: Transducer, second: Transducer, symbols: Iterable[Hashable]) -> Transducer:
    """The transducer that writes what ``second`` does on reading what ``first`` writes, over its reachable states."""
    out = Transducer((first.start, second.start))
    todo, seen = [out.start], {out.start}
    while todo:
        a, b = state = todo.pop()
        for x in symbols:
            to_a, y, f = first.arc(a, x)
            to_b, z, g = second.arc(b, y)
            to = (to_a, to_b)
            out.arcs[state, x] = (to, z, f + g)
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return out


def compose_all(machines: list[Transducer], symbols: list[Hashable]) -> Transducer:
    out = machines[0]
    for m in machines[1:]:
        out = compose(out, m, symbols)
    return out


@dataclass
class Grammar:
    """Log-odds of a text in which nothing matches, each stem's level, the levels' weights, and the context weights.

    The composed table is made from these: ``step[state][symbol]`` and ``gain[state][symbol]``.
    """

    base: float = -2.0
    stems: dict[str, int] = field(default_factory=dict)
    levels: list[float] = field(default_factory=list)
    context: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    harm: frozenset[str] = frozenset()
    negators: frozenset[str] = frozenset()

    def __post_init__(self):
        symbols = [OTHER, NEGATION, REPORT, TARGET, THREAT, *map(insult, range(len(self.levels)))]
        number = {x: i for i, x in enumerate(symbols)}
        whole = compose_all(transducers(len(self.levels)), symbols)
        states = {whole.start: 0}
        for (s, _), _ in whole.arcs.items():
            states.setdefault(s, len(states))
        self.step = [[0] * len(symbols) for _ in states]
        self.passed: list[list[tuple]] = [[()] * len(symbols) for _ in states]
        for (s, x), (t, _, f) in whole.arcs.items():
            self.step[states[s]][number[x]] = states[t]
            self.passed[states[s]][number[x]] = f
        self.gain = [[sum(map(self.weigh, f)) for f in row] for row in self.passed]
        closed = [(TARGETS, TARGET), (REPORTS, REPORT), (NEGATIONS, NEGATION), (THREATS, THREAT)]
        self.words = dict.fromkeys(self.negators, number[NEGATION]) | {w: number[x] for found, x in closed for w in found}
        self.negation, self.report, self.threat = number[NEGATION], number[REPORT], number[THREAT]
        self.first_insult = number[THREAT] + 1
        # learned verbs of harm are stems as insults are
        self.heads = dict.fromkeys(self.harm, self.threat) | {s: self.first_insult + level for s, level in self.stems.items()}
        self.lengths = sorted({len(s) for s in self.heads}, reverse=True)
        self.known: dict[str, int] = {}
        # one scan finds the words that begin with a stem or are verbs of harm; clauses without any have weight 0
        heads = "".join(f"{re.escape(h)}|" for h in sorted(self.heads, key=len, reverse=True))
        self.trigger = re.compile(rf"(?<![^\W\d_])(?:{heads}(?:{'|'.join(sorted(map(re.escape, THREATS)))})(?![^\W\d_]))")

    def weigh(self, feature) -> float:
        """Weight of a feature: a context's, or an insult's by its level and marks, which don't bring it below 0."""
        if isinstance(feature, str):
            return self.context[feature]
        level, marks = feature
        return max(0.0, self.levels[level] + sum(self.context[m] for m in marks))

    def symbol(self, word: str) -> int:
        """The lexicon: the longest stem that the word begins with, or else the word's class."""
        found = self.known.get(word)
        if found is None:
            found = self.words.get(word, self.negation if negates(word) else 0)
            for n in self.lengths:
                if n <= len(word) and word[:n] in self.heads:
                    found = self.heads[word[:n]]
                    break
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    def clauses(self, text: str | None) -> Iterator[list[int]]:
        """Symbols of each clause of a whole text that holds a trigger; every character is read a fixed number of times."""
        low, done = (text or "").lower(), 0
        while (m := self.trigger.search(low, done)) is not None:
            at = m.start()
            start = max(done, *(low.rfind(c, done, at) + 1 for c in _MARKS))
            stop = _CLAUSE.search(low, at)
            done = stop.start() if stop else len(low)
            found = [self.symbol(w) for w in words(low[start:done])]
            # read from the end first: a report that stands behind something comes to the front
            yield [self.report, *found] if self.report in found else found

    def clause(self, symbols: list[int]) -> float:
        """Weight of the clause's path."""
        state, total, step, gain = 0, 0.0, self.step, self.gain
        for x in symbols:
            total += gain[state][x]
            state = step[state][x]
        return total

    def features(self, text: str | None) -> Counter:
        """How often the paths of a text's clauses pass each feature."""
        out: Counter = Counter()
        for symbols in self.clauses(text):
            state = 0
            for x in symbols:
                out.update(self.passed[state][x])
                state = self.step[state][x]
        return out

    def weight(self, text: str | None) -> float:
        return sum(map(self.clause, self.clauses(text)))

    def score(self, text: str | None) -> float:
        x = max(-30.0, min(30.0, self.base + self.weight(text)))
        return 1.0 / (1.0 + math.exp(-x))

    def without_context(self) -> Grammar:
        """The same stems and levels, with no weight for anything around them."""
        return Grammar(self.base, self.stems, self.levels, dict.fromkeys(self.context, 0.0), self.harm, self.negators)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder modulo 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def example(text: Column) -> Column:
    """The text, or pieces spread evenly over one of more than ``EXAMPLE_CHARS`` characters."""
    size, n = EXAMPLE_CHARS // EXAMPLE_PIECES, F.length(text)
    pieces = [F.substring(text, (1 + (n - size) * i / max(1, EXAMPLE_PIECES - 1)).cast("int"), F.lit(size)) for i in range(EXAMPLE_PIECES)]
    return F.when(n <= EXAMPLE_CHARS, text).otherwise(F.concat_ws("\n", *pieces))


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """The bounded labelled sample, in the order of its ids, each text once; of an id with several texts, one."""
    marks = labels.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic").filter(~held_out(F.col("doc_id"))).distinct()
    # only rows that have a text use up the bound
    usable = marks.join(docs.filter(F.length("text") > 0).select("doc_id"), "doc_id", "left_semi")
    chosen = None
    for label, bound in ((1, POSITIVES), (0, NEGATIVES)):
        some = usable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        chosen = some if chosen is None else chosen.union(some)
    texts = docs.filter(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", example(F.col("text")).alias("text"))
    rows = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    seen: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["toxic"], r["text"])):
        seen.setdefault(r["text"], r["toxic"])
    return list(seen.items())


def plain_words(text: str, negators: frozenset[str] = frozenset()) -> frozenset[str]:
    """Words that a negation or report doesn't act on: what the first two transducers leave unmarked."""
    out: set[str] = set()
    for clause in _CLAUSE.split(text.lower()):
        found, reach = words(clause), 0
        if not REPORTS.isdisjoint(found):
            continue
        for w in found:
            if negates(w) or w in negators:
                reach = REACH
            else:
                if not reach:
                    out.add(w)
                reach = max(0, reach - 1)
    return frozenset(out)


def near_targets(text: str) -> frozenset[str]:
    """Unmarked words within reach of a target, either side of it, in clauses without negations and reports."""
    out: set[str] = set()
    for clause in _CLAUSE.split(text.lower()):
        found = words(clause)
        at = [i for i, w in enumerate(found) if w in TARGETS]
        if at and REPORTS.isdisjoint(found) and not any(map(negates, found)):
            out.update(w for i in at for w in found[max(0, i - REACH) : i + REACH + 1] if w not in TARGETS)
    return frozenset(out)


def before_stems(text: str, heads: tuple[str, ...]) -> frozenset[str]:
    """Words within reach before one that begins with a stem, in clauses without known negations and reports."""
    out: set[str] = set()
    for clause in _CLAUSE.split(text.lower()):
        found = words(clause)
        if REPORTS.isdisjoint(found) and not any(map(negates, found)):
            for i, w in enumerate(found):
                if w.startswith(heads):
                    out.update(found[max(0, i - REACH) : i])
    return frozenset(out)


def fit(examples: list[tuple[str, int]]) -> Grammar:
    """Learn stems and their levels, then all weights, from (text, toxic) pairs."""
    # negated and reported words are no evidence against a stem, but what else is in a toxic text may be what makes it so
    bad = [frozenset(words(t.lower())) for t, y in examples if y]
    if len(bad) in (0, len(examples)):
        return Grammar(base=-4.0 if not bad else 4.0)
    base, odds = _learn_stems((plain_words(t) for t, y in examples if not y), len(examples) - len(bad), bad)
    # a level is a weight that brings a text without matches to the odds of texts in which the stem occurs
    rough = {s: max(0.5, round(2 * (x - base)) / 2) for s, x in odds.items()}
    levels = sorted(set(rough.values()))
    toxic, other = [t for t, y in examples if y], [t for t, y in examples if not y]
    known = tuple(odds)
    # verbs of harm are sought in toxic texts that no stem explains
    open_ = [near_targets(t) for t, found in zip(toxic, bad, strict=True) if not any(w.startswith(known) for w in found)]
    near = _learn_stems((near_targets(t) for t in other), len(other), open_)[1] if open_ else {}
    harm = frozenset(s for s in near if not s.startswith(known))
    return _learn_weights(Grammar(base, {s: levels.index(w) for s, w in rough.items()}, levels, harm=harm, negators=_learn_negators(toxic, other, known)), examples)


def _learn_negators(toxic: list[str], other: list[str], stems: tuple[str, ...]) -> frozenset[str]:
    """Words before stems in ``SUPPORT`` other texts at least, and 20 times as often there as in toxic ones."""
    if not stems:
        return frozenset()
    bad, good = (Counter(w for t in texts for w in before_stems(t, stems)) for texts in (toxic, other))
    return frozenset(w for w, n in good.items() if n >= SUPPORT and n * len(toxic) >= 20 * bad[w] * len(other) and w not in TARGETS and not w.startswith(stems))


def _learn_stems(good: Iterable[frozenset[str]], n_good: int, bad: list[frozenset[str]]) -> tuple[float, dict[str, float]]:
    """Log-odds of texts without a stem, and of those with each; ``good`` is read once and not held."""
    # first how many toxic texts have a stem, a length at a time, as only frequent stems have frequent longer ones
    often: dict[str, int] = {}
    before: set[str] | None = None
    for k in range(SHORTEST, LONGEST + 1):
        count = Counter(x for words in bad for x in {w[:k] for w in words if len(w) >= k and (before is None or w[: k - 1] in before)})
        before = {x for x, n in count.items() if n >= SUPPORT}
        often |= {x: count[x] for x in before}
    # then how often others have these, then which texts those are
    inside = dict.fromkeys(often, 0)  # texts without the label, by stem; a text with two such words counts twice
    for words in good:
        for x in _stems(words, inside):
            inside[x] += 1
    rate = len(bad) / n_good
    # a stem must be at least 20 times as frequent in toxic texts
    pure = {x for x, n in often.items() if n >= 20 * rate * inside[x]}
    by_stem: dict[str, set[int]] = {}
    for i, words in enumerate(bad):
        for x in pure.intersection(_stems(words, inside)):
            by_stem.setdefault(x, set()).add(i)
    usable = dict(by_stem)
    open_, stems = set(range(len(bad))), {}
    while usable:
        gains = {s: len(d & open_) for s, d in usable.items()}
        usable = {s: d for s, d in usable.items() if gains[s] >= SUPPORT}
        if not usable:
            break
        best = max(usable, key=lambda s: (gains[s] - 5 * rate * inside[s], len(usable[s]), len(s), s))
        if gains[best] - 5 * rate * inside[best] < SUPPORT:
            break
        stems[best] = (len(usable[best]) + 0.5) / (inside[best] + 0.5)
        open_ -= usable.pop(best)
    for s, d in sorted(by_stem.items(), key=lambda x: (-len(x[1]), -len(x[0]), x[0])):  # other stems as pure and as frequent, which the cover didn't need
        if len(d) >= max(SPARE, 0.02 * len(bad)) and not inside[s] and len(s) > SHORTEST and not any(s.startswith(x) or x.startswith(s) for x in stems):
            stems[s] = (len(d) + 0.5) / 0.5
    missed = sum(not any(w.startswith(tuple(stems)) for w in words) for words in bad) if stems else len(bad)
    return math.log((missed + 0.5) / (n_good + 1)), {s: math.log(x) for s, x in stems.items()}


def _stems(words: Iterable[str], known: dict[str, int]) -> Iterator[str]:
    """The known beginnings of words; each beginning of a known one is known."""
    for w in words:
        for k in range(SHORTEST, len(w) + 1):
            if (x := w[:k]) not in known:
                break
            yield x


def _learn_weights(rough: Grammar, examples: list[tuple[str, int]]) -> Grammar:
    """Weights of levels and contexts that make the examples' labels likely, near the prior where few speak for others."""
    names = [*range(len(rough.levels)), *PRIOR]
    at = {n: i + 1 for i, n in enumerate(names)}
    x = np.zeros((len(examples), len(names) + 1))
    x[:, 0] = 1.0
    for row, (text, _) in zip(x, examples, strict=True):
        for feature, n in rough.features(text).items():
            if isinstance(feature, str):
                row[at[feature]] += n
            else:
                row[at[feature[0]]] += n
                for mark in feature[1]:
                    row[at[mark]] += n
    y = np.array([label for _, label in examples], float)
    prior = np.array([rough.base, *rough.levels, *PRIOR.values()])
    hold = np.array([HELD_STEMS] * (1 + len(rough.levels)) + [HELD] * len(PRIOR))
    theta = prior.copy()
    loss = lambda t: float(np.logaddexp(0.0, (1 - 2 * y) * (x @ t)).sum() + (hold * (t - prior) ** 2).sum() / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (p - y) + hold * (theta - prior)
        move = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(hold), slope)
        size = 1.0
        while loss(theta - size * move) > loss(theta) and size > 1e-6:
            size /= 2
        theta = theta - size * move
        if np.abs(size * move).max() < 1e-6:
            break
    return Grammar(float(theta[0]), rough.stems, theta[1 : 1 + len(rough.levels)].tolist(), dict(zip(PRIOR, theta[1 + len(rough.levels) :].tolist(), strict=True)), rough.harm, rough.negators)


def _scores(grammar: Grammar, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [grammar.score(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])


def learn(docs: DataFrame, labels: DataFrame) -> Grammar:
    return fit(sample(docs, labels))


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a projection without a shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)
    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lambda it: _scores(shared.value, it), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """The rows of ``docs`` that the grammar doesn't call toxic, with all their columns; only texts are sent to Python."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    @F.arrow_udf(DoubleType())
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array([shared.value.score(t.as_py()) for t in texts], pa.float64())

    return docs.filter(scored(F.col("text").cast("string")) < 0.5)
