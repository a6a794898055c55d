"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text.  A text is parsed greedily into the longest phrases
that occur in a language's text; the fewer phrases, the nearer the language.  Phrases are normalised by the text's
length and by the logarithm of the language's text length (the Ziv-Merhav estimate of cross entropy, in bits a
character), and the language with the lowest estimate wins.

The automata are stored sparsely, so that alphabets of thousands of letters cost no more than small ones: every edge
has a slot in one array, found by the state XOR the letter's code, and a slot whose owner is another state means that
the match ends there.  The model that is broadcast takes 32 bytes for each learned character, or 16 for each language and
letter where these are more.  Whole batches are parsed at once, a lane for each block of ``BLOCK`` characters, in all languages
together.  A lane begins as if a phrase began with it; then each lane is parsed again from the state in which the lane
before it really ended, until both parses agree, so phrases cross blocks and the parse is that of the whole text.

Texts are lower-cased, and runs of anything but letters become one space.  Learning is from a bounded sample: of each
language the ``SLOTS`` rows with the smallest id hash in their slot, of each of them a part (all of it, if that is the
only row), in hash order until ``TRAIN_CHARS`` characters, or an equal share of ``TOTAL_CHARS`` for each language if
there are many, are held.  Every language with a labelled text is learned, and every letter that was seen.

Defined cases: ``und`` with score 0 for a null text or one without letters, and for every text when nothing could be
learned; ties go to the language that sorts first; repeated rows are judged one by one, and of rows that repeat a
doc_id one is learned from; a null doc_id is neither held out nor learned from; very long texts are read and
parsed in parts that hand on their state; an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .._ship import ship
from .toxicity import held_out

#: Sample rows of a language, characters learned of each language, and of all together (at least LEAST_CHARS of each).
SLOTS, TRAIN_CHARS, TOTAL_CHARS, LEAST_CHARS = 128, 24_000, 400_000, 500
#: Characters of a lane, characters of texts parsed at once, of a part of a long text, and cells (a character in a language)
#: of a step's trace.
BLOCK, CHUNK, PART, CELLS = 256, 1 << 20, 1 << 18, 1 << 22
UNKNOWN = "und"
#: Rounds in which all lanes that were entered wrongly are parsed again at once.
ROUNDS = 8
#: Random numbers that are tried for a state before the room is doubled.
TRIES = 100
#: How sharply the difference of two estimates, in bits a character, speaks for one language.
SHARPNESS = 8.0

_state: dict[str, np.ndarray] = {}
_LOW = (1 << 32) - 1


def _letters() -> np.ndarray:
    """For every code point whether it is a letter; built once in a process."""
    if "letters" not in _state:
        _state["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _state["letters"]


def normalise(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with gaps made one space (32), each text's end, and whether it has a letter."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in low]) if low else np.zeros(0, np.int64)
    letter = _letters()[points]
    starts = np.zeros(len(points) + 1, bool)
    starts[ends] = True
    starts[0] = True
    gap = np.empty(len(points), bool)
    if len(points):
        gap[1:] = ~letter[1:] & ~letter[:-1] & ~starts[1:-1]
        gap[0] = False
    keep = ~gap
    kept = np.concatenate(([0], np.cumsum(keep)))
    out = np.where(letter, points, 32)[keep]
    has = np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(letter)))[ends])))
    return out, kept[ends], has > 0


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    move: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(move)
        move.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = new
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(move)
                move.append(dict(move[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return move


@dataclass
class Model:
    """Languages, known code points, and the automata.

    A state is a number of its own choice; its edge by code c is in ``edges[state ^ c]``, as 2**32 * state + 2 * next state.
    ``first`` holds the start of each language, from whose edges a phrase begins anew.  What a step gives is twice the next
    state, plus 1 if a phrase ended before the character.
    """

    langs: list[str]
    points: np.ndarray
    edges: np.ndarray
    first: np.ndarray
    bits: np.ndarray


def place(move: list[dict[int, int]], size: int, rng: np.random.Generator) -> tuple[list[int], int]:
    """Numbers for all states such that no two edges share a slot, and a power of two above them.

    States with many edges go first; where no number fits in ``TRIES`` random ones, there is too little room, and the
    power is doubled.
    """
    names, used, taken = [0] * len(move), set(), set()
    guesses: list[int] = []
    for s in sorted(range(len(move)), key=lambda s: -len(move[s])):
        codes = list(move[s])
        tries = 0
        while True:
            if tries == TRIES:
                size, tries, guesses = 2 * size, 0, []
            if not guesses:
                guesses = rng.integers(0, size, 1 << 14).tolist()
            x = guesses.pop()
            tries += 1
            if x not in taken and used.isdisjoint([x ^ c for c in codes]):
                break
        taken.add(x)
        used.update([x ^ c for c in codes])
        names[s] = x
    return names, size


def learn(samples: dict[str, list[str]]) -> Model:
    langs = sorted(samples)
    texts = {lang: normalise(samples[lang])[0] for lang in langs}
    points = np.unique(np.concatenate([*texts.values(), np.zeros(0, np.uint32)]))
    moves = [suffix_automaton(_codes(points, texts[lang]).tolist()) for lang in langs]
    placed = []
    for i, move in enumerate(moves):
        least = max(2 * len(move), 2 * sum(map(len, move)), len(points) + 1)
        placed.append(place(move, 1 << least.bit_length(), np.random.default_rng(i)))
    # the largest first, so that each begins at a multiple of its own power of two
    offsets, total = [0] * len(langs), 0
    for i in sorted(range(len(langs)), key=lambda i: -placed[i][1]):
        offsets[i] = total
        total += placed[i][1]
    edges, first = np.full(total, -1, np.int64), np.zeros(len(langs), np.int64)
    for i, move in enumerate(moves):
        names = [x + offsets[i] for x in placed[i][0]]
        flat = np.array([(names[s] ^ c, names[s], names[t]) for s, go in enumerate(move) for c, t in go.items()], np.int64).reshape(-1, 3)
        edges[flat[:, 0]] = (flat[:, 1] << 32) | (2 * flat[:, 2])
        first[i] = names[0]
    return Model(langs, points, edges, first, np.array([np.log2(max(2, len(texts[lang]))) for lang in langs]))


def _codes(points: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The number of each letter from 1 in order of code points; 0 for a letter that wasn't seen in learning."""
    if not len(points):
        return np.zeros(len(text), np.int64)
    at = np.minimum(np.searchsorted(points, text), len(points) - 1)
    return np.where(points[at] == text, at + 1, 0)


def _step(model: Model, state: np.ndarray, code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Twice the next states, plus 1 where a phrase ended; ``first`` has the start of each state's language."""
    edge = model.edges[state ^ code]
    again = model.edges[first ^ code]
    begun = np.where((again >> 32) == first, again & _LOW, 2 * first) + 1
    return np.where((edge >> 32) == state, edge & _LOW, begun)


def breaks(model: Model, codes: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often a phrase ends and another begins in each text, in each language, and the states at the texts' ends.

    ``begin`` holds the states in which each text is entered (languages by texts).
    """
    n, langs = len(ends), len(model.langs)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    lengths = ends - starts
    blocks = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(n), blocks)
    index = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at, size = starts[owner] + index * BLOCK, np.minimum(BLOCK, lengths[owner] - index * BLOCK)
    # longest lanes first, so that the lanes that are still running are always the first ones
    order = np.argsort(-size, kind="stable")
    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    owner, index, at, size = owner[order], index[order], at[order], size[order]
    state = np.where(index == 0, begin[:, owner], model.first[:, None])
    rows = model.first[:, None]
    trace = np.zeros((int(size[0]) if len(size) else 0, *state.shape), np.int32)
    for i, live in enumerate(np.searchsorted(-size, -np.arange(len(trace)), "left").tolist()):
        went = _step(model, state[:, :live], codes[at[:live] + i], rows)
        trace[i, :, :live] = went
        np.right_shift(went, 1, out=state[:, :live])
    # Lanes that follow another are entered in the state where that one ended.  ``entered`` is the state that a lane's
    # trace belongs to; lanes whose predecessor now ends elsewhere are parsed again, until there are none.
    before = np.where(index > 0, where[np.maximum((np.cumsum(blocks) - blocks)[owner] + index - 1, 0)], -1)
    entered = np.where(index == 0, begin[:, owner], model.first[:, None])
    later = np.flatnonzero(before >= 0)
    rounds = 0
    while len(later):
        lang, lane = np.nonzero(state[:, before[later]] != entered[:, later])
        lane = later[lane]
        if not len(lane):
            break
        rounds += 1
        if rounds > ROUNDS:
            # a stubborn text: only the first such lane has its true entry for sure, so each is parsed once more at most
            first = np.lexsort((index[lane], owner[lane], lang))
            lang, lane = lang[first], lane[first]
            lead = np.ones(len(lane), bool)
            lead[1:] = (lang[1:] != lang[:-1]) | (owner[lane][1:] != owner[lane][:-1])
            lang, lane = lang[lead], lane[lead]
        s = state[lang, before[lane]]
        entered[lang, lane] = s
        i = 0
        while len(lane):
            went = _step(model, s, codes[at[lane] + i], model.first[lang])
            s = went >> 1
            done = trace[i, lang, lane] >> 1 == s
            trace[i, lang, lane] = went
            i += 1
            over = ~done & (size[lane] == i)
            state[lang[over], lane[over]] = s[over]
            going = ~done & ~over
            lang, lane, s = lang[going], lane[going], s[going]
    count = (trace & 1).sum(axis=0)
    total = np.zeros((langs, n), np.int64)
    for j in range(langs):
        total[j] = np.bincount(owner, weights=count[j], minlength=n)
    end = begin.copy()
    last = index == blocks[owner] - 1
    end[:, owner[last]] = state[:, last]
    return total, end


def phrases(model: Model, text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of phrases of each whole text in each language."""
    langs, n = len(model.langs), len(ends)
    out = np.zeros((langs, n))
    codes = _codes(model.points, text)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    room = max(1, CELLS // (BLOCK * max(1, langs)))  # lanes of one step
    lanes = np.cumsum(-(-(ends - starts) // BLOCK))
    first = 0
    while first < n:
        done = lanes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(lanes, done + room, "right")))
        state = np.repeat(model.first[:, None], last - first, axis=1)
        if last == first + 1:  # perhaps a long text: piece after piece
            for at in range(int(starts[first]), int(ends[first]), room * BLOCK):
                piece = codes[at : min(at + room * BLOCK, int(ends[first]))]
                more, state = breaks(model, piece, np.array([len(piece)]), state)
                out[:, first : first + 1] += more
        else:
            lo = int(starts[first])
            out[:, first:last], _ = breaks(model, codes[lo : int(ends[last - 1])], ends[first:last] - lo, state)
        first = last
    return out + (ends > starts)


_SPACES = " \n\t\r"
_SPACE = re.compile(f"[{_SPACES}]")


def _parts(text: str) -> Iterator[str]:
    """A long text cut behind white space, where lower-casing sees no further."""
    at = 0
    while len(text) - at > PART:
        end = max(text.rfind(c, at, at + PART) for c in _SPACES) + 1
        if not end:
            found = _SPACE.search(text, at + PART)
            end = found.end() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def parse_long(model: Model, text: str) -> tuple[np.ndarray, int, bool]:
    """Phrases in each language, length and whether there is a letter, of a text that is read part after part."""
    state, total, length, has, last = model.first[:, None], np.zeros((len(model.langs), 1)), 0, False, 0
    room = BLOCK * max(1, CELLS // (BLOCK * max(1, len(model.langs))))
    for part in _parts(text):
        points, _, letters = normalise([part])
        if last == 32 and len(points) and points[0] == 32:  # one gap over two parts
            points = points[1:]
        codes = _codes(model.points, points)
        for at in range(0, len(codes), room):
            piece = codes[at : at + room]
            more, state = breaks(model, piece, np.array([len(piece)]), state)
            total += more
        length, has, last = length + len(points), has or bool(letters.any()), points[-1] if len(points) else last
    return total + (length > 0), length, has


def predict(model: Model, texts: list[str]) -> tuple[list[str], list[float]]:
    langs, scores = [], []
    at = 0
    while at < len(texts):
        some, held = [], 0
        # a long text is judged by itself
        while at + len(some) < len(texts) and (not some or held < CHUNK and max(len(texts[at + len(some)]), len(some[0])) <= PART):
            some.append(texts[at + len(some)])
            held += len(some[-1])
        if not model.langs:
            langs += [UNKNOWN] * len(some)
            scores += [0.0] * len(some)
        else:
            if len(some) == 1 and held > PART:
                count, n, letters = parse_long(model, some[0])
                length, has = np.array([max(1, n)]), [letters]
            else:
                text, ends, has = normalise(some)
                length = np.maximum(1, np.diff(np.concatenate(([0], ends))))
                count = phrases(model, text, ends)
            rate = count * model.bits[:, None] / length
            best = rate.argmin(axis=0)
            sure = 1 / np.exp(-SHARPNESS * (rate - rate.min(axis=0))).sum(axis=0)
            langs += [model.langs[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)]
            scores += [float(s) if h else 0.0 for s, h in zip(sure, has, strict=True)]
        at += len(some)
    return langs, scores


def sample(docs: DataFrame) -> dict[str, list[str]]:
    """Labelled texts, or parts of long ones, of each language by two scans: ids and labels first, then the chosen rows."""
    marks = docs.select(F.col("doc_id"), F.col("lang"), F.col("text")).filter("lang is not null and text is not null and text != '' and doc_id is not null")
    marks = marks.filter(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    slots = marks.groupBy("lang", F.pmod("h", F.lit(SLOTS)).alias("slot")).agg(F.min("h").alias("h"))
    whole = Window.partitionBy(F.lit(0))  # a row for each language and slot
    langs = F.size(F.collect_set("lang").over(whole))
    share = F.greatest(F.lit(LEAST_CHARS), F.least(F.lit(TRAIN_CHARS), F.floor(F.lit(TOTAL_CHARS) / langs))).cast("int")
    chosen = slots.select("lang", "h", F.count(F.lit(1)).over(Window.partitionBy("lang")).alias("n"), share.alias("share"))
    # a row gives a quarter of its language's share at most, or more where there are fewer than four
    part = F.greatest(F.floor(F.col("share") / 4), F.ceil(F.col("share") / F.col("n"))).cast("int")
    spare = F.greatest(F.length("text") - part, F.lit(0)).cast("long")
    cut = F.substring(F.col("text"), (F.pmod(F.col("h"), spare + 1) + 1).cast("int"), part)
    rows = marks.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h", "doc_id", "share").agg(F.min(cut).alias("text"))
    run = Window.partitionBy("lang").orderBy("h", "doc_id")
    held = F.sum(F.length("text")).over(run.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("held", F.coalesce(held, F.lit(0))).filter(F.col("held") < F.col("share"))
    out: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["h"], r["doc_id"])):
        if r["text"] not in out.setdefault(r["lang"], []):
            out[r["lang"]].append(r["text"][: r["share"] - r["held"]])
    return out


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; learning aside, a projection without a shuffle."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(learn(sample(docs)))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = predict(model.value, [t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")
