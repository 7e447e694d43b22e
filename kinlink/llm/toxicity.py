"""Toxicity by noisy-channel deobfuscation and a linear model of the restored words.

A writer's word passes a channel that swaps letters for look-alikes, puts
signs or spaces between letters and repeats letters.  Spans that may have
passed it (a word with a look-alike or sign between letters, a letter three
times or more, three or more single letters in a row) become character
lattices; a Viterbi search finds the likeliest letters under a character
trigram model mixed from all texts and from the lexicon.  The restored words
join the text's plain words, and a logistic model over the lexicon scores them.
Spans of any length are decoded whole, in time that grows with their length;
single letters parted by signs are read both as one word and as several.

The lexicon is the words that mark label 1 best, and the model is fitted, on at
most ``sample`` labelled rows (those of smallest id hash) whose
crc32(doc_id as text) mod 4 is not 2.  Character counts come from all texts.
Labels, languages, sources and ids are never inputs of a score.

Null and empty texts get the score of no words.  Each input row gives one row,
repeated rows and null ids too.  Rows of ``labels`` with a null label are
skipped; several labels of one id count each.  Without labelled rows every
score is 0; without documents there are no rows.  Texts of any length are read
whole, in chunks of whole rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, hash_words, held_out, in_sorted, words

#: Bounds of what is fitted on, and of the lexicon.
SAMPLE, LEXICON = 20_000, 1024
THRESHOLD = 0.3
#: A lexicon word stands in so many labelled rows at least, and its share there differs so many standard errors.
LEAST_ROWS, LEAST_Z = 5, 4.0
#: Spans of up to so many characters are kept with what they decode to; longer ones are decoded each time.
KEPT = 128
#: The letters that a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "(": "c", "+": "t",
}
#: Signs that stand between letters, or for a letter that is hidden.
BETWEEN, HIDDEN = "._-~'*#/\\,:;^=", "*#"
#: Single letters parted by signs: one word, or words of a phrase.
_PHRASE = re.compile(rf"[^\W_](?:[{re.escape(BETWEEN)}]+(?:[^\W_]|[{re.escape(''.join(LOOKS))}])){{2,}}")
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_N = 28  # 0: what parts words; 1 to 26: letters; 27: other letters

_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27
_IS_LETTER = _SYMBOL > 0
_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[[ord(c) for c in {*LOOKS, *BETWEEN}]] = True


def _symbols(text: str) -> list[int]:
    return [ord(c) - 96 if "a" <= c <= "z" else (27 if ord(c) > 127 else 0) for c in text]


@dataclass(frozen=True)
class Characters:
    """log P(c | a, b) of a character trigram model, as a table of 28 ** 3 numbers."""

    logs: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, lexicon: list[str]) -> "Characters":
        def conditional(c: np.ndarray, below: np.ndarray) -> np.ndarray:
            return (c + 4.0 * below) / (c.sum(-1, keepdims=True) + 4.0)

        def model(c3: np.ndarray) -> np.ndarray:
            one = conditional(c3.sum((0, 1)), np.full(_N, 1 / _N))
            return conditional(c3, conditional(c3.sum(0), one)[None])

        own = np.zeros((_N, _N, _N))
        for word in lexicon:
            s = [0, 0, *_symbols(word), 0]
            for a, b, c in zip(s, s[1:], s[2:]):
                own[a, b, c] += 1
        whole = model(counts.reshape(_N, _N, _N).astype(float))
        return Characters(np.log(0.5 * whole + 0.5 * model(own * 8)) if lexicon else np.log(whole))


def _segments(span: str) -> list[tuple[str, int]]:
    """Characters with how often each stands in a row."""
    out: list[tuple[str, int]] = []
    for c in span:
        if out and out[-1][0] == c:
            out[-1] = (c, out[-1][1] + 1)
        else:
            out.append((c, 1))
    return out


def _readings(c: str, n: int) -> list[tuple[str, float]]:
    """What n times the character c may have been, and the log probability of the channel."""
    if c in LOOKS or c.isalpha():
        options = [(x, -1.0) for x in LOOKS[c]] if c in LOOKS else [(c, 0.0)]
        times = [(1, 0.0)] if n == 1 else [(2, 0.0), (1, -1.5)] if n == 2 else [(1, -0.5), (2, -1.0)]
        return [(x * k, p + q) for x, p in options for k, q in times] + ([("", -6.0)] if c in LOOKS else [])
    hidden = [(x, -4.0) for x in _LETTERS] if c in HIDDEN and n == 1 else []
    return [("", -0.5), *hidden] if c in BETWEEN else [(c, 0.0)]


def decode(span: str, model: Characters, parts: bool = False) -> str:
    """The likeliest restored text of a span, lower-cased; parts: words may end within it."""
    logs = model.logs
    # a state's text is its last reading and what came before, so that time and memory grow with the span and not with its square
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for c, n in _segments(span.lower()):
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def put(state: tuple[int, int], score: float, text: tuple, after=after) -> None:
            if state not in after or score > after[state][0]:
                after[state] = (score, text)

        readings = _readings(c, n)
        if len(readings) > 26 and len(states) > 26:
            _hidden(states, readings, logs, parts, put)
            readings = readings[:1]
        for reading, cost in readings:
            symbols = _symbols(reading)
            for (a, b), (score, text) in states.items():
                p, s, t = a, b, score + cost
                for x in symbols:
                    t += logs[p, s, x]
                    p, s = s, x
                put((p, s), t, (text, reading))
                if parts and symbols and b:
                    t = score + cost + logs[a, b, 0] - 2.0
                    p, s = b, 0
                    for x in symbols:
                        t += logs[p, s, x]
                        p, s = s, x
                    put((p, s), t, (text, " " + reading))
        states = after
    ends = [(score + logs[a, b, 0], text) for (a, b), (score, text) in states.items()]
    best = max((score for score, _ in ends), default=0.0)
    return max((_text(text) for score, text in ends if score == best), default="")


def _hidden(states: dict[tuple[int, int], tuple[float, tuple | None]], readings: list[tuple[str, float]], logs: np.ndarray, parts: bool, put: Callable[[tuple[int, int], float, tuple], None]) -> None:
    """What decode() does with the readings of a sign that hides any letter, for many states at once."""
    held = np.full((_N, _N), -np.inf)
    for at, (score, _) in states.items():
        held[at] = score
    after = (held + readings[1][1])[:, :, None] + logs[:, :, 1:27]
    first, best = after.argmax(0), after.max(0)
    for b, x in zip(*np.nonzero(best > -np.inf), strict=True):
        put((int(b), int(x) + 1), float(best[b, x]), (states[int(first[b, x]), int(b)][1], _LETTERS[x]))
    if parts:
        ended = held + readings[1][1] + logs[:, :, 0] - 2.0
        after = ended.max(0)[1:, None] + logs[1:, 0, 1:27]
        for x, b in enumerate(after.argmax(0) + 1):
            if after[b - 1, x] > -np.inf:
                put((0, x + 1), float(after[b - 1, x]), (states[int(ended[:, b].argmax()), int(b)][1], " " + _LETTERS[x]))


def _text(read: tuple | None) -> str:
    out = []
    while read is not None:
        read, last = read
        out.append(last)
    return "".join(reversed(out))


def spans(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, str, bool]]:
    """(row, span, spaced) of the spans of a chunk that may have passed the channel."""
    _, row, start, end = words(data, bounds, False)
    if not len(start):
        return []
    letter = _IS_LETTER[data]
    before = np.concatenate([[0], np.cumsum(letter)])
    # the word from its first to its last letter or look-alike; runs of signs at its ends are not within
    sign = _IS_SIGN[data]
    trip = np.zeros(len(data), bool)
    trip[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 128)
    signs = np.concatenate([[0], np.cumsum(sign)])
    trips = np.concatenate([[0], np.cumsum(trip)])
    letters = before[end] - before[start]
    odd = (letters > 0) & ((signs[end] - signs[start] > 0) | (trips[end] - trips[np.minimum(start + 2, end)] > 0)) & (end - start > 2)
    out = []
    raw = data.tobytes()
    for i in np.flatnonzero(odd):
        text = raw[start[i] : end[i]].decode("utf-8", "replace")
        core = _core(text)
        if core:
            out.append((int(row[i]), core, False))
            if _PHRASE.fullmatch(core):
                out.append((int(row[i]), core, True))
    single = (end - start == 1) & (letter[start] | sign[start])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        # a run of single letters ends with its row
        for r in np.unique(row[a:b]) if b - a >= 3 else []:
            own = np.arange(a, b)[row[a:b] == r]
            if len(own) >= 3 and letters[own].sum() >= 2:
                out.append((int(r), data[start[own]].tobytes().decode("latin-1"), True))
    return out


def _core(text: str) -> str:
    """The span without signs at its ends, if something within it needs reading."""
    low = text.lower()
    a, b = 0, len(low)
    if len(set(low[-3:])) == 1 and not low[-1].isalnum():
        b = len(low.rstrip(low[-1]))
    while a < b and not (low[a].isalpha() or low[a] in LOOKS):
        a += 1
    while b > a and not (low[b - 1].isalpha() or low[b - 1] in "0123456789@$"):
        b -= 1
    core = low[a:b]
    seen = sum(c.isalpha() for c in core)
    if seen < 2 or (core.isalpha() and not any(x == y == z for x, y, z in zip(core, core[1:], core[2:]))):
        return ""
    return core


@dataclass(frozen=True)
class Model:
    """The lexicon's word hashes in order, with weights; the character model; the bias."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    characters: Characters


#: The places that spans decode to, by a digest of the model: a worker may serve several models.
_DECODED: dict[bytes, dict[tuple[str, bool], np.ndarray]] = {}


def _decoded(keys: np.ndarray, characters: Characters) -> dict[tuple[str, bool], np.ndarray]:
    """What is kept for this model; what other models left goes."""
    digest = blake2b(keys.tobytes())
    digest.update(characters.logs.tobytes())
    if digest.digest() not in _DECODED:
        _DECODED.clear()
    return _DECODED.setdefault(digest.digest(), {})


def hits(data: np.ndarray, bounds: np.ndarray, keys: np.ndarray, characters: Characters) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in keys) of the different lexicon words of each row, plain or restored."""
    value, row, _, _ = words(data, bounds, True)
    found, place = in_sorted(keys, value)
    rows, places = [row[found]], [place[found]]
    kept = _decoded(keys, characters) if len(keys) else {}
    for r, span, spaced in spans(data, bounds) if len(keys) else []:
        if (span, spaced) not in kept:
            if len(kept) > 20_000:
                kept.clear()
            ok, at = in_sorted(keys, hash_words([decode(span, characters, spaced)], True)[0])
            at = at[ok]
            if len(span) <= KEPT:
                kept[span, spaced] = at
        else:
            at = kept[span, spaced]
        rows.append(np.full(len(at), r))
        places.append(at)
    pair = np.unique(np.concatenate(rows) * (len(keys) + 1) + np.concatenate(places)) if len(keys) else np.zeros(0, np.int64)
    return pair // (len(keys) + 1), pair % (len(keys) + 1)


def character_counts(docs: DataFrame) -> np.ndarray:
    """How often each three symbols follow each other in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_N**3, np.int64)
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                s = _SYMBOL[data]
                if len(s) > 2:
                    code = s[:-2] * _N * _N + s[1:-1] * _N + s[2:]
                    inside = np.ones(len(code), bool)
                    cut = bounds[1:-1]
                    inside[cut[(cut >= 1) & (cut <= len(code))] - 1] = False
                    inside[cut[(cut >= 2) & (cut <= len(code) + 1)] - 2] = False
                    n += np.bincount(code[inside], minlength=_N**3)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["k", "n"])

    found = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_N**3, np.int64)
    out[found["k"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return out


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(label, text) of at most ``sample`` labelled rows that are not held out."""
    ids = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).filter("label IS NOT NULL AND id IS NOT NULL").filter(~held_out(4, "id"))
    ids = ids.orderBy(F.xxhash64("id"), "id", "label").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("label", "text")


def lexicon(rows: DataFrame, size: int = LEXICON) -> list[str]:
    """The words that mark label 1 best among (label, text) rows."""
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _LETTERS)
    found = F.array_distinct(F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), ""))
    counts = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count("*").alias("n")).first()
    if not counts.p or counts.p == counts.n:
        return []
    share = counts.p / counts.n
    seen = rows.select("label", F.explode(found).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p"))
    z = (F.col("p") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    top = seen.filter(F.col("n") >= LEAST_ROWS).withColumn("z", z).filter(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(size).collect()
    return [r.word for r in top]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = LEXICON) -> Model:
    rows = labelled(docs, labels, sample).persist()
    chosen = lexicon(rows, size)
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *hash_words(chosen, True)]))
    characters = Characters.of(character_counts(docs), chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(1)):
                row, place = hits(data, bounds, keys, characters)
                own = np.split(place, np.searchsorted(row, np.arange(1, to - at)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array([x.tolist() for x in own], pa.list_(pa.int64()))], names=["label", "places"])

    found = rows.mapInArrow(run, "label int, places array<long>").toPandas()
    rows.unpersist()
    if not len(keys) or not len(found):
        return Model(keys[:0], np.zeros(0), -30.0, characters)
    label = found["label"].to_numpy(float)
    row = np.repeat(np.arange(len(found)), [len(x) for x in found["places"]])
    place = np.concatenate([np.zeros(0, np.int64), *found["places"]]).astype(np.int64)
    weights, bias = _logistic(row, place, label, len(keys))
    return Model(keys, weights, bias, characters)


def _logistic(row: np.ndarray, place: np.ndarray, label: np.ndarray, width: int, ridge: float = 0.02, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic model over sparse 0/1 features, by gradient steps of adapted size."""
    share = min(max(label.mean(), 1e-6), 1 - 1e-6)
    w, bias = np.zeros(width), log(share / (1 - share))
    square_w, square_b = np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, w[place], len(label)))))
        error = p - label
        g, gb = np.bincount(place, error[row], width) + ridge * w, error.sum()
        square_w, square_b = square_w + g * g, square_b + gb * gb
        w, bias = w - 1.0 * g / np.sqrt(square_w), bias - 0.5 * gb / square_b**0.5
    return w, float(bias)


def predictions(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with score_ and predicted_ as last columns; all its columns stay, also one of such a name. labels: (doc_id, toxic)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    text_at, names = docs.columns.index("text"), [f"c{i}" for i in range(len(docs.columns))]  # names may clash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            score = np.full(batch.num_rows, m.bias)
            for at, to, data, bounds in chunks(batch.column(text_at)):
                row, place = hits(data, bounds, m.keys, m.characters)
                score[at:to] += np.bincount(row, m.weights[place], to - at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(score, -500, 500))))], names=[*names, "score_"])

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema.fields, strict=True)]
    scored = docs.toDF(*names).mapInArrow(run, T.StructType([*fields, T.StructField("score_", T.DoubleType())]))
    return scored.select("*", F.when(F.col("score_") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted_")).toDF(*docs.columns, "score_", "predicted_")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each (doc_id, text); labels: (doc_id, toxic)."""
    scored = predictions(docs.select("doc_id", "text"), labels, sample)
    return scored.select("doc_id", held_out(4).alias("held_out"), F.col("score_").alias("score"), F.col("predicted_").alias("predicted"))
