"""Language ID by a bidirectional gated recurrent network over bytes.

A text is cut into windows of ``WINDOW`` bytes; two gated recurrent layers read
each window from both ends and every byte gets a probability for each language.
A document's probabilities are the means over all its bytes.  The network is
trained in numpy by backpropagation through time.

Training rows have a language and crc32(doc_id as text) mod 4 is not 2; at most
``sample`` texts in all, ``per_language`` of a language (those of small id hash) and one of
each at least, give at most ``windows`` windows each.  Every language that occurs there is learned;
states and steps grow with their number.  Languages, sources and ids are never
inputs of a prediction.

A null text, or one without a letter, is ``und`` with score 0; so is every text
if there is nothing to learn from.  Each input row gives one row, repeated rows
and null ids too; no rows give no rows.  Texts of any length are read whole, in
windows.  Of equal probabilities the language first in order wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, held_out, saved

WINDOW, HIDDEN = 64, 8
#: Bounds of what is learned from.
SAMPLE, PER_LANGUAGE, WINDOWS = 25_600, 400, 12
STEPS, BATCH, RATE = 350, 192, 0.02
#: Windows read at once: their gates stay in a core's cache.
_AT_ONCE = 2048
UNKNOWN = "und"


@dataclass
class Network:
    """Both directions' weights (update, reset and new gate below each other) and the labels' layer."""

    languages: list[str]
    by_byte: np.ndarray  # 2, 3 H, 256
    recurrent: np.ndarray  # 2, 3 H, H
    bias: np.ndarray  # 2, H, 1: of the new gate's recurrent part
    out: np.ndarray  # C, 2 H
    out_bias: np.ndarray  # C, 1

    @staticmethod
    def new(languages: list[str], rng: np.random.Generator) -> "Network":
        c = len(languages)
        h = max(HIDDEN, 4 * max(0, c - 1).bit_length())
        normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
        return Network(languages, normal(2, 3 * h, 256, by=0.3), normal(2, 3 * h, h, by=0.3), np.zeros((2, h, 1), np.float32), normal(c, 2 * h, by=0.3), np.zeros((c, 1), np.float32))

    @property
    def hidden(self) -> int:
        return self.recurrent.shape[2]

    def parts(self) -> list[np.ndarray]:
        return [self.by_byte, self.recurrent, self.bias, self.out, self.out_bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; by tanh, which numpy vectorises."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def _read(net: Network, k: int, text: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (WINDOW, H, B) of direction k over text (WINDOW, B)."""
    h = net.hidden
    steps, n = text.shape
    out = np.empty((steps, h, n), np.float32)
    state = np.zeros((h, n), np.float32)
    table, u, bias = net.by_byte[k], net.recurrent[k], net.bias[k]
    for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
        gates = np.take(table, text[t], axis=1)
        back = u @ state
        zr = gates[: 2 * h]
        zr += back[: 2 * h]
        _sigmoid(zr)
        z, r, new = zr[:h], zr[h:], gates[2 * h :]
        inner = back[2 * h :]
        inner += bias
        new += r * inner
        np.tanh(new, out=new)
        if keep is not None:
            keep.append((t, state, z, r, new, inner))
        state = new + z * (state - new)
        out[t] = state
    return out


def position_labels(net: Network, text: np.ndarray) -> np.ndarray:
    """Probabilities (WINDOW, C, B) of each byte of text (WINDOW, B)."""
    both = np.concatenate([_read(net, 0, text), _read(net, 1, text)], 1)
    p = np.matmul(net.out, both)
    p += net.out_bias
    p -= p.max(1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p


def _gradients(net: Network, text: np.ndarray, label: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss over all bytes, by backpropagation through time; weight (WINDOW, B) is 0 past a text's end."""
    h, kept = net.hidden, [[], []]
    states = [_read(net, k, text, kept[k]) for k in (0, 1)]
    both = np.concatenate(states, 1)
    p = np.matmul(net.out, both) + net.out_bias
    p = np.exp(p - p.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[:, label, np.arange(text.shape[1])] -= 1
    p *= (weight / weight.sum())[:, None, :]
    g_out = np.einsum("tcb,thb->ch", p, both)
    g_both = np.matmul(net.out.T, p)
    g_byte, g_u, g_bias = np.zeros_like(net.by_byte), np.zeros_like(net.recurrent), np.zeros_like(net.bias)
    for k in (0, 1):
        into = np.zeros((h, text.shape[1]), np.float32)
        gates = np.empty((text.shape[0], 3 * h, text.shape[1]), np.float32)
        for t, state, z, r, new, inner in reversed(kept[k]):
            d = into + g_both[t, k * h : (k + 1) * h]
            d_new = d * (1 - z) * (1 - new * new)
            d_z = d * (state - new) * z * (1 - z)
            d_r = d_new * inner * r * (1 - r)
            gates[t] = np.concatenate([d_z, d_r, d_new])
            back = np.concatenate([d_z, d_r, d_new * r])
            g_u[k] += back @ state.T
            g_bias[k] += back[2 * h :].sum(1, keepdims=True)
            into = d * z + net.recurrent[k].T @ back
        flat = gates.transpose(1, 0, 2).reshape(3 * h, -1)
        for i in range(3 * h):
            g_byte[k, i] = np.bincount(text.reshape(-1), flat[i], 256)
    return [g_byte, g_u, g_bias, g_out, p.sum((0, 2))[:, None]]


def train(windows: np.ndarray, lengths: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 5) -> Network:
    """windows (n, WINDOW) bytes, of which the first ``lengths`` count; labels: places in languages, each drawn equally often."""
    rng = np.random.default_rng(seed)
    net = Network.new(languages, rng)
    first, second = [np.zeros_like(p) for p in net.parts()], [np.zeros_like(p) for p in net.parts()]
    own = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(own[k]) for k in rng.integers(0, len(languages), BATCH)])
        weight = (np.arange(WINDOW)[:, None] < lengths[pick]).astype(np.float32)
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(net.parts(), _gradients(net, np.ascontiguousarray(windows[pick].T), labels[pick], weight), first, second, strict=True):
            g = np.clip(g, -1, 1)
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def cut(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows (n, WINDOW), lengths, row) of the rows of a chunk, each from its start to its end."""
    size = np.diff(bounds)
    per = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), per)
    place = np.arange(len(row)) - np.repeat(np.concatenate([[0], np.cumsum(per)[:-1]]), per)
    start = bounds[:-1][row] + place * WINDOW
    lengths = np.minimum(WINDOW, bounds[1:][row] - start)
    padded = np.concatenate([data, np.zeros(WINDOW, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start] if len(row) else np.zeros((0, WINDOW), np.uint8)
    # past a text's end there are zeros: what another text holds has no part in it
    return windows * (np.arange(WINDOW) < lengths[:, None]), lengths, row


def pooled(net: Network, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean probabilities (rows, C) over the bytes of each row of a chunk; 0 for rows without any."""
    windows, lengths, row = cut(data, bounds)
    sums = np.zeros((len(bounds) - 1, len(net.languages)))
    for a in range(0, len(row), _AT_ONCE):
        s = slice(a, a + _AT_ONCE)
        p = position_labels(net, np.ascontiguousarray(windows[s].T))
        p *= (np.arange(WINDOW)[:, None] < lengths[s])[:, None, :]
        total = p.sum(0)
        for c in range(len(net.languages)):
            sums[:, c] += np.bincount(row[s], total[c], len(bounds) - 1)
    return sums / np.maximum(1, np.diff(bounds))[:, None]


def has_letter(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each row of a chunk holds a letter."""
    low = data | np.uint8(32)
    ascii_letter = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    out = ascii_letter[bounds[1:]] > ascii_letter[bounds[:-1]]
    for i in np.flatnonzero(~out & (np.diff(bounds) > 0)):
        out[i] = any(c.isalpha() for c in data[bounds[i] : bounds[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _windows_of(windows: int):
    """(lang, window, length) of at most ``windows`` windows a text, evenly spread over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for at, _, data, bounds in chunks(batch.column(1)):
                found, lengths, row = cut(data, bounds)
                for r in np.unique(row):
                    own = np.flatnonzero(row == r)
                    own = own[np.unique(np.linspace(0, len(own) - 1, windows).astype(int))]
                    yield pa.RecordBatch.from_pydict({"lang": [langs[at + r]] * len(own), "window": [found[i].tobytes() for i in own], "length": lengths[own]})

    return run


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, windows: int = WINDOWS, sample: int = SAMPLE, steps: int = STEPS) -> Network:
    rows = docs.select("doc_id", "lang").filter("lang IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out(4))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(F.xxhash64("doc_id")).alias("least"))
    known = counts.count()
    if not known:
        return Network.new([], np.random.default_rng(0))
    per = max(1, min(per_language, sample // known))
    # one row a language, of which the sample's bound holds the number: rows meet it where they are read
    few = F.broadcast(counts) if known <= sample else counts
    # of each language's ids, those that hash so low that about twice as many are left as are taken, and the lowest: no task meets all rows of a language
    bound = F.when(F.col("n") <= 4 * per, F.lit(2.0**63)).otherwise(F.lit(2.0**64) * (2.0 * per) / F.col("n") - F.lit(2.0**63))
    low = rows.withColumn("hash", F.xxhash64("doc_id")).join(few, "lang").filter((F.col("hash") <= bound) | (F.col("hash") == F.col("least")))
    rank = F.dense_rank().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    chosen = low.select("lang", "hash", "doc_id").distinct().withColumn("rank", rank).filter(F.col("rank") <= per)
    # at most ``sample`` ids, or one a language
    ids = saved(chosen.select(F.col("doc_id").alias("id")).distinct(), "sample")
    texts = docs.select("doc_id", "lang", "text").filter("lang IS NOT NULL").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select("lang", "text")
    found = texts.mapInArrow(_windows_of(windows), "lang string, window binary, length long").toPandas().sort_values(["lang", "window"])
    languages = sorted(found["lang"].unique())
    if not languages:
        return Network.new([], np.random.default_rng(0))
    place = {x: i for i, x in enumerate(languages)}
    data = np.frombuffer(b"".join(found["window"]), np.uint8).reshape(-1, WINDOW)
    return train(data, found["length"].to_numpy(np.int64), found["lang"].map(place).to_numpy(np.int64), languages, steps * -(-len(languages) // 32))


def predict(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each (doc_id, text)."""
    net = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = net.value
        for batch in batches:
            names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for at, _, data, bounds in chunks(batch.column(2)) if n.languages else ():
                p = pooled(n, data, bounds)
                best = p.argmax(1)
                for i in np.flatnonzero(has_letter(data, bounds)):
                    names[at + i], score[at + i] = n.languages[best[i]], min(1.0, float(p[i, best[i]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(4).alias("held_out"), "text").mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` (doc_id, text, lang) and predict all its rows."""
    return predict(docs, fit(docs))
