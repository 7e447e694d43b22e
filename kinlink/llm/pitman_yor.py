"""LM scoring by a hierarchical Pitman-Yor model.

The model predicts each token from the token before it.  Every token that stands
before another, and the start of a text, is a context with a restaurant of its
own, whose dishes are tokens; all share one parent restaurant, whose customers are
their tables, over a uniform base.  Predictive probabilities are averaged over
``SAMPLES`` seatings.

Seatings are sampled by a blocked Gibbs sampler with two kinds of auxiliary
variables, given which all dishes are independent, so that no table is counted
twice or held fixed while others open.  For each restaurant of T tables a gamma
variable g of shape S/D + T takes the place of the total of tables: a dish of c
customers then has t tables with probability proportional to x ** t times the
generalised Stirling number of (c, t), with x = D * g * the parent's probability of
the dish.  The parent's probabilities are drawn whole: of each token a gamma variable
of shape customers - D0 * tables, and its part of the rest, which is a tempered
stable variable; all divided by their sum.  A sweep draws, in this order, the parent's
tables of heavy tokens, the parent's gamma, the parent's probabilities, each context's gamma,
all tables, and the parent's tables of the other tokens, each given the last of the others.

Counts of (token, context) are gathered from all training texts, combined in each
task, and kept in buckets of tokens; the pairs of a ``heavy`` token (a bounded
number of them) are spread over buckets by context.  A sweep works on each bucket
alone, given each context's gamma.  Between sweeps every bucket
sends its share of those to buckets of contexts, which add them up and send back
the sums that the bucket asked for.  So nothing that grows with the data meets in
one task or is broadcast: only the heavy tokens' tables, and a few sums.

For scoring, the ``hot_pairs`` commonest pairs' probabilities are broadcast and added
where texts are read, in ``SLICES`` parts of the texts by hash of id and text; the other pairs go to the buckets of tokens.  The
probability of a pair that no training text holds is the mean over the seatings of
the parent's times a factor of the context alone: buckets of tokens send the seatings'
shares of the parent's, and buckets of contexts weigh their factors by them.

Tokens are known by 64 bits of hash.  As contexts they are known by ``BITS`` of them:
counts don't depend on those, and two contexts of one hash would share a restaurant.

Null and empty texts hold the end token only.  Each input row gives one row,
repeated rows and null ids too; null ids count as training rows.  No rows give no
rows.  Texts of any length are read whole, in chunks of whole rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property, lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LARGE, chunks, discard, held_out, in_sorted, mixed, saved, words

#: Discount and strength of the context restaurants, and of their parent.
D1, S1 = 0.85, 2.0
D0, S0 = 0.6, 10.0
#: Seatings averaged.
SAMPLES = 2
#: Bytes of text for each bucket.
PER_BUCKET = 8_000_000
#: Parts in which texts are scored, one after the other, so that only one part's pairs are on disk.
SLICES = 3
#: Pairs that are scored where the texts are read.
HOT = 1 << 18
#: A token with this share of all tokens is heavy: there are no more than one over it.
HEAVY = 2.0**-14
#: Seatings before the first one that is kept.
BURN = 2
#: Up to so many customers of a dish its tables are drawn from all probabilities; beyond, from weighted paths, so many.
EXACT, PATHS = 1024, 16
#: Up to so many customers the weights of tables are summed as a polynomial, without logarithms.
FEW = 16
#: The bits of a token's hash by which it is known as a context.
BITS = np.uint64((1 << 48) - 1)
END = np.uint64(0x5851F42D4C957F2D)
_PAIRS = 3 << 18


@lru_cache(maxsize=4)
def log_stirling(discount: float, most: int) -> np.ndarray:
    """Row c, column t: log of the generalised Stirling number of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, :c + 1], out[c, 1 : c + 2] + np.log(np.maximum(c - discount * t[1 : c + 2], 1e-300)))
    return out


def _log_gamma(z: np.ndarray) -> np.ndarray:
    """Of numbers from about 30 on."""
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 - (1 / 30 - 1 / (105 * z * z)) / (z * z)) / (12 * z)


def _chosen(weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column of each row, by weights whose logs are given."""
    total = np.cumsum(np.exp(weights - weights.max(axis=1, keepdims=True)), axis=1)
    return (total < rng.random(len(weights))[:, None] * total[:, -1:]).sum(axis=1)


def _counted_up(row: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """As :func:`_chosen`, of the weights ``row[t] * x ** t``."""
    total, power = np.empty((len(row), len(x))), np.ones(len(x))
    total[0] = row[0]
    for t in range(1, len(row)):
        power *= x
        np.multiply(power, row[t], out=total[t])
        total[t] += total[t - 1]
    return (total[:-1] < rng.random(len(x)) * total[-1]).sum(axis=0)


def seat(customers: np.ndarray, x: np.ndarray, discount: float, rng: np.random.Generator, exact: int = EXACT) -> np.ndarray:
    """Tables of dishes: t of c customers with probability proportional to x ** t * Stirling(c, t).

    Beyond ``exact`` customers, ``PATHS`` paths go on from a seating of the first ``exact`` ones, and one is chosen by their weights.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    table = log_stirling(discount, exact)
    small = np.flatnonzero((customers > 1) & (customers <= exact))
    kind = np.uint16 if exact < 1 << 16 else np.int64
    small = small[np.argsort(customers[small].astype(kind), kind="stable")]
    c, x_ = customers[small], np.maximum(x[small], 1e-300)
    at = 0
    while at < len(small):
        least = int(c[at])
        most = least if least <= FEW else min(least + least // 4, exact)  # rows of fewer customers are filled up with nothing
        to = min(int(np.searchsorted(c, most, "right")), at + max(1, (1 << 17) // most))
        if most <= FEW:
            found = _counted_up(np.exp(table[most, 1 : most + 1]), x_[at:to], rng)
        else:
            most = int(c[to - 1])
            found = _chosen(table[c[at:to], 1 : most + 1] + np.arange(1, most + 1) * np.log(x_[at:to])[:, None], rng)
        tables[small[at:to]] = 1 + found
        at = to
    large = np.flatnonzero(customers > exact)
    for a in range(0, len(large), 256):
        part = large[a : a + 256]
        tables[part] = _paths(customers[part], x[part], discount, rng, exact)
    return tables


def _paths(customers: np.ndarray, x: np.ndarray, discount: float, rng: np.random.Generator, exact: int) -> np.ndarray:
    """Tables of dishes of more than ``exact`` customers.

    A customer opens a table with a weight that is smaller the earlier one comes, as the ones after make up for it;
    it is kept while the number of seated ones doubles. What it should be and what it was make the path's weight.
    """
    c, x = np.repeat(customers, PATHS), np.repeat(np.maximum(x, 1e-300), PATHS)
    first = x * (exact / c) ** discount
    t = 1 + np.concatenate([_chosen(log_stirling(discount, exact)[exact, 1:] + np.arange(1, exact + 1) * np.log(first[a : a + 256])[:, None], rng) for a in range(0, len(c), 256)])
    weight = t * np.log(x / first)
    i, end = np.full(len(c), exact), np.minimum(c, 2 * exact)
    opens = x * (1.5 * exact / c).clip(max=1) ** discount
    go = np.arange(len(c))
    while len(go):
        a, w, most = i[go] - discount * t[go], opens[go], end[go] - i[go]
        # none of the next m opens a table with probability (b / (b + m)) ** v: for the first one as by its weight w beside a, and nearly so for the others
        b = a + (w - 1) / 2
        v = np.log1p(w / a) / np.log1p(1 / b)
        lo = np.minimum(b * np.expm1(np.minimum(-np.log(rng.random(len(go)) + 1e-300) / v, 50.0)), most).astype(np.int64)
        opened = lo < most
        i[go] += lo + opened
        t[go] += opened
        stayed = _log_gamma(np.concatenate([a, a + lo]))
        weight[go] += stayed[len(go) :] - stayed[: len(go)] + v * np.log1p(lo / b) + np.where(opened, np.log(x[go] / -np.expm1(-v * np.log1p(1 / (b + lo)))), 0.0)
        turn = go[i[go] == end[go]]
        end[turn] = np.minimum(c[turn], 2 * i[turn])
        opens[turn] = x[turn] * (1.5 * i[turn] / c[turn]).clip(max=1) ** discount
        go = go[i[go] < c[go]]
    one = _chosen(weight.reshape(-1, PATHS), rng)
    return t.reshape(-1, PATHS)[np.arange(len(one)), one]


def _uniform(key: np.ndarray, seed: int, k: int) -> np.ndarray:
    """The ``k``-th number between 0 and 1 of a key: the same wherever it is asked for."""
    return ((mixed(key ^ mixed(np.full(1, (seed << 32) + k, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def gammas(shape: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    """A gamma variable of each shape, by key."""
    low = shape < 1
    d = np.where(low, shape + 1, shape) - 1 / 3
    out, todo, k = np.zeros(len(key)), np.arange(len(key)), 1
    while len(todo):
        own, e = key[todo], d[todo]
        normal = np.sqrt(-2 * np.log(_uniform(own, seed, k))) * np.cos(2 * np.pi * _uniform(own, seed, k + 1))
        v = np.maximum(1 + normal / np.sqrt(9 * e), 1e-100) ** 3
        done = (v > 1e-290) & (np.log(_uniform(own, seed, k + 2)) < normal**2 / 2 + e - e * v + e * np.log(v))
        out[todo[done]] = (e * v)[done]
        todo, k = todo[~done], k + 3
    return np.where(low, out * _uniform(key, seed, 0) ** (1 / np.where(low, shape, 1.0)), out)


def tempered(mass: float, discount: float, key: np.ndarray, seed: int) -> np.ndarray:
    """A tempered stable variable of ``mass`` for each key: the log of its Laplace transform is -mass * ((1 + s) ** discount - 1)."""
    parts = max(1, int(np.ceil(mass)))
    out, k = np.zeros(len(key)), 0
    for _ in range(parts):
        todo = np.arange(len(key))
        while len(todo):
            own = key[todo]
            angle = np.pi * _uniform(own, seed, k)
            shape = (np.sin(discount * angle) ** discount * np.sin((1 - discount) * angle) ** (1 - discount) / np.sin(angle)) ** (1 / (1 - discount))
            y = (mass / parts) ** (1 / discount) * (shape / -np.log(_uniform(own, seed, k + 1))) ** ((1 - discount) / discount)
            done = _uniform(own, seed, k + 2) < np.exp(-y)
            out[todo[done]] += y[done]
            todo, k = todo[~done], k + 3
    return out


def tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, context, row) of the rows of a chunk, with each row's end token; the context of a row's first token is END."""
    value, row, _, _ = words(data, bounds, False)
    n = len(bounds) - 1
    counts = np.bincount(row, minlength=n)
    begin = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(begin[-1], END, np.uint64)
    rows = np.repeat(np.arange(n), counts + 1)
    inside = np.ones(len(out), bool)
    inside[begin[1:] - 1] = False
    out[inside] = value
    context = np.empty(len(out), np.uint64)
    context[1:] = out[:-1] & BITS
    context[begin[:-1]] = END & BITS
    return out, context, rows


class Lookup:
    """Different hashes in order, with the place where each value of their first bits begins."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(1, len(keys).bit_length())
        self.keys, self.shift = np.append(keys, np.uint64(2**64 - 1)), np.uint64(max(0, int(keys.max(initial=0)).bit_length() - bits))
        self.start = np.concatenate([[0], np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))[:-1]]).astype(np.int32 if len(keys) < 1 << 31 else np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, place) as of :func:`in_sorted`."""
        if len(self.keys) == 1:
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        place = self.start[np.minimum(keys >> self.shift, np.uint64(len(self.start) - 1)).astype(np.int64)]
        there = self.keys[place]
        before = np.flatnonzero(there < keys)
        while len(before):
            place[before] += 1
            there[before] = self.keys[place[before]]
            before = before[there[before] < keys[before]]
        last = len(self.keys) - 2
        return (there == keys) & (place <= last), np.minimum(place, last)


@dataclass(frozen=True)
class Spread:
    """Where pairs go: buckets of tokens, of contexts, and the heavy tokens in order."""

    buckets: int
    heavy: np.ndarray

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.heavy)

    def bucket(self, token: np.ndarray, context: np.ndarray) -> np.ndarray:
        out = token.copy()
        heavy = np.flatnonzero(self.lookup(token)[0])
        out[heavy] = pair_hash(token[heavy], context[heavy])
        return (out % np.uint64(self.buckets)).astype(self.kind)

    @property
    def kind(self) -> type:
        """Of the buckets' numbers: those of 16 bits are put in order quickest."""
        return np.uint16 if self.buckets < 1 << 16 else np.int64

    def of_context(self, context: np.ndarray) -> np.ndarray:
        return (mixed(context) % np.uint64(self.buckets)).astype(self.kind)


def pair_hash(token: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mixed(token ^ mixed(context + np.uint64(1)))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of one value begin."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _sized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of runs, and their lengths."""
    start = _runs(x)
    return x[start], np.diff(start, append=len(x))


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes in order, and the place of each one."""
    own = np.sort(x)
    own = own[_runs(own)]
    return own, Lookup(own)(x)[1]


def _first_bytes(k: int) -> np.dtype:
    """Of numbers of 8 bytes, the first k."""
    return np.dtype({"names": ["x"], "formats": [f"V{k}"], "itemsize": 8})


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as they need; the first byte tells how many."""
    k = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([k]) + np.ascontiguousarray(x.astype("<u8", copy=False)).view(_first_bytes(k))["x"].tobytes()


def _unpacked(b: bytes, kind: str = "<i8") -> np.ndarray:
    k = b[0]
    out = np.zeros((len(b) - 1) // k, "<u8")
    out.view(_first_bytes(k))["x"] = np.frombuffer(b, f"V{k}", offset=1)
    return out.view(kind)


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers from 0 on that are mostly small ones: a byte each, and the large ones before them."""
    x = x.astype("<i8", copy=False)
    large = x[x >= 255]
    return zlib.compress(np.int64(len(large)).tobytes() + large.tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes(), 1)


def _numbers(b: bytes) -> np.ndarray:
    b = zlib.decompress(b)
    n = int(np.frombuffer(b, "<i8", 1)[0])
    small = np.frombuffer(b, np.uint8, offset=8 + 8 * n)
    out = small.astype(np.int64)
    if n:
        out[small == 255] = np.frombuffer(b, "<i8", n, offset=8)
    return out


def _hashes(b: bytes) -> np.ndarray:
    return _unpacked(b, "<u8")


def heavy_tokens(docs: DataFrame, share: float = HEAVY) -> np.ndarray:
    """The tokens that hold ``share`` of all tokens, in order, by what is frequent in parts of the texts; it only shapes the work."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def told() -> pa.RecordBatch:
            every = np.concatenate(held)
            found, n = np.unique(every, return_counts=True)
            keep = n >= share / 2 * len(every)
            return pa.RecordBatch.from_arrays([pa.array(found[keep].view(np.int64)), pa.array(n[keep])], names=["token", "n"])

        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                held.append(tokens(data, bounds)[0])
                if sum(map(len, held)) > _PAIRS:
                    yield told()
                    held = []
        if held:
            yield told()

    top = docs.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(int(1 / share)).toPandas()
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def _counted(spread) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, tokens, sizes, contexts, n) of training texts, combined in the task: each token once, with its contexts."""

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        own, place = _numbered(np.concatenate(held))
        held.clear()
        # each row ends with END, so the token before is the context of a row's first token too
        bits = np.uint64(len(own).bit_length())
        key = place.astype(np.uint64) << bits
        key[1:] |= place[:-1].astype(np.uint64)
        key[:1] |= np.uint64(np.searchsorted(own, END))
        key.sort()
        start = _runs(key)
        del place
        n, key = np.diff(start, append=len(key)), key[start]
        word, context = (key >> bits).astype(np.int64), (own & BITS)[(key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)]
        bucket = spread.value.bucket(own[word], context)
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(spread.value.buckets + 1))
        ks = np.flatnonzero(np.diff(cut))
        word, context, n = word[by], context[by], n[by]
        out: dict[str, list] = {"bucket": ks.tolist(), "tokens": [], "sizes": [], "contexts": [], "n": []}
        for k in ks:
            part = slice(cut[k], cut[k + 1])
            words_, sizes = _sized(word[part])
            out["tokens"].append(_packed(own[words_]))
            out["sizes"].append(_packed(sizes))
            out["contexts"].append(_packed(context[part]))
            out["n"].append(_squeezed(n[part]))
        return pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("tokens", "sizes", "contexts", "n"))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                held.append(tokens(data, bounds)[0])
                size += len(held[-1])
                if size > 3 * _PAIRS:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


_STATE = "bucket int, tokens binary, sizes binary, contexts binary, place binary, c binary, t array<binary>, parent_t array<binary>, customers array<binary>"


class State:
    """A bucket's pairs: tokens and contexts (these by their bucket), and of each pair, in order of token, its word, place among the contexts, customers, and tables in each seating."""

    def __init__(self, row) -> None:
        """``row`` may lack what isn't asked for."""
        self.bucket, self.row = int(row["bucket"]), row

    @cached_property
    def token(self) -> np.ndarray:
        return _hashes(self.row["tokens"])

    @cached_property
    def sizes(self) -> np.ndarray:
        return _unpacked(self.row["sizes"])

    @cached_property
    def word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    @cached_property
    def contexts(self) -> np.ndarray:
        return _hashes(self.row["contexts"])

    @cached_property
    def place(self) -> np.ndarray:
        return _unpacked(self.row["place"])

    @cached_property
    def c(self) -> np.ndarray:
        return _numbers(self.row["c"])

    @cached_property
    def t(self) -> list[np.ndarray]:
        return [_numbers(b) for b in self.row["t"]]

    @cached_property
    def parent_t(self) -> list[np.ndarray]:
        return [_numbers(b) for b in self.row["parent_t"]]

    @cached_property
    def customers(self) -> list[np.ndarray]:
        """The parent's customers of each token here, by seating."""
        kept = self.row.get("customers")
        return [self.of_words(x) for x in self.t] if kept is None else [_numbers(b) for b in kept]

    def of_words(self, x: np.ndarray) -> np.ndarray:
        """The sums of pairs' numbers by token."""
        return np.add.reduceat(x, np.cumsum(self.sizes) - self.sizes) if len(x) else np.zeros(0, np.int64)

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The pairs' hashes in order, and where each stands."""
        found = pair_hash(np.repeat(self.token, self.sizes), self.contexts[self.place])
        by = np.argsort(found)
        return found[by], by

    def seated(self, t: list[bytes], parent_t: list[bytes], customers: list[bytes]) -> dict:
        return {**{k: self.row[k] for k in ("bucket", "tokens", "sizes", "contexts", "place", "c")}, "t": t, "parent_t": parent_t, "customers": customers}


def _merged(spread, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A bucket's counts, and a first seating: one table a pair, one a token."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        own, at = _numbered(np.concatenate([_hashes(b) for b in group["tokens"]]))
        contexts, place = _numbered(np.concatenate([_hashes(b) for b in group["contexts"]]))
        by = np.argsort(spread.value.of_context(contexts), kind="stable")
        where = np.empty(len(by), np.uint64)
        where[by] = np.arange(len(by), dtype=np.uint64)
        bits = np.uint64(len(contexts).bit_length())
        key = np.repeat(at, np.concatenate([_unpacked(b) for b in group["sizes"]])).astype(np.uint64) << bits | where[place]
        order = np.argsort(key)
        key = key[order]
        start = _runs(key)
        c = np.add.reduceat(np.concatenate([_numbers(b) for b in group["n"]])[order], start)
        place, sizes = (key[start] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), _sized((key[start] >> bits))[1]
        row = {"bucket": group["bucket"].iloc[0], "tokens": _packed(own), "sizes": _packed(sizes), "contexts": _packed(contexts[by]), "place": _packed(place), "c": _squeezed(c), "t": [_squeezed(np.minimum(c, 1))], "parent_t": [_squeezed(np.ones(len(own), np.int64))], "customers": [_squeezed(sizes)]}
        return pd.DataFrame([row])

    return run


_SHARE = "at int, bucket int, contexts binary, c binary, t array<binary>"


def _shares(spread) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a bucket adds to the totals of its contexts, for each bucket of contexts; customers only if they are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("at", pa.int32()), ("bucket", pa.int32()), ("contexts", pa.binary()), ("c", pa.binary()), ("t", pa.list_(pa.binary()))])
        for batch in batches:
            for row in batch.to_pylist():
                s = State(row)
                at = spread.value.of_context(s.contexts)
                cut = np.searchsorted(at, np.arange(spread.value.buckets + 1))
                c, *t = (np.bincount(s.place, x, len(s.contexts)).astype(np.int64) if x is not None else None for x in (s.c if "c" in row else None, *s.t))
                out = [
                    {"at": int(k), "bucket": s.bucket, "contexts": _packed(s.contexts[a:b]), "c": None if c is None else _squeezed(c[a:b]), "t": [_squeezed(x[a:b]) for x in t]}
                    for k, a, b in zip(range(spread.value.buckets), cut[:-1], cut[1:], strict=True) if a < b
                ]
                for a in range(0, len(out), 256):
                    yield pa.RecordBatch.from_pylist(out[a : a + 256], schema=schema)

    return run


def _added(group: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, list[np.ndarray]]:
    """(contexts, place of each share's context, customers if they are given, tables of each seating) of a bucket of contexts."""
    contexts, place = _numbered(np.concatenate([_hashes(b) for b in group["contexts"]]))
    add = lambda parts: np.bincount(place, np.concatenate([_numbers(b) for b in parts]), len(contexts)).astype(np.int64)
    return contexts, place, None if group["c"].iloc[0] is None else add(group["c"]), [add([t[k] for t in group["t"]]) for k in range(len(group["t"].iloc[0]))]


def _answers(group: pd.DataFrame) -> pd.DataFrame:
    """The totals of a bucket of contexts, in the order in which each bucket of tokens asked for them."""
    contexts, place, c, t = _added(group)
    ends = np.cumsum([(len(b) - 1) // b[0] for b in group["contexts"]])
    out = []
    for a, b, bucket, at in zip(np.concatenate([[0], ends[:-1]]), ends, group["bucket"], group["at"], strict=True):
        out.append((bucket, at, None if c is None else _squeezed(c[place[a:b]]), [_squeezed(x[place[a:b]]) for x in t]))
    return pd.DataFrame(out, columns=["bucket", "at", "c", "t"])


@dataclass(frozen=True)
class Parent:
    """The parent restaurant: all its customers and tables, different tokens, training tokens; of heavy tokens the customers and tables."""

    customers: float
    tables: float
    distinct: int
    tokens: int
    heavy: np.ndarray
    heavy_count: np.ndarray
    heavy_customers: np.ndarray
    heavy_tables: np.ndarray

    #: Of the seating: the gamma, and once they are drawn the tokens' masses: their seed, their sum, those of heavy tokens.
    gamma: float
    seed: int = 0
    mass: float = 0.0
    heavy_mass: np.ndarray | None = None

    @property
    def base(self) -> float:
        return 1.0 / (self.distinct + 1)

    def weight(self) -> float:
        return (S0 + D0 * self.tables) * self.base

    def probability(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (customers - D0 * tables + self.weight()) / (S0 + self.customers)

    def of(self, s: State, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of a bucket's tokens; heavy ones are known in whole."""
        customers, tables = s.customers[k].astype(float), s.parent_t[k].astype(float)
        found, at = in_sorted(self.heavy, s.token)
        customers[found], tables[found] = self.heavy_customers[at[found]], self.heavy_tables[at[found]]
        return customers, tables

    def masses(self, token: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Tokens' probabilities times the sum of all."""
        rest = tempered(self.gamma * self.base, D0, token, 2 * self.seed)
        return rest + np.where(customers > 0, gammas(np.where(customers > 0, customers - D0 * tables, 1.0), token, 2 * self.seed + 1), 0.0)


def _sums(state: DataFrame, spread, gamma: list[float | None], rng: np.random.Generator, counts: bool = True) -> list[Parent]:
    """The parent restaurant in each seating, given its gamma then (training tokens only with ``counts``): sums over buckets, and the heavy tokens, which are seated here."""
    heavy, samples = spread.value.heavy, len(gamma)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = State(row)
                found, at = in_sorted(heavy, s.token)
                out: list[dict] = []
                own = s.of_words(s.c) if counts else np.zeros(len(s.token), np.int64)
                for k in range(samples):
                    n = s.customers[k]
                    out.append({"k": k, "token": -1, "customers": float(n.sum()), "tables": float(s.parent_t[k][~found].sum()), "words": int((~found).sum()), "n": float(own.sum())})
                    out += [{"k": k, "token": int(at[i]), "customers": float(n[i]), "tables": 0.0, "words": 0, "n": float(own[i])} for i in np.flatnonzero(found)]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("k", pa.int32()), ("token", pa.int32()), ("customers", pa.float64()), ("tables", pa.float64()), ("words", pa.int64()), ("n", pa.float64())]))

    rows = state.select("bucket", "tokens", "parent_t", "customers", *(("sizes", "c") if counts else ())).mapInArrow(run, "k int, token int, customers double, tables double, words long, n double").groupBy("k", "token").agg(*[F.sum(c).alias(c) for c in ("customers", "tables", "words", "n")]).toPandas()
    out = []
    for k in range(samples):
        mine = rows[rows["k"] == k]
        whole, some = mine[mine["token"] < 0], mine[mine["token"] >= 0].sort_values("token")
        at = some["token"].to_numpy(np.int64)
        customers, count = some["customers"].to_numpy(float), some["n"].to_numpy(float)
        total, tables, distinct, n = (float(whole[c].sum()) for c in ("customers", "tables", "words", "n"))
        words_ = int(distinct) + len(at)
        x = D0 * (gamma[k] or S0 / D0 + words_) / (words_ + 1)
        seated = seat(customers.astype(np.int64), np.full(len(at), x), D0, rng).astype(float)
        out.append(Parent(total, tables + seated.sum(), words_, int(n), heavy[at], count, customers, seated, rng.gamma(S0 / D0 + tables + seated.sum())))
    return out


def _last(*columns: str) -> list:
    """Of each column of seatings the last one."""
    return [F.array(F.element_at(c, -1)).alias(c) for c in columns]


def _drawn(state: DataFrame, parent: Parent, seed: int) -> Parent:
    """``parent`` with the tokens' probabilities, which each bucket draws again from the seed; here the sum of what they draw."""
    parent = replace(parent, seed=seed)
    parent = replace(parent, heavy_mass=parent.masses(parent.heavy, parent.heavy_customers, parent.heavy_tables))
    known = state.sparkSession.sparkContext.broadcast(parent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = State(row)
                light = ~in_sorted(known.value.heavy, s.token)[0]
                found = known.value.masses(s.token[light], s.customers[-1][light], s.parent_t[-1][light].astype(float))
                yield pa.RecordBatch.from_arrays([pa.array([float(found.sum())])], names=["mass"])

    light = state.select("bucket", "tokens", *_last("parent_t", "customers")).mapInArrow(run, "mass double").agg(F.sum("mass")).first()[0] or 0.0
    none = parent.masses(np.ones(1, np.uint64), np.zeros(1), np.zeros(1))  # of all that training doesn't hold
    return replace(parent, mass=light + float(parent.heavy_mass.sum()) + float(none[0]))


def _swept(parent, samples: list[int], seed: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """A sweep over a bucket, from its last seating; ``samples`` are the earlier seatings that stay."""

    def run(state: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        s, p = State(state.iloc[0]), parent.value
        rng = np.random.default_rng([seed, s.bucket])
        tables = np.concatenate([_numbers(t[-1]) for t in answers.sort_values("at")["t"]])
        # a lone customer has one table: only where there are more are the variables drawn
        some = np.flatnonzero(s.c > 1)
        words_, sizes = _sized(s.word[some])
        used = np.zeros(len(s.contexts), bool)
        used[s.place[some]] = True
        places, place = np.flatnonzero(used), (np.cumsum(used) - 1)[s.place[some]]
        customers, opened = p.of(s, -1)
        mass = p.masses(s.token[words_], customers[words_], opened[words_])
        found, at = in_sorted(p.heavy, s.token[words_])
        mass[found] = p.heavy_mass[at[found]]
        gamma = gammas(S1 / D1 + tables[places], s.contexts[places], 2 * p.seed)
        t = np.ones(len(s.c), np.int64)
        t[some] = seat(s.c[some], D1 * gamma[place] * np.repeat(mass / p.mass, sizes), D1, rng)
        customers = s.of_words(t)
        parent_t = seat(customers, np.full(len(s.token), D0 * p.gamma * p.base), D0, rng)
        return pd.DataFrame([s.seated(*([*(s.row[name][k] for k in samples), _squeezed(x)] for name, x in (("t", t), ("parent_t", parent_t), ("customers", customers))))])

    return run


def _asked(state: DataFrame, spread, whole: bool = True) -> DataFrame:
    """The totals of each bucket's contexts; if not ``whole``, only the tables of the last seating."""
    given = state.select("bucket", "contexts", "place", *(("c", "t") if whole else _last("t")))
    return given.mapInArrow(_shares(spread), _SHARE).groupBy("at").applyInPandas(_answers, "bucket int, at int, c binary, t array<binary>")


def trained(docs: DataFrame, buckets: int, seed: int = 7, share: float = HEAVY) -> tuple[DataFrame, list[Parent], object]:
    """The seatings by bucket, the parent restaurant in each, and where pairs go, from all rows of (text)."""
    context = docs.sparkSession.sparkContext
    spread = context.broadcast(Spread(buckets, heavy_tokens(docs, share)))
    rng = np.random.default_rng(seed)
    counted = docs.select("text").mapInArrow(_counted(spread), "bucket int, tokens binary, sizes binary, contexts binary, n binary")
    state = saved(counted.groupBy("bucket").applyInPandas(_merged(spread, seed), _STATE), "seating")
    gamma: list[float | None] = [None]
    for k in range(BURN + SAMPLES):
        kept = list(range(max(0, k - BURN)))  # seatings so far that are samples
        last = _sums(state.select("bucket", "tokens", *_last("parent_t", "customers")), spread, gamma[-1:], rng, counts=False)[-1]
        gamma = [*(gamma if kept else []), last.gamma]
        parent = context.broadcast(_drawn(state, last, seed + k + 1))
        swept = state.groupBy("bucket").cogroup(_asked(state, spread, whole=False).groupBy("bucket")).applyInPandas(_swept(parent, kept, seed + k + 1), _STATE)
        before, state = state, saved(swept, "seating")
        discard(before)
    return state, _sums(state, spread, gamma, rng), spread


class Scorer:
    """Scores of pairs by a bucket's state, the parent restaurant and the totals of the bucket's contexts."""

    def __init__(self, s: State, parents: list[Parent], customers: np.ndarray, tables: list[np.ndarray]) -> None:
        self.s, self.parents = s, parents
        self.count = s.of_words(s.c).astype(float)
        found, at = in_sorted(parents[0].heavy, s.token)
        self.count[found] = parents[0].heavy_count[at[found]]
        self.up = [p.probability(*p.of(s, k)) for k, p in enumerate(parents)]
        share = 1 / (S1 + customers) / len(parents)
        self.probability = (len(parents) * s.c - D1 * sum(s.t)) * share[s.place]
        for k, up in enumerate(self.up):
            self.probability += ((S1 + D1 * tables[k]) * share)[s.place] * np.repeat(up, s.sizes)
        pairs, self.order = s.pairs
        self.pairs = Lookup(pairs)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1) / (self.parents[0].tokens + self.parents[0].distinct + 1))

    def __call__(self, token: np.ndarray, sizes: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of tokens, each with so many contexts: (count of the token, log10 of the base probability, log10 of what is known here, whether the context's factor is missing, and then each seating's share of the parent's probability)."""
        known, word = in_sorted(self.s.token, token)
        heavy, h = in_sorted(self.parents[0].heavy, token)
        heavy &= ~known  # heavy tokens of which no training pair is here
        n = np.zeros(len(token))
        n[known], n[heavy] = self.count[word[known]], self.parents[0].heavy_count[h[heavy]]
        ups = []
        for k, parent in enumerate(self.parents):
            up = np.full(len(token), parent.probability(np.zeros(1), np.zeros(1))[0])
            up[known], up[heavy] = self.up[k][word[known]], parent.probability(parent.heavy_customers[h[heavy]], parent.heavy_tables[h[heavy]])
            ups.append(up)
        p = np.mean(ups, axis=0)
        shares = (np.stack(ups) / (p * len(ups))).astype(np.float32)
        of = np.repeat(np.arange(len(token)), sizes)
        seen, at = self.pairs(pair_hash(token[of], context))
        seen &= known[of]
        out = np.log10(p)[of]
        out[seen] = np.log10(self.probability[self.order[at[seen]]])
        return n[of], self.base(n)[of], out, ~seen, shares[:, of[~seen]]


@dataclass(frozen=True)
class Hot:
    """The commonest pairs' hashes in order, with what their tokens score; all of them are known."""

    pairs: np.ndarray
    base: np.ndarray
    score: np.ndarray

    @cached_property
    def lookup(self) -> Lookup:
        return Lookup(self.pairs)


def _hot(state: DataFrame, shares: DataFrame, spread, parents, n: int) -> Hot:
    """At most ``n`` of the commonest pairs. Each bucket names its own; the buckets of contexts tell the totals of theirs."""
    context = state.sparkSession.sparkContext
    each = max(1, 4 * n // spread.value.buckets)
    samples = len(parents.value)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s, p = State(row), parents.value
                top = np.flatnonzero(s.c > 1)
                top = top[np.argsort(-s.c[top], kind="stable")[:each]]
                count = s.of_words(s.c).astype(float)
                found, at = in_sorted(p[0].heavy, s.token)
                count[found] = p[0].heavy_count[at[found]]
                up = [x.probability(*x.of(s, k))[s.word[top]] for k, x in enumerate(p)]
                columns = [pair_hash(s.token[s.word[top]], s.contexts[s.place[top]]).view(np.int64), s.contexts[s.place[top]].view(np.int64), s.c[top], count[s.word[top]].astype(np.int64), *(t[top] for t in s.t), *up]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["pair", "context", "c", "count", *(f"t{k}" for k in range(samples)), *(f"up{k}" for k in range(samples))])

    kinds = ", ".join(["pair long", "context long", "c long", "count long", *(f"t{k} long" for k in range(samples)), *(f"up{k} double" for k in range(samples))])
    top = saved(state.mapInArrow(own, kinds).orderBy(F.desc("c"), "pair").limit(n), "hot")
    asked = context.broadcast(np.sort(top.select("context").distinct().toPandas()["context"].to_numpy(np.int64).view(np.uint64)))

    def totals(group: pd.DataFrame) -> pd.DataFrame:
        contexts, _, c, t = _added(group)
        keep, _ = in_sorted(asked.value, contexts)
        return pd.DataFrame({"context": contexts[keep].view(np.int64), "whole": c[keep], **{f"opened{k}": t[k][keep] for k in range(samples)}})

    known = shares.groupBy("at").applyInPandas(totals, ", ".join(["context long", "whole long", *(f"opened{k} long" for k in range(samples))]))
    first = parents.value[0]
    p = sum((F.col("c") - D1 * F.col(f"t{k}") + (S1 + D1 * F.col(f"opened{k}")) * F.col(f"up{k}")) / (S1 + F.col("whole")) for k in range(samples)) / samples
    told = top.join(known, "context").select("pair", F.log10((F.col("count") + 1) / F.lit(float(first.tokens + first.distinct + 1))).alias("base"), F.log10(p).alias("score")).toPandas()
    discard(top)
    pairs = told["pair"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(pairs)
    return Hot(pairs[by], told["base"].to_numpy(float)[by], told["score"].to_numpy(float)[by])


def _entries(spread, hot) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each chunk of texts: a row for each bucket with the entries of its tokens; the first also holds the rows' ids and what hot pairs score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        buckets = spread.value.buckets
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("tokens", pa.binary()), ("sizes", pa.binary()), ("contexts", pa.binary()), ("rows", pa.binary()), ("ids", pa.list_(batch.schema.field(0).type)), ("held", pa.list_(pa.bool_())), ("sums", pa.binary())])
            for at, to, data, bounds in chunks(batch.column(2), LARGE):
                token, context, row = tokens(data, bounds)
                n = to - at
                here, place = hot.value.lookup(pair_hash(token, context))
                place = place[here]
                sums = np.stack([np.bincount(row, minlength=n), np.bincount(row[here], minlength=n), np.bincount(row[here], hot.value.base[place], n), np.bincount(row[here], hot.value.score[place], n)]).astype(np.float64)
                token, context, row = token[~here], context[~here], row[~here]
                bucket = spread.value.bucket(token, context)
                by = np.argsort(token)
                by = by[np.argsort(bucket[by], kind="stable")]
                token, context, row = token[by], context[by], row[by]
                cut = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
                ks = np.flatnonzero(np.diff(cut))
                home = int(ks[0]) if len(ks) else chunk % buckets
                out: dict[str, list] = {f.name: [] for f in schema}
                for k in ks if len(ks) else [home]:
                    s = slice(cut[k], cut[k + 1])
                    own, sizes = _sized(token[s])
                    told = (batch.column(0).slice(at, n).to_pylist(), batch.column(1).slice(at, n).to_pylist(), sums.tobytes()) if k == home else (None, None, None)
                    for name, v in zip(out, (int(k), chunk, _packed(own), _packed(sizes), _packed(context[s]), _packed(row[s]), *told), strict=True):
                        out[name].append(v)
                chunk += 1
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


_PART = "chunk long, rows binary, part binary, ids {ids}, held array<boolean>, sums binary, at int, contexts binary, unseen binary, shares array<binary>"


def _scored(parents, spread) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What a bucket's tokens add to the rows of each chunk, and which contexts' factors are still missing there."""

    def run(entries: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        seats, answers = state[state["tokens"].notna()], state[state["tokens"].isna()].sort_values("at")
        if len(seats):
            s = State(seats.iloc[0])
            customers = np.concatenate([_numbers(b) for b in answers["c"]])
            tables = [np.concatenate([_numbers(t[k]) for t in answers["t"]]) for k in range(len(parents.value))]
        else:
            none = np.zeros(0, np.int64)
            s = State({"bucket": 0, "tokens": _packed(none), "sizes": _packed(none), "contexts": _packed(none), "place": _packed(none), "c": _squeezed(none), "t": [_squeezed(none)] * SAMPLES, "parent_t": [_squeezed(none)] * SAMPLES})
            customers, tables = none, [none] * SAMPLES
        scorer, out = Scorer(s, parents.value, customers, tables), []
        asks: list[tuple[np.ndarray, ...]] = []

        def told(some: list) -> None:
            contexts, rows = [_hashes(e.contexts) for e in some], [_unpacked(e.rows) for e in some]
            context, row, size = np.concatenate(contexts), np.concatenate(rows), [len(x) for x in rows]
            count, base, score, missing, shares = scorer(np.concatenate([_hashes(e.tokens) for e in some]), np.concatenate([_unpacked(e.sizes) for e in some]), context)
            room = np.cumsum([0, *(int(x.max(initial=-1)) + 1 for x in rows)])  # each chunk's rows have places of their own
            place = row + np.repeat(room[:-1], size)
            there = np.bincount(place, minlength=room[-1])
            sums = np.stack([np.bincount(place, x, room[-1]) for x in (count > 0, base, score)])
            for e, a, b in zip(some, room[:-1], room[1:], strict=True):
                own = np.flatnonzero(there[a:b])
                out.append((e.chunk, _packed(own), sums[:, a + own].tobytes(), e.ids, e.held, e.sums, None, None, None, None))
            asks.append((np.repeat([e.chunk for e in some], size)[missing], context[missing], row[missing], *shares))

        some, size = [], 0
        for e in entries.itertuples():
            some.append(e)
            size += len(e.contexts)
            if size > LARGE:
                told(some)
                some, size = [], 0
        if some:
            told(some)
        # one row for each bucket of contexts, with the chunks that ask
        chunk, context, row, *shares = (np.concatenate(x) for x in zip(*asks, strict=True)) if asks else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
        at = spread.value.of_context(context)
        by = np.argsort(at, kind="stable")
        cut = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=spread.value.buckets))])
        for k in np.flatnonzero(np.diff(cut)):
            part = by[cut[k] : cut[k + 1]]
            chunks_, sizes = _sized(chunk[part])
            out.append((-1, _packed(sizes), chunks_.astype(np.int64).tobytes(), None, None, None, int(k), _packed(context[part]), _packed(row[part]), [zlib.compress(x[part].tobytes(), 1) for x in shares[1:]]))
        return pd.DataFrame(out, columns=["chunk", "rows", "part", "ids", "held", "sums", "at", "contexts", "unseen", "shares"]).astype({"at": "Int32"})

    return run


def _factors(asked: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
    """log10 of the factors of contexts by which unseen pairs' probabilities are less than the parent's, added up by chunk and row."""
    if len(shares):
        contexts, _, c, t = _added(shares)
        factor = np.stack([(S1 + D1 * x) / (S1 + c) for x in t])
    else:
        contexts, factor = np.zeros(0, np.uint64), np.ones((SAMPLES, 0))
    if not len(asked):
        return pd.DataFrame([], columns=["chunk", "rows", "part"])
    chunk = np.concatenate([np.repeat(np.frombuffer(p, np.int64), _unpacked(s)) for p, s in zip(asked["part"], asked["rows"], strict=True)])
    row = np.concatenate([_unpacked(b) for b in asked["unseen"]])
    found, at = in_sorted(contexts, np.concatenate([_hashes(b) for b in asked["contexts"]]))
    parts = [np.concatenate([np.frombuffer(zlib.decompress(x[k]), np.float32) for x in asked["shares"]]).astype(float) for k in range(len(factor) - 1)]
    value = np.zeros(len(at))
    for own, part in zip(factor, [1 - sum(parts), *parts], strict=True):
        value += part * (np.where(found, own[at], 1.0) if len(own) else 1.0)
    value = np.log10(value)
    every, place = np.unique(chunk, return_inverse=True)
    bits = np.uint64(int(row.max(initial=0)).bit_length())
    key = place.astype(np.uint64) << bits | row.astype(np.uint64)
    by = np.argsort(key)
    key = key[by]
    start = _runs(key)
    value, key = np.add.reduceat(value[by], start), key[start]
    chunk, row = every[(key >> bits).astype(np.int64)], key & ((np.uint64(1) << bits) - np.uint64(1))
    cut = np.append(_runs(chunk), len(chunk))
    out = [(int(chunk[a]), _packed(row[a:b]), np.stack([np.zeros(b - a), np.zeros(b - a), value[a:b]]).tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pd.DataFrame(out, columns=["chunk", "rows", "part"])


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    """A chunk's rows, each with the sums of its tokens."""
    head = group[group["sums"].notna()].iloc[0]
    sums = np.frombuffer(head["sums"], np.float64).reshape(4, -1).copy()
    for rows, part in zip(group["rows"], group["part"], strict=True):
        sums[1:, _unpacked(rows)] += np.frombuffer(part, np.float64).reshape(3, -1)
    return pd.DataFrame({"doc_id": pd.array(list(head["ids"]), dtype="object"), "held_out": list(head["held"]), "n_tokens": sums[0].astype(np.int64), "n_known": sums[1].astype(np.int64), "base_score": sums[2], "score": sums[3]})


def score(docs: DataFrame, per_bucket: int = PER_BUCKET, share: float = HEAVY, hot_pairs: int = HOT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each (doc_id, text); perplexity is 10 ** (-score / n_tokens)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out(7).alias("held"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    state, parents, spread = trained(rows.filter(~F.col("held")), int(max(24, size // per_bucket)), share=share)
    known = spark.sparkContext.broadcast(parents)
    id_kind = docs.schema["doc_id"].dataType
    ids = T.ArrayType(id_kind).simpleString()
    shares = saved(state.select("bucket", "contexts", "place", "c", "t").mapInArrow(_shares(spread), _SHARE), "shares")
    totals = saved(shares.groupBy("at").applyInPandas(_answers, "bucket int, at int, c binary, t array<binary>"), "totals")
    hot = spark.sparkContext.broadcast(_hot(state, shares, spread, known, hot_pairs))
    seats = state.withColumn("at", F.lit(None).cast("int")).unionByName(totals, allowMissingColumns=True)
    done = []
    for k in range(SLICES):
        part = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(SLICES)) == k)
        entries = part.mapInArrow(_entries(spread, hot), f"bucket int, chunk long, tokens binary, sizes binary, contexts binary, rows binary, ids {ids}, held array<boolean>, sums binary")
        parts = saved(entries.groupBy("bucket").cogroup(seats.groupBy("bucket")).applyInPandas(_scored(known, spread), _PART.format(ids=ids)), "parts")
        added = parts.filter("at IS NOT NULL").groupBy("at").cogroup(shares.groupBy("at")).applyInPandas(_factors, "chunk long, rows binary, part binary")
        found = parts.filter("at IS NULL").select("chunk", "rows", "part", "ids", "held", "sums").unionByName(added, allowMissingColumns=True)
        done.append(saved(found.groupBy("chunk").applyInPandas(_summed, f"doc_id {id_kind.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores"))
        del entries, added, found
        discard(parts)
    discard(state, totals, shares)
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(parents[0].tokens).cast("long").alias("train_tokens"), "base_score", "score")
