"""N-gram Jaccard join with set-relation skipping.

A document's set is its different 5-word shingles, as 64-bit hashes.  Equal
sets form a class, known by 128 bits of hash; classes, not documents, are
joined.  Sets are sorted in one global order: common shingles (a bounded table of
the commonest, by exact counts over all texts) come last, by count, the others by
hash.  Two sets can only link if they share a shingle of their prefixes.  Prefixes
are the first quarter of a set, so only the shingles that hash into the first
``COUNTED`` part of the order are counted.

*Index lists.*  Prefix entries of uncommon shingles are packed by bucket of
shingle; each bucket drops the lists of one class, which are most.  Lists of fewer
than ``LONG`` classes are sorted by position, and give the pairs that length and
position allow.  Entries of longer lists, and of common shingles, are kept.

*Answers.*  The smallest class of a long list is its pivot.  Every class of the list
is verified against the pivot once, however many lists they share, which costs
one pair an entry at most.  What a class x links to is then derived from how it
differs from the pivot p: with D(x) what only one of x and p holds,
``|x & y| = |x & p| + |y & p| - |p| + |D(x) & D(y)|``, so only the differences are
compared.  Classes that link to the pivot are not compared with each other.  Where a
pivot has more than a block of classes, only those meet that share one of their first
differences (of which what the pivot lacks comes first).  Where many share one, they
are cut into blocks of bounded bytes in order of how far from their sets' ends their
list entries stand, and a pair of blocks is skipped whole if no two of their classes
can link by that, by their sizes or by how far from the pivot they are.

A pair from a short list is first tested by sketches: of each set, the parities of
the hash classes of its shingles.  The sketches differ in no more places than the
sets do, so too many differing places prove that there is no link; other pairs
are verified in full.

Every pair of classes that links is joined by links found.  Null and empty
texts have empty sets, linked with nothing.  Repeated rows belong to one class;
null ids are kept and take no part in a class's smallest id.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LARGE, chunks, discard, in_sorted, mixed, saved, words
from .components import components

WIDTH = 5
PERCENT = 75
#: Shingles combined at a time in a task; in how many sets one must be to be common; the part of the hash order that is counted.
FLUSH, NAMED, COUNTED = 1 << 20, 8, 0.36
#: Classes of a list from which on they are compared by their differences from its pivot.
LONG = 8
#: Classes of a block, and bytes of their differences.
BLOCK, BLOCK_BYTES = 1024, 1 << 23
#: Bits of the filter of documents whose sets are wanted.
BITS = 1 << 25

_Q = np.uint64(0xD6E8FEB86659FD93)
_TOP = np.uint64(1 << 63)
_CLASS = np.dtype([("a", "<i8"), ("b", "<i8"), ("n", "<i4")])
_PAIR = ["xa", "xb", "ya", "yb"]


@dataclass(frozen=True)
class Order:
    """The common shingles, sorted by hash, and their ranks by count."""

    common: np.ndarray
    rank: np.ndarray

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        """Where shingles stand in the global order."""
        out = shingles >> np.uint64(1)
        found, place = in_sorted(self.common, shingles)
        out[found] = _TOP | self.rank[place[found]]
        return out


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted different shingles of each row of a chunk."""
    value, row, _, _ = words(data, bounds, False)
    counts = np.bincount(row, minlength=len(bounds) - 1)
    begin = np.concatenate([[0], np.cumsum(counts)])
    run = np.zeros(max(0, len(value) - width + 1), np.uint64)
    for k in range(width):
        run = run * _Q + value[k : k + len(run)]
    run = mixed(run)
    out = []
    for a, b in zip(begin[:-1], begin[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = whole * _Q + value[k : k + 1]
            out.append(mixed(whole ^ _TOP))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def class_hash(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    a = int(mixed(shingles).sum(dtype=np.uint64))
    b = int(mixed(shingles ^ _Q).sum(dtype=np.uint64))
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def prefix_length(n: int) -> int:
    return n - (PERCENT * n + 99) // 100 + 1


def needed(a, b, percent: int = PERCENT):
    """The least overlap of sets of sizes a and b that link; for numbers and arrays."""
    return -(-percent * (a + b) // (100 + percent))


def slack(a: Column, b: Column, overlap: Column, percent: int = PERCENT) -> Column:
    """At least 0 if sets of sizes a and b with this overlap link."""
    return (100 + percent) * overlap - percent * (a + b)


def sketch(shingles: np.ndarray) -> bytes:
    """The parities of a set's hash classes: a bit for each shingle at least, a power of two in all."""
    bits = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def differing(x: bytes, y: bytes) -> int:
    """In how many places two sketches differ, the longer one folded: no more than the sets do."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) != len(b):
        if len(a) > len(b):
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        else:
            b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, a, b, sketch): each row's number of shingles and class hash."""
    for batch in batches:
        for at, to, data, bounds in chunks(batch.column(1)):
            sets = shingle_sets(data, bounds)
            marks = [class_hash(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, to - at), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())],
                names=["doc_id", "n", "a", "b", "sketch"],
            )


def _counted(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bucket, shingles, counts), packed and combined in the task, of the shingles in the counted part of the order."""
    end = np.uint64(int(COUNTED * 2**64))

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        bucket = (found % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
        ks = np.flatnonzero(np.diff(cut))
        parts = [by[cut[k] : cut[k + 1]] for k in ks]
        return pa.RecordBatch.from_arrays([pa.array(ks.astype(np.int32)), pa.array([found[p].tobytes() for p in parts], pa.binary()), pa.array([n[p].astype(np.int32).tobytes() for p in parts], pa.binary())], names=["bucket", "shingles", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0)):
                for s in shingle_sets(data, bounds):
                    held.append(s[: np.searchsorted(s, end)])
                    size += len(held[-1])
                if size >= FLUSH:
                    yield packed(held)
                    held, size = [], 0
        if held:
            yield packed(held)

    return run


def _common(group: pd.DataFrame) -> pd.DataFrame:
    """The common shingles of a bucket."""
    shingles = np.concatenate([np.frombuffer(b, np.uint64) for b in group["shingles"]])
    counts = np.concatenate([np.frombuffer(b, np.int32) for b in group["counts"]])
    by = np.argsort(shingles, kind="stable")
    shingles, counts = shingles[by], counts[by]
    start = np.flatnonzero(np.concatenate([[True], shingles[1:] != shingles[:-1]])) if len(shingles) else np.zeros(0, np.int64)
    n = np.add.reduceat(counts.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
    return pd.DataFrame({"a": shingles[start][n >= NAMED].view(np.int64), "n": n[n >= NAMED]})


def _entries(sets: list[np.ndarray], order: Order) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, class as a place, position) of the prefixes of sets, and the classes, each once."""
    keys, owner, positions, classes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
    for s in sets:
        if not len(s) or (mark := class_hash(s)) in classes:
            continue
        k = prefix_length(len(s))
        keys.append(np.sort(order.keys(s))[:k])
        owner.append(np.full(k, len(classes)))
        positions.append(np.arange(k))
        classes[mark] = len(s)
    table = np.array([(a, b, n) for (a, b), n in classes.items()], _CLASS)
    return np.concatenate(keys), np.concatenate(owner), np.concatenate(positions), table


def _prefixes(order, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Prefix entries, packed by bucket of their shingle: (bucket, keys, places, classes, positions); those of common shingles go to any bucket, together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in chunks(batch.column(0), LARGE):
                key, owner, pos, table = _entries(shingle_sets(data, bounds), order.value)
                any_bucket = np.uint64(table["a"].view(np.uint64)[0] % np.uint64(buckets)) if len(table) else np.uint64(0)
                bucket = np.where(key < _TOP, key % np.uint64(buckets), any_bucket).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                bucket, key, owner, pos = bucket[by], key[by], owner[by], pos[by]
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                # classes are listed once for each chunk and bucket
                out: dict[str, list] = {"bucket": [], "keys": [], "places": [], "classes": [], "positions": []}
                for k in np.flatnonzero(np.diff(cut)):
                    s = slice(cut[k], cut[k + 1])
                    own, place = np.unique(owner[s], return_inverse=True)
                    out["bucket"].append(int(k))
                    out["keys"].append(key[s].tobytes())
                    out["places"].append(place.astype(np.uint32 if len(own) > 65535 else np.uint16).tobytes())
                    out["classes"].append(table[own].tobytes())
                    out["positions"].append(pos[s].astype(np.uint32 if pos[s].max() > 65535 else np.uint16).tobytes())
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("places", pa.binary()), ("classes", pa.binary()), ("positions", pa.binary())]))

    return run


def _narrow(blobs: pd.Series, lengths: list[int]) -> np.ndarray:
    """Numbers of 2 or 4 bytes each, by how many there are."""
    return np.concatenate([np.frombuffer(b, np.uint16 if len(b) == 2 * n else np.uint32) for b, n in zip(blobs, lengths, strict=True)]).astype(np.int64)


_LISTED = "key long, xa long, xb long, nx long, pos long, ya long, yb long, ny long"


def _lists(group: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: the pairs (x, y) that its short lists allow, and the entries (key, x, pos) of long lists and of common shingles."""
    keys = [np.frombuffer(b, np.uint64) for b in group["keys"]]
    lengths = [len(k) for k in keys]
    tables = [np.frombuffer(b, _CLASS) for b in group["classes"]]
    first = np.concatenate([[0], np.cumsum([len(t) for t in tables])[:-1]])
    place = _narrow(group["places"], lengths) + np.repeat(first, lengths)
    table, key, pos = np.concatenate(tables), np.concatenate(keys), _narrow(group["positions"], lengths)
    # the bucket's classes, each once, in order
    by = np.lexsort((table["b"], table["a"]))
    a, b = table["a"][by], table["b"][by]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    where = np.empty(len(by), np.int64)
    where[by] = np.cumsum(new) - 1
    table, place = table[by][new], where[place]
    by = np.lexsort((place, key))
    key, place, pos = key[by], place[by], pos[by]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (place[1:] != place[:-1])])
    key, place, pos = key[once], place[once], pos[once]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    many = np.repeat(np.diff(np.concatenate([at, [len(key)]])), np.diff(np.concatenate([at, [len(key)]])))
    kept = (many >= LONG) | (key >= _TOP)
    n = table["n"][place].astype(np.int64)
    short = ~kept & (many > 1) & (n - pos >= needed(n, -(-PERCENT * n // 100)))
    pairs = _short_pairs(key[short], place[short], n[short], pos[short])
    entries = {"key": key[kept].view(np.int64), "xa": table["a"][place[kept]], "xb": table["b"][place[kept]], "nx": n[kept], "pos": pos[kept]}
    x, y = table[pairs[:, 0]], table[pairs[:, 1]]
    found = {"xa": x["a"], "xb": x["b"], "nx": x["n"].astype(np.int64), "ya": y["a"], "yb": y["b"], "ny": y["n"].astype(np.int64)}
    # a column that only one of them has is null in the other; its numbers need all their bits
    both = [pd.DataFrame(part).astype("Int64").reindex(columns=["key", "xa", "xb", "nx", "pos", "ya", "yb", "ny"]).astype("Int64") for part in (entries, found)]
    return pd.concat(both)


def _short_pairs(key: np.ndarray, place: np.ndarray, n: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Pairs of places, the smaller first, each once, from lists of fewer than LONG entries.

    Sets that link share this shingle first, in one of their lists: then neither has more to share than what stands
    from its entry on.  Lists are in order of position, so once an entry stands too late for the set before it, the rest does.
    """
    by = np.lexsort((pos, key))
    key, place, n, pos = key[by], place[by], n[by], pos[by]
    out = [np.zeros((0, 2), np.int64)]
    for step in range(1, min(LONG, len(key))):
        i = np.flatnonzero(key[step:] == key[:-step])
        if not len(i):
            break
        j = i + step
        fit = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= needed(n[i], n[j])
        i, j = i[fit], j[fit]
        out.append(np.stack([np.minimum(place[i], place[j]), np.maximum(place[i], place[j])], 1))
    return np.unique(np.concatenate(out), axis=0)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that their sketches don't rule out, without the sketches."""
    for batch in batches:
        nx, ny = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        apart = np.array([differing(x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes()) for x, y in zip(batch.column(6), batch.column(7), strict=True)], np.int64)
        yield batch.filter(pa.array((nx + ny - apart) // 2 >= needed(nx, ny))).select(list(range(6)))


def _bits(rows: DataFrame) -> np.ndarray:
    """A filter of the documents rep: bit positions gathered as at most BITS / 64 words."""
    bit = F.pmod(F.xxhash64("rep"), F.lit(BITS))
    found = rows.groupBy(F.floor(bit / 64).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, int(pmod(pmod(xxhash64(rep), {BITS}), 64)))")).alias("x")).toPandas()
    out = np.zeros(BITS // 64, np.int64)
    out[found["w"].to_numpy(np.int64)] = found["x"].to_numpy(np.int64)
    return out


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(a, b, set) of the classes in ``wanted`` (a, b, rep), each from the document rep: a filter of bounded size picks the rows before they are read."""
    bits = docs.sparkSession.sparkContext.broadcast(_bits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(1).to_numpy()
            texts = batch.column(0).filter(pa.array(((bits.value[bit >> 6] >> (bit & np.int64(63))) & 1).astype(bool)))
            for _, _, data, bounds in chunks(texts):
                sets = shingle_sets(data, bounds, width)
                marks = [class_hash(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["a", "b", "set"])

    made = docs.select("text", F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).alias("bit")).mapInArrow(run, "a long, b long, set binary")
    # rows that repeat give one set
    return made.join(wanted.select("a", "b"), ["a", "b"], "left_semi").dropDuplicates(["a", "b"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds overlap, and where y is a pivot of x what only x and then what only y holds, in place of the sets."""
    for batch in batches:
        overlap, apart = [], []
        for reach, x, y in zip(batch.column(6), batch.column(7), batch.column(8), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            overlap.append(len(np.intersect1d(x, y, assume_unique=True)))
            apart.append(np.setdiff1d(x, y, True).tobytes() + np.setdiff1d(y, x, True).tobytes() if reach.is_valid else None)
        yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(overlap, pa.int64()), pa.array(apart, pa.binary())], names=[*_PAIR, "nx", "ny", "reach", "overlap", "apart"])


def verified(docs: DataFrame, pairs: DataFrame, reps: DataFrame, width: int = WIDTH) -> DataFrame:
    """pairs (xa, xb, ya, yb, nx, ny, reach) of classes with overlap and, where reach isn't null, apart; reps: (a, b, rep)."""
    ends = pairs.select(F.col("xa").alias("a"), F.col("xb").alias("b")).unionByName(pairs.select(F.col("ya").alias("a"), F.col("yb").alias("b"))).distinct()
    wanted = saved(reps.join(ends, ["a", "b"], "left_semi").select("a", "b", "rep"), "wanted")
    sets = saved(_sets(docs, wanted, width), "sets")
    both = pairs.join(sets.toDF("xa", "xb", "sx"), ["xa", "xb"]).join(sets.toDF("ya", "yb", "sy"), ["ya", "yb"])
    out = saved(both.select(*_PAIR, "nx", "ny", "reach", "sx", "sy").mapInArrow(_verify, "xa long, xb long, ya long, yb long, nx long, ny long, reach long, overlap long, apart binary"), "verified")
    discard(wanted, sets)
    return out


def _tile(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between classes of two blocks (side 0 and 1; or of one) of a pivot, as few as join all that are linked."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n, o, p = (group[c].to_numpy(np.int64) for c in ("n", "overlap", "size"))
        reach, side, linked = group["reach"].to_numpy(np.int64), group["side"].to_numpy(), group["linked"].to_numpy(bool)
        apart = [np.frombuffer(b, np.uint64) for b in group["apart"]]
        size = np.array([len(d) for d in apart], np.int64)
        one = len(np.unique(side)) == 1
        # all that link to the pivot are one component already
        label = np.where(linked, 0, np.arange(1, len(n) + 1))
        rows = np.flatnonzero(~linked)
        # each of the rest against all; of two blocks, against the other one
        least = needed(n[rows, None], n[None, :], percent)
        share = least - (o[rows, None] + o[None, :] - p[None, :])
        open_ = (share <= np.minimum(size[rows, None], size[None, :])) & (np.minimum(reach[rows, None], reach[None, :]) >= least) & (rows[:, None] != np.arange(len(n)))
        if not one:
            open_ &= side[rows, None] != side[None, :]
        used = open_.any(0)
        used[rows[open_.any(1)]] = True
        values = np.concatenate([np.zeros(0, np.uint64), *[d for d, u in zip(apart, used, strict=True) if u]])
        owner = np.repeat(np.flatnonzero(used), size[used])
        _, column, count = np.unique(values, return_inverse=True, return_counts=True)
        several = count[column] > 1
        column, owner = (np.cumsum(count > 1) - 1)[column[several]], owner[several]
        by = np.argsort(column, kind="stable")
        column, owner = column[by], owner[by]
        shared = np.zeros(open_.shape, np.float32)
        for a in range(0, int(column.max(initial=-1)) + 1, 2048):
            lo, hi = np.searchsorted(column, [a, a + 2048])
            held = np.zeros((len(n), 2048), np.float32)
            held[owner[lo:hi], column[lo:hi] - a] = 1
            shared += held[rows] @ held.T
        links = open_ & (shared >= share)
        out = []
        for i in np.flatnonzero(links.any(1)):
            to = np.flatnonzero(links[i])
            names, at = np.unique(label[to], return_index=True)
            fresh = names != label[rows[i]]
            out += [(rows[i], to[k]) for k in at[fresh]]
            label[np.isin(label, names[fresh])] = label[rows[i]]
        x, y = (np.array([e[k] for e in out], np.int64) for k in (0, 1))
        return pd.DataFrame({"xa": group["a"].to_numpy()[x], "xb": group["b"].to_numpy()[x], "ya": group["a"].to_numpy()[y], "yb": group["b"].to_numpy()[y]})

    return run


def _first_differences(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(pa, pb, element, a, b, linked) of the differences that a class must share one of with what it links to.

    If x and y link, their differences from the pivot differ in at most (100 - percent) / percent of n places, so what they
    share first, in one order of the pivot's differences, stands among so many and one.  What the pivot lacks comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken = [np.frombuffer(d.as_buffer(), np.int64)[: (100 - percent) * n // percent + 1] for d, n in zip(batch.column(5), batch.column(4).to_pylist(), strict=True)]
            at = pa.array(np.repeat(np.arange(batch.num_rows), [len(d) for d in taken]))
            element = pa.array(np.concatenate([np.zeros(0, np.int64), *taken]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in (0, 1)), element, *(batch.column(k).take(at) for k in (2, 3, 6))], names=["pa", "pb", "element", "a", "b", "linked"])

    return run


def _blocked(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds block to rows in order of (pivot, reach): a new one for each pivot, and after so many classes or bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, last, m, size = TaskContext.get().partitionId() << 32, None, 0, 0
        for batch in batches:
            blocks = []
            lengths = [len(d.as_buffer()) for d in batch.column("apart")]
            for pivot, own in zip(zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), strict=True), lengths, strict=True):
                if pivot != last or m == most or size + own > BLOCK_BYTES:
                    block, last, m, size = block + 1, pivot, 0, 0
                m, size = m + 1, size + own
                blocks.append(block)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks, pa.int64())], names=[*batch.schema.names, "block"])

    return run


def _close(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pairs of classes of a pivot that link, by the differences that they share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny, ox, oy, size = (batch.column(k).to_numpy() for k in range(4, 9))
            shared = np.array([len(np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)) for x, y in zip(batch.column(9), batch.column(10), strict=True)], np.int64)
            yield batch.filter(pa.array(ox + oy - size + shared >= needed(nx, ny, percent))).select(list(range(4)))

    return run


_LINKED = "xa long, xb long, ya long, yb long"
_MEMBER = "pa long, pb long, size long, a long, b long, n long, reach long, overlap long, apart binary, linked boolean"


def tiles(members: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, tiles): members of pivots cut into blocks along their reach, and the pairs of blocks that may hold a link.

    tiles: (pa, pb, x_block, y_block), x_block at most y_block.
    """
    order = ["pa", "pb", "reach", "n", "a", "b"]
    dealt = members.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = saved(dealt.mapInArrow(_blocked(block), f"{_MEMBER}, block long"), "blocks")
    delta = F.octet_length("apart") / 8
    told = cut.groupBy("pa", "pb", "block").agg(
        F.count_if(~F.col("linked")).alias("rest"), F.count("*").alias("m"), F.max("reach").alias("reach"), F.min("n").alias("least"), F.max("n").alias("most"), F.min(delta).alias("near"), F.max(delta).alias("far")
    )
    names = ["block", "rest", "m", "reach", "least", "most", "near", "far"]
    x, y = (told.select("pa", "pb", *[F.col(c).alias(f"{side}_{c}") for c in names]) for side in "xy")
    apart = (100 - percent) * (F.col("x_most") + F.col("y_most"))  # of what links, at most this over 100 + percent
    both = x.join(y, ["pa", "pb"]).filter(
        (F.col("x_block") <= F.col("y_block")) & (F.col("x_rest") + F.col("y_rest") > 0) & ((F.col("x_block") < F.col("y_block")) | (F.col("x_m") > 1))
        & ((100 + percent) * F.least("x_reach", "y_reach") >= percent * (F.col("x_least") + F.col("y_least")))
        & (100 * F.col("x_most") >= percent * F.col("y_least")) & (100 * F.col("y_most") >= percent * F.col("x_least"))
        & ((100 + percent) * F.greatest(F.col("x_near") - F.col("y_far"), F.col("y_near") - F.col("x_far")) <= apart)
    )
    return cut, saved(both.select("pa", "pb", "x_block", "y_block"), "tiles")


def derived(stars: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links (xa, xb, ya, yb) that join what is linked among the classes x of each pivot y, but those that link to it.

    The classes of a small pivot make one tile.  Of a pivot with more than a block, only classes that share one of their first
    differences meet: those that share one with few, pair by pair; the others in blocks along their reach.
    """
    linked = slack(F.col("nx"), F.col("ny"), F.col("overlap"), percent) >= 0
    members = stars.select(F.col("ya").alias("pa"), F.col("yb").alias("pb"), F.col("ny").alias("size"), F.col("xa").alias("a"), F.col("xb").alias("b"), F.col("nx").alias("n"), "reach", "overlap", "apart", linked.alias("linked"))
    # whoever reaches less than sets of its size need links to none
    members = members.filter((100 + percent) * F.col("reach") >= percent * (F.col("n") + F.ceil(percent * F.col("n") / 100)))
    pivots = members.groupBy("pa", "pb").agg(F.count("*").alias("m"), F.count_if(~F.col("linked")).alias("rest"), F.sum(F.octet_length("apart")).alias("bytes"))
    large = (F.col("m") > block) | (F.col("bytes") > BLOCK_BYTES)
    members = saved(members.join(pivots.filter("rest > 0 AND m > 1").select("pa", "pb", large.alias("large")), ["pa", "pb"]), "members")
    one = members.filter(~F.col("large")).withColumn("side", F.lit(0)).groupBy("pa", "pb").applyInPandas(_tile(percent), _LINKED)

    many = members.filter("large").drop("large")
    first = many.select("pa", "pb", "a", "b", "n", "apart", "linked").mapInArrow(_first_differences(percent), "pa long, pb long, element long, a long, b long, linked boolean")
    first = saved(first, "differences")
    lists = first.groupBy("pa", "pb", "element").agg(F.count("*").alias("m"), F.min("linked").alias("done")).filter("m > 1 AND NOT done").drop("done")
    met = first.join(lists, ["pa", "pb", "element"])
    few = met.filter(F.col("m") < LONG).drop("m")
    x, y = (few.select("pa", "pb", "element", *[F.col(c).alias(f"{side}{c}") for c in ("a", "b", "linked")]) for side in "xy")
    pairs = x.join(y, ["pa", "pb", "element"]).filter("struct(xa, xb) < struct(ya, yb) AND NOT (xlinked AND ylinked)").select("pa", "pb", *_PAIR).distinct()
    own = many.select("pa", "pb", "a", "b", "n", "overlap", "size", "apart")
    both = pairs.join(own.toDF("pa", "pb", "xa", "xb", "nx", "ox", "size", "dx"), ["pa", "pb", "xa", "xb"]).join(own.drop("size").toDF("pa", "pb", "ya", "yb", "ny", "oy", "dy"), ["pa", "pb", "ya", "yb"])
    close = both.select(*_PAIR, "nx", "ny", "ox", "oy", "size", "dx", "dy").mapInArrow(_close(percent), _LINKED)

    often = met.filter(F.col("m") >= LONG).select("pa", "pb", "a", "b").distinct()
    blocks, asked = tiles(many.join(often, ["pa", "pb", "a", "b"], "left_semi").select(*[c.split()[0] for c in _MEMBER.split(", ")]), percent, block)
    sides = F.when(F.col("x_block") == F.col("y_block"), F.array(F.struct(F.lit(0).alias("side"), F.col("x_block").alias("block")))).otherwise(
        F.array(F.struct(F.lit(0).alias("side"), F.col("x_block").alias("block")), F.struct(F.lit(1).alias("side"), F.col("y_block").alias("block")))
    )
    names = ["pa", "pb", "x_block", "y_block"]
    tiled = asked.select(*names, F.explode(sides).alias("s")).select(*names, "s.*").join(blocks, ["pa", "pb", "block"]).groupBy(*names).applyInPandas(_tile(percent), _LINKED)
    out = saved(one.unionByName(close).unionByName(tiled), "derived")
    discard(members, first, blocks, asked)
    return out


def class_links(docs: DataFrame, common_size: int = 1_000_000, per_bucket: int = 250_000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, reps, links): profile (doc_id, n, a, b) of each row, reps (a, b, rep, n) of each class, links (xa, xb, ya, yb) of classes.

    common_size: entries of the table of common shingles, which only shapes the order.
    per_bucket: prefix entries that a bucket holds on average.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    spark = docs.sparkSession
    profile = saved(docs.select("doc_id", "text").mapInArrow(_profile, f"doc_id {id_type}, n long, a long, b long, sketch binary"), "profile")
    total = profile.agg(F.sum("n")).first()[0] or 0
    buckets = int(max(24, total // (4 * per_bucket)))
    counted = docs.select("text").mapInArrow(_counted(buckets), "bucket int, shingles binary, counts binary")
    often = counted.groupBy("bucket").applyInPandas(_common, "a long, n long").orderBy(F.desc("n"), "a").limit(common_size).toPandas()
    shingles = often["a"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(shingles)
    # the rarest of the common ones come first
    order = spark.sparkContext.broadcast(Order(shingles[by], (len(often) - 1 - by).astype(np.uint64)))
    reps = saved(profile.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch")), "classes")

    packed = docs.select("text").mapInArrow(_prefixes(order, buckets), "bucket int, keys binary, places binary, classes binary, positions binary")
    lists = saved(packed.groupBy("bucket").applyInPandas(_lists, _LISTED), "lists")

    sketches = reps.select("a", "b", "sketch")
    short = lists.filter("key IS NULL").select(*_PAIR, "nx", "ny").distinct()
    short = short.join(sketches.toDF("xa", "xb", "sx"), ["xa", "xb"]).join(sketches.toDF("ya", "yb", "sy"), ["ya", "yb"])
    short = short.select(*_PAIR, "nx", "ny", "sx", "sy").mapInArrow(_alike, "xa long, xb long, ya long, yb long, nx long, ny long")

    entries = lists.filter("key IS NOT NULL")
    pivots = entries.groupBy("key").agg(F.min(F.struct("xa", "xb", "nx")).alias("p"), F.max(F.struct("xa", "xb", "nx")).alias("last")).filter("p <> last").select("key", "p")
    listed = entries.join(pivots, "key").filter((F.col("xa") != F.col("p.xa")) | (F.col("xb") != F.col("p.xb")))
    stars = listed.groupBy("xa", "xb", F.col("p.xa").alias("ya"), F.col("p.xb").alias("yb"), "nx", F.col("p.nx").alias("ny")).agg(F.max(F.col("nx") - F.col("pos")).alias("reach"))
    pairs = saved(stars.unionByName(short.withColumn("reach", F.lit(None).cast("long"))), "pairs")
    discard(lists)

    found = verified(docs, pairs, reps)
    links = found.filter(slack(F.col("nx"), F.col("ny"), F.col("overlap")) >= 0).select(*_PAIR)
    links = saved(links.unionByName(derived(found.filter("reach IS NOT NULL"))), "links")
    discard(pairs, found)
    return profile.drop("sketch"), reps.drop("sketch"), links


def near_duplicates(docs: DataFrame, common_size: int = 1_000_000, per_bucket: int = 250_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text): component_id is the smallest doc_id reachable by links.

    doc_id may be of any type that has an order, structs too.
    """
    profile, reps, links = class_links(docs, common_size, per_bucket)
    rep = reps.select("a", "b", "rep")
    edges = links.join(rep.toDF("xa", "xb", "u"), ["xa", "xb"]).join(rep.toDF("ya", "yb", "v"), ["ya", "yb"]).select("u", "v")
    labels = components(edges.filter("u IS NOT NULL AND v IS NOT NULL"))
    named = saved(rep.join(labels, rep["rep"] == labels["node"], "left").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.coalesce("label", "rep").alias("component")), "named")
    out = profile.join(named, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))
