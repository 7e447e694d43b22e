"""MinHash near-dedup: hash minima, banding, verification and connected components.

A document's set is its different ``width``-word shingles, as 64-bit hashes.  Equal
sets form a class, known by 128 bits of hash; classes, not documents, are
joined, so copies cost one class.

*Minima.*  ``BANDS * ROWS`` universal hashes (multiply, add, take the high bits) of
a set's shingles; their minima are its signature.  Two sets of similarity s agree
in a minimum with probability s.

*Banding.*  Classes that agree in all ``ROWS`` minima of a band meet.  A pair of
similarity s is missed by all bands with probability ``(1 - s ** ROWS) ** BANDS``:
at 0.8 that is 5e-8.  Bands of few classes give pairs.  In a band of ``LONG``
classes or more, the smallest is the pivot and every other class is paired with
it, so a large group gives as many pairs as it has classes, not their square.

*Verification.*  Pairs whose sizes rule a link out are dropped; so are those
whose signatures agree in fewer places than six standard deviations below what
a link makes likely (of a billion links, one is lost).  The others are confirmed
on the full sets.  What the classes of a pivot link to beside it follows from their
differences from it (``jaccard_join.derived``), also on full sets.

*Components.*  Large-star and small-star rounds over the links.

Null and empty texts, and texts of white space, have empty sets, linked with
nothing.  Texts with fewer words than ``width`` have one shingle, the whole.  Repeated
rows belong to one class, and each gives its row; null ids are kept, take no part
in a class's smallest id, and of a class with null ids only each row is its own
component.  Very long texts are read whole, in a chunk of their own.  Only the text and
doc_id columns are read.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, discard, mixed, saved
from .components import components
from .jaccard_join import LONG, class_hash, derived, shingle_sets, slack, verified

WIDTH, PERCENT = 2, 80
BANDS, ROWS = 32, 4
#: Shingles hashed at a time.
SLICE = 4096

_RNG = np.random.default_rng(20250611)
_TIMES = _RNG.integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 2**63, BANDS * ROWS).astype(np.uint64) * np.uint64(2)
_PAIR = ["xa", "xb", "ya", "yb"]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minima of a set that isn't empty: 32 bits each."""
    out = np.full(len(_TIMES), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), SLICE):
        hashes = _TIMES[:, None] * shingles[None, at : at + SLICE]
        hashes += _PLUS[:, None]
        np.minimum(out, hashes.min(axis=1), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def least_agreeing(percent: int) -> int:
    """In how many minima a pair must agree to be looked at: six standard deviations below the mean of a pair that just links."""
    s, n = percent / 100, BANDS * ROWS
    return max(ROWS, int(n * s - 6 * (n * s * (1 - s)) ** 0.5))


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, bounds in chunks(batch.column(1)):
                sets = shingle_sets(data, bounds, width)
                marks = [class_hash(s) for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *columns], names=["doc_id", "n", "a", "b", "minima"])

    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, a, b, n): a class once for each band."""
    for batch in batches:
        rows = batch.num_rows
        minima = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)), np.uint32).reshape(rows, BANDS, ROWS).astype(np.uint64)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (rows, BANDS))
        for k in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, :, k])
        at = pa.array(np.repeat(np.arange(rows), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), *(batch.column(k).take(at) for k in range(3))], names=["key", "a", "b", "n"])


def _agreeing(least: int):
    """The pairs whose signatures agree in ``least`` places, without the signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(k)), np.uint32).reshape(batch.num_rows, -1) for k in (6, 7))
            yield batch.filter(pa.array((x == y).sum(1) >= least)).select(list(range(6)))

    return run


def class_links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profile, reps, links): profile (doc_id, n, a, b) of each row, reps (a, b, rep, n) of each class, links (xa, xb, ya, yb) that join all linked classes."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    profile = saved(docs.select("doc_id", "text").mapInArrow(_profile(width), f"doc_id {id_type}, n long, a long, b long, minima binary"), "profile")
    reps = saved(profile.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("minima").alias("minima")), "classes")

    bands = saved(reps.select("a", "b", "n", "minima").mapInArrow(_banded, "key long, a long, b long, n long"), "bands")
    held = bands.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("a", "b", "n")).alias("p")).filter("m > 1")
    met = saved(bands.join(held, "key"), "met")
    sizes = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    few = met.filter(F.col("m") < LONG).select("key", "a", "b", "n")
    pairs = few.toDF("key", "xa", "xb", "nx").join(few.toDF("key", "ya", "yb", "ny"), "key").filter((F.struct("xa", "xb") < F.struct("ya", "yb")) & sizes(F.col("nx"), F.col("ny"))).select(*_PAIR, "nx", "ny").distinct()
    minima = reps.select("a", "b", "minima")
    pairs = pairs.join(minima.toDF("xa", "xb", "sx"), ["xa", "xb"]).join(minima.toDF("ya", "yb", "sy"), ["ya", "yb"])
    pairs = pairs.select(*_PAIR, "nx", "ny", "sx", "sy").mapInArrow(_agreeing(least_agreeing(percent)), "xa long, xb long, ya long, yb long, nx long, ny long")
    # a class of a large group is paired with its pivot, whatever their similarity: what else it links to follows from that
    stars = met.filter((F.col("m") >= LONG) & ((F.col("a") != F.col("p.a")) | (F.col("b") != F.col("p.b")))).groupBy(F.col("a").alias("xa"), F.col("b").alias("xb"), F.col("p.a").alias("ya"), F.col("p.b").alias("yb")).agg(F.max("n").alias("nx"), F.max("p.n").alias("ny"))
    asked = saved(pairs.withColumn("reach", F.lit(None).cast("long")).unionByName(stars.withColumn("reach", F.col("nx"))), "pairs")
    discard(bands, met)

    found = verified(docs, asked, reps, width)
    links = found.filter(slack(F.col("nx"), F.col("ny"), F.col("overlap"), percent) >= 0).select(*_PAIR)
    links = saved(links.unionByName(derived(found.filter("reach IS NOT NULL"), percent)), "links")
    discard(asked, found)
    return profile.drop("minima"), reps.drop("minima"), links


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of (doc_id, text): component_id is the smallest doc_id reachable by links."""
    profile, reps, links = class_links(docs, width, percent)
    rep = reps.select("a", "b", "rep")
    edges = links.join(rep.toDF("xa", "xb", "u"), ["xa", "xb"]).join(rep.toDF("ya", "yb", "v"), ["ya", "yb"]).select("u", "v")
    labels = components(edges.filter("u IS NOT NULL AND v IS NOT NULL"))
    named = saved(rep.join(labels, rep["rep"] == labels["node"], "left").select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.coalesce("label", "rep").alias("component")), "named")
    out = profile.join(named, (F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb")) & (F.col("n") > 0), "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
