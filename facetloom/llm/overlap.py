"""Near copies by the overlap of their word shingles.

Two texts are linked if the Jaccard similarity of their sets of ``SHINGLE``-word
shingles is ``SIMILAR`` or more.  Candidates share one of ``BANDS`` bands of ``DEPTH``
MinHash values; a pair at 0.8 shares none with a probability of 5e-8.  Groups of
candidates with the same members count once.

A group is compared with its centre first, the member that shares most bands with most
others; members like the centre are joined by it.  Only the rest are compared with all
members, a block of them at a time while the members stream past, so a task holds one
centre or one block however large the group.  Distances to the centre, which obey the
triangle inequality, spare most of these comparisons.  The rest is quadratic only in
members unlike the centre of a group.  Only links that join something are sent on.

Defined results: words are those of ``simhash``; a text shorter than a shingle is one
shingle, and texts without words are linked to nothing.  An empty table has no links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shuffle_width

SHINGLE, SIMILAR, SEED = 5, 0.8, 42
BANDS, DEPTH = 32, 4
#: Shingles whose values are made at once.
AT_ONCE = 1 << 11
#: Members of a group compared with its centre in one task, and in one block of those unlike it.
SPREAD, BLOCK = 4096, 256


def shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles, ascending, each once."""
    words = (text or "").encode().lower().split()  # as ``simhash.fingerprint``
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else iter((b" ".join(words),))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, itertools.repeat(SEED)), np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """The names of a text's bands."""
    if not len(hashes):
        return []
    rng = np.random.default_rng(SEED)
    flip, odd = rng.integers(0, 1 << 32, (2, BANDS * DEPTH), dtype=np.uint32) | np.uint32(1)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(folded), AT_ONCE):
        mixed = folded[None, at : at + AT_ONCE] ^ flip[:, None]
        mixed *= odd[:, None]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x9E3779B1)
        least = np.minimum(least, mixed.min(axis=1))
    rows = least.reshape(BANDS, DEPTH)
    return [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_names(texts: pd.Series) -> pd.Series:
    return pd.Series([bands(shingles(t)) for t in texts])


@F.pandas_udf(T.BinaryType())
def packed_shingles(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    return min(len(a), len(b)) >= SIMILAR * max(len(a), len(b)) and alike(a, b)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def by_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, key, centre, near, distance) of the members; rows (band, part, role, key, hashes) come by band and part, the centre first."""
    centre, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        out = []
        for band, role, key, data in zip(*(batch.column(c).to_pylist() for c in ("band", "role", "key", "hashes")), strict=True):
            hashes = np.frombuffer(data, np.uint64)
            if not role:
                centre, own = key, hashes
            else:
                out.append((band, key, centre, similar(own, hashes), 1 - likeness(own, hashes)))
        if out:
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["band", "key", "centre", "near", "distance"])


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links of a block's members with all others; rows (band, part, role, key, root, distance, hashes) come by band and part, the block first."""
    at, homes, joined = None, [], {}

    def root(x: int) -> int:
        while (up := joined.setdefault(x, x)) != x:
            joined[x] = x = joined[up]
        return x

    for batch in batches:
        found = []
        names = ("band", "part", "role", "key", "root", "distance", "hashes")
        for band, part, role, key, own_root, distance, data in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if (band, part) != at:
                at, homes, joined = (band, part), [], {}
            hashes = np.frombuffer(data, np.uint64)
            if not role:
                homes.append((key, distance, hashes))
                continue
            for home, other, theirs in homes:
                # Two texts that far apart as seen from the centre are no closer to each other.
                if home == key or abs(distance - other) > 1 - SIMILAR + 1e-9 or root(home) == root(own_root):
                    continue
                if similar(theirs, hashes):
                    joined[root(home)] = root(own_root)
                    found.append((home, key))
        if found:
            pairs = np.array(found, np.int64)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def links(rows: DataFrame) -> DataFrame:
    """(a, b): keys that join all rows of ``rows`` (key, text) whose texts are similar; no two rows have the same key."""
    width = shuffle_width(rows.sparkSession)
    named = cut(rows.select("key", F.explode(band_names("text")).alias("band")))
    total = lambda seed: F.sum(F.xxhash64("key", F.lit(seed)).cast("decimal(38,0)"))
    groups = named.groupBy("band").agg(F.count(F.lit(1)).alias("n"), total(1).alias("s"), total(2).alias("t")).filter("n > 1")
    once = groups.groupBy("n", "s", "t").agg(F.min("band").alias("band")).select("band", "n")
    members = cut(named.join(once, "band"))
    sociable = members.groupBy("key").agg(F.sum("n").alias("seen"))
    hashes = cut(rows.join(sociable, "key").select("key", "seen", packed_shingles("text").alias("hashes")))
    centres = members.join(hashes.select("key", "seen"), "key").groupBy("band").agg(F.max(F.struct("seen", "key")).alias("c"), F.first("n").alias("n"))
    centres = centres.select("band", F.col("c.key").alias("centre"), F.ceil(F.col("n") / SPREAD).cast("int").alias("parts"))

    part = F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part")
    heads = centres.select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("centre").alias("key"))
    others = members.join(centres, "band").filter("key <> centre").select("band", part, F.lit(1).alias("role"), "key")
    first = heads.unionByName(others).join(hashes.select("key", "hashes"), "key")
    dealt = first.repartition(width, "band", "part").sortWithinPartitions("band", "part", "role", "key")
    seen = cut(dealt.mapInArrow(by_centre, "band long, key long, centre long, near boolean, distance double"))

    # Where only one member but the centre is left, there is nothing more to compare.
    left = seen.groupBy("band").agg(F.count_if(~F.col("near")).alias("far"), F.count(F.lit(1)).alias("n")).filter("far > 0 AND n > 1")
    left = left.select("band", F.ceil(F.col("far") / BLOCK).cast("int").alias("parts"))
    rest = seen.join(left, "band").withColumn("root", F.when(F.col("near"), F.col("centre")).otherwise(F.col("key")))
    homes = rest.filter(~F.col("near")).select("band", part, F.lit(0).alias("role"), "key", "root", "distance")
    visits = rest.select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("role"), "key", "root", "distance")
    second = homes.unionByName(visits).join(hashes.select("key", "hashes"), "key")
    again = second.repartition(width, "band", "part").sortWithinPartitions("band", "part", "role", "key")
    near = seen.filter("near").select(F.col("centre").alias("a"), F.col("key").alias("b"))
    return near.unionByName(again.mapInArrow(by_block, "a long, b long"))
