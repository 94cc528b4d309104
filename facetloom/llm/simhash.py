"""SimHash near-dedup by tiled exact comparison.

Every text gets a 64-bit fingerprint.  Distinct fingerprints are dealt into tiles by
the population counts of their four 16-bit words.  Two fingerprints that differ in
at most ``radius`` bits have counts that differ by no more in sum, so a tile meets
only the tiles within that distance and every other pair of tiles is skipped.  Tiles
that meet are compared in full with exclusive-or and bit counts; nothing is capped.

A tile with more fingerprints than ``TILE`` is split into blocks, each of which
meets the whole of the neighbouring tiles as a stream, so a task holds one block and
one batch.  From each block only a spanning forest of the links it finds is sent on.

The work grows with the square of the number of distinct fingerprints, at about one
sixtieth of all pairs; exact copies share a fingerprint and do not add to it.

Defined results: a null text counts as empty and has fingerprint zero, linked like
any other; a null id is never a component's id unless it has no other.  An empty
table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, shuffle_width
from .components import connected_components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints in one block of a tile.
TILE = 8192
#: Comparisons made at once.
AT_ONCE = 1 << 21
#: Values that the population count of a 16-bit word takes; the tiles number 17 ** 4 at most.
COUNTS = 17


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter((b" ".join(words),))
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(SEED)), np.uint64)
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def forest(homes: np.ndarray, visitors: np.ndarray, radius: int, joined: dict[int, int]) -> list[tuple[int, int]]:
    """Links between ``homes`` and ``visitors``, without those that ``joined`` shows to be connected already."""

    def root(x: int) -> int:
        while (up := joined.setdefault(x, x)) != x:
            joined[x] = x = joined[up]
        return x

    out = []
    step = max(1, AT_ONCE // max(1, len(homes)))
    for at in range(0, len(visitors), step):
        some = visitors[at : at + step]
        near = np.bitwise_count(homes[:, None] ^ some[None, :]) <= radius
        h, v = np.nonzero(near)
        for x, y in zip(homes[h].tolist(), some[v].tolist(), strict=True):
            if x != y and (p := root(x)) != (q := root(y)):
                joined[p] = q
                out.append((x, y))
    return out


def compare_tiles(batches: Iterator[pa.RecordBatch], radius: int = RADIUS) -> Iterator[pa.RecordBatch]:
    """Links of blocks with their visitors; rows come by block, the block's own first."""
    key, homes, joined = None, [], {}
    for batch in batches:
        blocks, roles = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        fps = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
        turns = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(roles) != 0)) + 1
        found = []
        for at, to in itertools.pairwise([0, *turns.tolist(), len(blocks)]):
            if at == to:
                continue
            if blocks[at] != key:
                key, homes, joined = blocks[at], [], {}
            if not roles[at]:
                homes.append(fps[at:to])
            elif homes:
                homes = [np.concatenate(homes)] if len(homes) > 1 else homes
                found += forest(homes[0], fps[at:to], radius, joined)
        if found:
            pairs = np.array(found, np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def tile_of(fp: Column) -> tuple[Column, list[Column]]:
    """The number of a fingerprint's tile and the population counts of its four words."""
    counts = [F.bit_count(F.shiftright(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    number = F.lit(0)
    for c in counts:
        number = number * COUNTS + c
    return number, counts


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest of the pairs of ``distinct`` (fp) within ``radius`` bits."""
    number, counts = tile_of(F.col("fp"))
    tiled = distinct.select("fp", number.alias("tile"), *[c.alias(f"c{i}") for i, c in enumerate(counts)])
    # 17 ** 4 rows at most, whatever the input: safe to broadcast.
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("n_blocks"))
    # Of two tiles that meet, the one with the larger number visits the other.
    steps = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and d <= (0, 0, 0, 0)]
    step = F.explode(F.array(*[F.array(*map(F.lit, d)) for d in steps])).alias("d")
    moved = tiled.select("fp", "tile", "c0", "c1", "c2", "c3", step)
    inside = F.lit(True)
    to = F.lit(0)
    for i in range(4):
        c = F.col(f"c{i}") + F.col("d")[i]
        inside, to = inside & c.between(0, COUNTS - 1), to * COUNTS + c
    visits = moved.filter(inside).select("fp", to.alias("tile")).join(F.broadcast(sizes), "tile")
    visits = visits.select("tile", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("block"), F.lit(1).alias("role"), "fp")
    own = tiled.join(F.broadcast(sizes), "tile").select("tile", F.pmod(F.xxhash64("fp"), "n_blocks").cast("int").alias("block"), F.lit(0).alias("role"), "fp")
    rows = own.unionByName(visits).select((F.col("tile").cast("long") * F.lit(1 << 32) + F.col("block")).alias("key"), "role", "fp")
    dealt = rows.repartition(shuffle_width(distinct.sparkSession), "key").sortWithinPartitions("key", "role")
    return dealt.mapInArrow(lambda it: compare_tiles(it, radius), "a long, b long")


def near_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, key_col: str | None = None) -> DataFrame:
    """(key, id, fp, fingerprint, component_id, keeper, head) for every row of ``df``.

    ``component_id`` is the smallest id that links reach; ``keeper`` marks the one row
    of the component that stays, ``head`` is its key.  ``key`` is the long column
    ``key_col``, in which no two rows are equal; without one, rows are numbered.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.col(f"`{key_col}`") if key_col else F.monotonically_increasing_id()
    rows = cut(df.select(key.alias("key"), F.col(f"`{id_col}`").alias("id"), fingerprints(text).alias("fp")))
    # Nulls last, then the first row of the smallest id.
    own = rows.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first"))
    own = cut(own)
    roots = connected_components(links(own.select("fp"), radius)).select(F.col("node").alias("fp"), "root")
    grouped = own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    heads = grouped.groupBy("root").agg(F.min("first").alias("head"))
    of_print = cut(grouped.join(heads, "root").select("fp", "head"))
    return rows.join(of_print, "fp").select(
        "key",
        "id",
        "fp",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("head.id").alias("component_id"),
        (F.col("head.key") == F.col("key")).alias("keeper"),
        F.col("head.key").alias("head"),
    )
