"""Exact dedup by deterministic block naming.

A text is cut into blocks of a fixed number of bytes.  The distinct blocks are
sorted and numbered, so equal blocks, and only those, share an integer name.  Then
adjacent names are paired, the distinct pairs are sorted and numbered in turn, and
so on until each document has one name.  With the length in bytes that name is a
collision-free identity: no step takes equal hashes for equal texts.

Texts cross the network once, to the partition where equal blocks meet and are
sorted; after that only integers move.  Distinct blocks and pairs are pre-aggregated before each
shuffle.  A text's rows are dealt over as many tasks as a shuffle has before they
learn of their group, so a third of all rows may share one text.

Defined results: a null text counts as empty; equal texts form one group in which
the row with the largest id stays (null ids are the smallest; of rows with the same
id one stays).  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, shuffle_width

BLOCK_BYTES = 4096


def blocks_of(text: Column, size: int) -> Column:
    """The bytes of ``text`` in blocks; the empty text is one empty block."""
    raw = text.cast("binary")
    last = F.greatest(F.octet_length(text) - 1, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), F.floor(last / size).cast("int")),
        lambda i: F.substr(raw, i * size + 1, F.lit(size)),
    )


def numbered(distinct: DataFrame, *order: str) -> DataFrame:
    """Integer names in sorted order, first by the hash partition that made the rows distinct."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def name_blocks(texts: DataFrame, size: int, seed: int) -> DataFrame:
    """(h1, h2, name): the sorted distinct blocks, addressed by two hashes of the block."""
    block = texts.select(F.explode(blocks_of(F.col("norm"), size)).alias("block"))
    keyed = block.select(F.xxhash64("block", F.lit(seed)).alias("h1"), F.xxhash64(F.lit(seed), "block").alias("h2"), "block")
    return cut(numbered(keyed.distinct(), "block").select("h1", "h2", "name"))


def last_block(text: Column, size: int) -> Column:
    return F.floor(F.greatest(F.octet_length(text) - 1, F.lit(0)) / size).cast("int")


def identify(rows: DataFrame, size: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` (key, norm, more) with a name in place of norm: with the length in bytes, equal names mean equal texts."""
    for seed in range(1, 9):
        names = name_blocks(rows, size, seed)
        # The two hashes only address a name; that no two blocks share an address is checked, not assumed.
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("blocks share an address under every seed")
    addresses = F.transform(blocks_of(F.col("norm"), size), lambda b: F.struct(F.xxhash64(b, F.lit(seed)).alias("h1"), F.xxhash64(F.lit(seed), b).alias("h2")))
    small = cut(rows.withColumns({"last": last_block(F.col("norm"), size), "addresses": addresses}).drop("norm"))
    placed = small.select("key", "last", F.posexplode("addresses").alias("pos", "a")).select("key", "pos", "last", "a.h1", "a.h2")
    level = cut(placed.join(names, ["h1", "h2"]).select("key", "pos", "last", "name"))
    done = level.filter("last = 0").select("key", "name")
    deepest = level.agg(F.max("last")).first()[0] or 0
    while deepest > 0:
        even, odd = F.when(F.col("pos") % 2 == 0, F.col("name")), F.when(F.col("pos") % 2 == 1, F.col("name"))
        pairs = level.filter("last > 0").groupBy("key", F.shiftright("pos", 1).alias("pos"), F.shiftright("last", 1).alias("last"))
        pairs = pairs.agg(F.max(even).alias("a"), F.coalesce(F.max(odd), F.lit(-1)).alias("b"))
        names = cut(numbered(pairs.select("a", "b").distinct(), "a", "b"))
        level = cut(pairs.join(names, ["a", "b"]).select("key", "pos", "last", "name"))
        done = done.unionByName(level.filter("last = 0").select("key", "name"))
        deepest >>= 1
    return small.drop("last", "addresses").join(done, "key")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK_BYTES, key_col: str | None = None) -> DataFrame:
    """(key, id, keep_id, group_size, kept, text_sha256) for every row of ``df``.

    ``key`` is the long column ``key_col``, in which no two rows are equal; without
    one, rows are numbered.
    """
    key = F.col(f"`{key_col}`") if key_col else F.monotonically_increasing_id()
    norm = ascii_lower(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = df.select(key.alias("key"), F.col(f"`{id_col}`").alias("id"), norm.alias("norm"))
    facts = {"n_bytes": F.octet_length("norm"), "text_sha256": F.sha2(F.col("norm"), 256)}
    found = cut(identify(rows.withColumns(facts), size)).withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(shuffle_width(df.sparkSession))))
    # Each task's share of a group first, then the shares of a group, then back the same way.
    shares = found.groupBy("n_bytes", "name", "deal").agg(F.max(F.struct("id", "key")).alias("most"), F.count(F.lit(1)).alias("n"))
    groups = shares.groupBy("n_bytes", "name").agg(F.max("most").alias("stays"), F.sum("n").alias("group_size"))
    told = shares.select("n_bytes", "name", "deal").join(groups, ["n_bytes", "name"])
    return found.join(told, ["n_bytes", "name", "deal"]).select(
        "key",
        "id",
        F.col("stays.id").alias("keep_id"),
        "group_size",
        (F.col("key") == F.col("stays.key")).alias("kept"),
        "text_sha256",
    )


ORACLE = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)"""
