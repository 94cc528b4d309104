import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from facetloom.llm import simhash
from facetloom.llm.components import connected_components


def naive_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


@pytest.mark.parametrize("text", [None, "", " \t\n", "one", "One TWO", "a b c", "A b\x0bc\x0cd", "É é Ü x y", "a\xa0b c d", "w " * 700, "x y z " * 30_000])
def test_fingerprints(text):
    assert simhash.fingerprint(text) == naive_fingerprint(text)


def test_hash_is_the_built_in_one(spark):
    text = "a ü c"
    mine = xxhash.xxh64_intdigest(text.encode(), 42)
    assert spark.createDataFrame([(text,)], "t string").select(F.xxhash64("t")).first()[0] % (1 << 64) == mine


def brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("tile", [4, 8192])
def test_links_join_what_all_pairs_join(spark, tile):
    rng = random.Random(tile)
    fps = {0, (1 << 64) - 1, 1, 3}
    for _ in range(40):  # chains and clouds of near prints, and strangers
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 8)):
            fps.add(f)
            f ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                f ^= 1 << rng.randrange(64)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    edges = simhash.links(df, tile=tile)
    found = {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in connected_components(edges).collect()}
    expected = brute_components(fps)
    groups = lambda keys: sorted(sorted(g) for g in {k: [f for f, c in zip(fps, keys, strict=True) if c == k] for k in set(keys)}.values())
    assert groups([found.get(f, f) for f in fps]) == groups(expected)
    assert edges.count() == len(fps) - len(set(expected)) or edges.count() < 2 * len(fps)
    assert simhash.links(df.limit(0)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, **{k: 5 for k in range(200, 260)}}


def test_rows(spark):
    rows = [(4, "A b c d"), (2, "a B c d"), (2, "a b c d"), (None, "a b c d"), (9, None), (8, ""), (7, "something else entirely"), (None, "alone and without id")]
    got = sorted(((r["id"], r["component_id"], r["keeper"]) for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS fp", "2 AS key")).collect()), key=str)
    assert [(i, c) for i, c, _ in got] == sorted([(4, 2), (2, 2), (2, 2), (None, 2), (9, 8), (8, 8), (7, 7), (None, None)], key=str)
    assert sum(k for _, _, k in got) == 4
    assert simhash.near_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_table_against_all_pairs(spark, data, documents):
    fps = [naive_fingerprint(t) for _, t, _ in documents]
    ids = [i for i, _, _ in documents]
    roots = brute_components(fps)
    expected = {i: (f"{f:016x}", ids[r]) for i, f, r in zip(ids, fps, roots, strict=True)}
    got = simhash.near_dedup(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert {r["id"]: (r["fingerprint"], r["component_id"]) for r in got} == expected
