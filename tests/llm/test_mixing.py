import hashlib
import math
from collections import defaultdict

import pytest

from facetloom.llm import mixing


def brute_targets(sizes, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST):
    """Reshare the excess round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped = {s: 0.0 for s in order}, set()
    left = share * sum(sizes.values())
    for _ in range(len(order) + 1):
        free = [s for s in order if s not in capped]
        rest = left - sum(target[s] for s in capped)
        for s in free:
            target[s] = rest * weight[s] / sum(weight[x] for x in free)
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = most * sizes[s]
            capped.add(s)
    return target


def brute_copies(rows, seed=mixing.SEED):
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    target = brute_targets(dict(sizes))
    out = []
    for i, s, t in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5(f"{seed}|{s or ''}|{'null' if i is None else i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out.append((i, s, math.floor(rate) + (u < rate - math.floor(rate))))
    return out


CASES = {
    "plain": [(i, f"s{i % 7}", "w " * (i % 13 + 1)) for i in range(300)],
    "hot": [(i, "hot" if i % 3 else f"s{i % 40}", "w " * (i % 5 + 1)) for i in range(400)],
    "odd": [(1, None, "a b"), (None, None, "c"), (None, "x", None), (2, "é", "a\tb\nc d"), (2, "é", "a\tb\nc d"), (3, "empty", ""), (4, "z", "a\xa0b")],
}


@pytest.mark.parametrize("case", list(CASES))
def test_copies(spark, case):
    rows = CASES[case]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "'x' AS size", "7 AS copies")
    mixed = mixing.mix(df)
    found = mixed.selectExpr("row.doc_id AS i", "row.source AS s", "size", "source_size", "target", "copies").collect()
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    if case != "odd":
        assert sorted([(r["i"], r["s"], r["copies"]) for r in found], key=key) == sorted(brute_copies(rows), key=key)
        taken = defaultdict(float)
        for r in found:
            taken[r["s"]] += r["size"] * r["copies"]
            assert r["copies"] <= 2
        for s, t in brute_targets({r["s"]: r["source_size"] for r in found}).items():
            assert next(r["target"] for r in found if r["s"] == s) == pytest.approx(t)
    else:
        assert {(r["s"], r["source_size"]) for r in found} == {(None, 3), ("x", 0), ("é", 8), ("empty", 0), ("z", 1)}
        assert len({r["copies"] for r in found if r["i"] == 2}) == 1
    emitted = mixing.emit(mixed)
    assert emitted.columns == df.columns and emitted.count() == sum(r["copies"] for r in found)


def test_targets_add_up(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1), (None, 89)], "source string, size long")
    rows = {r["source"]: r["target"] for r in mixing.source_targets(sized).collect()}
    assert sum(rows.values()) == pytest.approx(1.5 * 1100)
    assert rows["a"] == 20 and rows["c"] == 2


def test_joined_targets_when_sources_are_many(spark, monkeypatch):
    df = spark.createDataFrame(CASES["plain"], "doc_id long, source string, text string")
    wide = sorted(map(str, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST", 2)
    assert sorted(map(str, mixing.mix(df).collect())) == wide


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(df).collect() == [] and mixing.emit(mixing.mix(df)).collect() == []
    nothing = spark.createDataFrame([(1, "a", None)], "doc_id long, source string, text string")
    assert [r["copies"] for r in mixing.mix(nothing).collect()] == [0]
